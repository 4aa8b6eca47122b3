"""Hard negatives by norm-bucketed search.

All vectors are sorted by norm, longest first, and cut into buckets, GROUP vectors' buckets to a
group.  An inner product is at most the product of the norms (Cauchy-Schwarz), so a query leaves
out every bucket whose longest vector can't reach the lower limit of one of its windows or, once
it has k rows, its running k-th score; as buckets come longest first, all later ones go too.

A query is dealt only to the groups that its limits let it reach: first to that of the longest
vectors, whose k-th scores then raise the limits for all others.  A task holds one group of
buckets and streams its queries, a block at a time; many queries are dealt to several tasks.
What goes to the driver is one number for each group.

The same search serves both steps: an anchor's positives have no limits and its own label; its
negatives have a window for each positive, and other labels.

Cases: rows with a null label, a null vector or a null or non-finite component take no part;
rows without an id are candidates, after all others of equal score, and never anchors; rows with
an anchor's id aren't its candidates; rows that are repeated are candidates each, and anchors
that are repeated are searched each; vectors of unequal length count as filled up with zeros;
an anchor without another row of its label has no rows; a positive score under 0 has an empty
window; an empty table gives no rows; other columns are ignored.  Components are at most 2^26
when scaled, and a product of norms under 2^55, else the job fails.  Texts play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions
from .vectors import matrix, whole_vectors

#: Vectors of a bucket and of a group of buckets, queries of a block and of a task.
BUCKET, GROUP, BLOCK, SHARD = 1024, 1 << 16, 256, 1 << 16
#: No limit; products below EXACT are exact in doubles; larger ones than LARGE aren't computed.
MOST, EXACT, LARGE = 1 << 62, 1 << 53, 1 << 55
NO_ID = (1 << 63) - 1

BUCKETS = "group long, bucket long, top double, ids array<long>, labels array<long>, width int, vectors binary"
_BUCKETS = pa.schema([
    ("group", pa.int64()), ("bucket", pa.int64()), ("top", pa.float64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
    ("width", pa.int32()), ("vectors", pa.binary()),
])
QUERY = ("a", "anchor_id", "label", "norm", "vector", "floors", "ceilings")
FOUND = "a long, w int, score long, vec_id long"
_FOUND = pa.schema([("a", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def norm_buckets(items: DataFrame) -> DataFrame:
    """Buckets of items (vec_id, label, vector, norm); a larger group number has shorter vectors."""
    parts = max(shuffle_partitions(items.sparkSession), items.count() // GROUP + 1)
    order = [F.col("norm").desc(), F.xxhash64("vec_id", "label")]
    ranged = items.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().cast("long").alias("part"), "vec_id", "label", "norm", "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                own = batch.slice(at, BUCKET)
                group = (own.column("part")[0].as_py() << 20) + rows // GROUP
                x = matrix(own.column("vector"))
                columns = [
                    [group], [rows], [own.column("norm")[0].as_py()], [own.column("vec_id").to_pylist()], [own.column("label").to_pylist()], [x.shape[1]], [x.tobytes()],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BUCKETS, strict=True)], schema=_BUCKETS)
                rows += own.num_rows

    return saved(ranged.mapInArrow(pack, BUCKETS), "buckets")


def _reach(norms: np.ndarray, top: float) -> np.ndarray:
    """No inner product with a vector of norm ``top`` is larger; with slack for rounding."""
    return norms * top * (1 + 1e-9) + 1


def _dealt(queries: DataFrame, groups: list[tuple[int, float]]) -> DataFrame:
    """Queries with each ``group`` that may hold a product of at least their lowest limit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                norms = own.column("norm").to_numpy(zero_copy_only=False)
                lowest = matrix(own.column("floors")).min(1)
                for group, top in groups:
                    kept = own.filter(pa.array(_reach(norms, top) >= lowest))
                    if not kept.num_rows:
                        break  # the groups after it are shorter
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([group] * kept.num_rows, pa.int64())], names=[*QUERY, "group"])

    schema = "a long, anchor_id long, label long, norm double, vector array<long>, floors array<long>, ceilings array<long>, group long"
    return queries.select(*QUERY).mapInArrow(work, schema)


class _Search:
    """Top k of each window of each query among the buckets of its group."""

    def __init__(self, k: int, same: bool):
        self.k, self.same = k, same

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, buckets = None, []
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "shard", "tag")]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in keys], axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if key != (key := (keys[0][lo], keys[1][lo])):
                    buckets = []
                part = batch.slice(lo, hi - lo)
                if keys[2][lo] == 0:
                    buckets.extend(map(self.bucket, part.select(["top", "ids", "labels", "width", "vectors"]).to_pylist()))
                else:
                    for at in range(0, part.num_rows, BLOCK):
                        yield self.search(part.slice(at, BLOCK), buckets)

    @staticmethod
    def bucket(row: dict) -> tuple:
        ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        x = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["width"])
        return row["top"], ids, np.array(row["labels"], np.int64), x

    def search(self, queries: pa.RecordBatch, buckets: list[tuple]) -> pa.RecordBatch:
        anchors, labels, norms = (queries.column(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "label", "norm"))
        x, floors, ceilings = (matrix(queries.column(c)) for c in ("vector", "floors", "ceilings"))
        floors, n, windows = floors.copy(), len(norms), floors.shape[1]
        last = np.full((n, windows), NO_ID)  # with the k-th score as the floor, the k-th id; any id before
        none = np.empty(0, np.int64)
        held = [(none, none, none)] * windows  # query, score, id; the best k of each query
        for top, ids, others, y in buckets:
            open_ = np.flatnonzero((_reach(norms, top) >= floors.min(1)))
            if not len(open_):
                break
            scores = _products(x[open_], y, float(norms[open_].max()) * top)
            fits = (labels[open_, None] == others) == self.same
            fits &= anchors[open_, None] != ids
            for w in range(windows):
                floor = floors[open_, w, None]
                inside = fits & (scores <= ceilings[open_, w, None]) & ((scores > floor) | ((scores == floor) & (ids <= last[open_, w, None])))
                q, c = np.nonzero(inside)
                if not len(q):
                    continue
                q, s, i = (np.concatenate(z) for z in zip(held[w], (open_[q], scores[q, c], ids[c]), strict=True))
                order = np.lexsort((i, -s, q))
                q, s, i = q[order], s[order], i[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                first, kth = rank < self.k, rank == self.k - 1
                held[w] = (q[first], s[first], i[first])
                floors[q[kth], w], last[q[kth], w] = s[kth], i[kth]
        numbers = queries.column("a").to_numpy(zero_copy_only=False)
        q, s, i = (np.concatenate(z) for z in zip(*held, strict=True))
        w = np.repeat(np.arange(windows), [len(h[0]) for h in held])
        return pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(w, pa.int32()), pa.array(s), pa.array(i, mask=i == NO_ID)], schema=_FOUND)


def _products(x: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    if bound >= LARGE:
        raise ValueError("an inner product may be over 2^55")
    width = max(x.shape[1], y.shape[1])
    x, y = (z if z.shape[1] == width else np.pad(z, ((0, 0), (0, width - z.shape[1]))) for z in (x, y))
    if bound < EXACT:  # all partial sums are whole numbers that a double holds
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return x @ y.T


def _wave(buckets: DataFrame, queries: DataFrame, groups: list[tuple[int, float]], shards: int, k: int, same: bool) -> DataFrame:
    spark = buckets.sparkSession
    shard = F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard")
    asked = _dealt(queries, groups).select("group", shard, F.lit(1).alias("tag"), F.lit(0).cast("long").alias("bucket"), *QUERY)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    first, last = groups[0][0], groups[-1][0]
    held = buckets.where(F.col("group").between(first, last)).select("*", copies).withColumn("tag", F.lit(0))
    both = held.unionByName(asked, allowMissingColumns=True)
    parts = max(shuffle_partitions(spark), len(groups) * shards)
    dealt = both.repartition(parts, "group", "shard").sortWithinPartitions("group", "shard", "tag", "bucket")
    return dealt.mapInArrow(_Search(k, same), FOUND)


def best(buckets: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(a, w, rank, score, vec_id): of each window w of the queries (QUERY) the k best rows, ranks from 1.

    ``floors`` and ``ceilings`` of a query bound the scores of its windows, inclusively.
    """
    tops = buckets.groupBy("group").agg(F.max("top").alias("top")).orderBy("group").collect()  # one number a group
    groups = [(r.group, r.top) for r in tops]
    order = Window.partitionBy("a", "w").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not groups:
        return ranked(buckets.sparkSession.createDataFrame([], FOUND))
    shards = queries.count() // SHARD + 1
    found = saved(_wave(buckets, queries, groups[:1], shards, k, same), "found")
    if groups[1:]:
        kth = found.groupBy("a", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        kth = kth.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
        raised = F.transform("floors", lambda f, w: F.greatest(f, F.coalesce(F.try_element_at("kth", w), f)))
        closer = queries.join(kth, "a", "left").withColumn("floors", F.when(F.col("kth").isNull(), F.col("floors")).otherwise(raised))
        found = found.unionByName(_wave(buckets, closer, groups[1:], shards, k, same))
    return ranked(found)


def hard_negatives(
    rows: DataFrame, anchors: F.Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) for rows
    (vec_id, embedding, label): for each anchor and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of other labels whose score is from low to high percent of
    the positive's."""
    items = whole_vectors(rows.where(F.col("label").isNotNull()), scale)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    kept = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", F.sqrt(squares).alias("norm")]
    items = saved(items.select(*kept, F.coalesce(anchors, F.lit(False)).alias("is_anchor")), "vectors")
    buckets = norm_buckets(items)
    asked = items.where("is_anchor").select(F.monotonically_increasing_id().alias("a"), F.col("vec_id").alias("anchor_id"), "label", "norm", "vector")
    asked = saved(asked, "anchors")
    free = lambda bound: F.array(F.lit(bound).cast("long"))
    near = saved(best(buckets, asked.withColumns({"floors": free(-MOST), "ceilings": free(MOST)}), positives, True), "positives")
    windows = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))  # at most ``positives`` rows
    share = lambda score, percent, more: F.call_function("div", score * percent + more, F.lit(100))
    lowest = lambda p: F.when(p["score"] >= 0, share(p["score"], low, 99)).otherwise(F.lit(MOST))
    limits = {"floors": F.transform("p", lowest), "ceilings": F.transform("p", lambda p: share(p["score"], high, 0))}
    far = best(buckets, asked.join(windows, "a").withColumns(limits).drop("p"), negatives, False)
    far = far.select("a", (F.col("w") + 1).alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("a", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = far.join(near, ["a", "positive_rank"]).join(asked.select("a", "anchor_id"), "a")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0).drop("positive_rank")


OP12_SQL = """with v as materialized (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
        from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as materialized (
        select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::bigint as score
        from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id
    ), p as (
        select anchor_id, vec_id as positive_id, score as positive_score from s where same
        qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
    )
    select p.anchor_id, positive_id, (row_number() over w)::int as "rank", vec_id as negative_id, positive_score, score as negative_score
    from p join s on s.anchor_id = p.anchor_id and not same and 100 * score between 80 * positive_score and 100 * positive_score
    window w as (partition by p.anchor_id, positive_id order by score desc, vec_id) qualify row_number() over w <= 5"""
