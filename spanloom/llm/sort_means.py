"""Centroid clustering by sort-means: k-means that leaves out distances it can bound.

In each round every centroid has the others in order of their distance from it.  A vector
starts from the centroid it was assigned to before, at distance r, and looks at the others in
that order; those strictly farther than 2 r from the old centroid can't be nearer to the
vector, nor as near, so the scan stops there and the result is that of a full search.

A round is one pass over the vectors, which stay where they are: tasks add up the vectors of
each cluster, and only k sums go to the driver.  The vectors with their last assignment are
persisted from one round to the next; a lost part is computed again from the written table.

Cases: null vectors, vectors with null or non-finite components and those of other lengths are
left out; vectors without an id take part (their hash is that of the word ``null``); repeated rows count
each; of equal hashes at the start the smaller vector comes first; with fewer vectors than clusters there are
fewer clusters; equal centroids share nothing, the smaller number takes all; an empty table
gives no rows; other columns are ignored.  Components are at most 2^26 when scaled, else the job
fails.  Texts play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved
from .vectors import matrix, whole_vectors

POINTS = "vec_id long, vector array<long>, cluster int, distance long, looked long"
SUMS = "cluster int, n long, total array<long>"
_POINTS = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("looked", pa.int64())])
_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def reassign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number), its squared distance, and the
    number of distances that were computed for the row."""
    cluster, distance, looked = before.copy(), np.empty(len(x), np.int64), np.ones(len(x), np.int64)
    for old in np.unique(before):
        between = ((centroids - centroids[old]) ** 2).sum(1)
        rows = np.flatnonzero(before == old)
        own = ((x[rows] - centroids[old]) ** 2).sum(1)
        distance[rows] = own
        for other in np.argsort(between, kind="stable"):
            if other == old:
                continue
            near = between[other] <= 4 * own  # squares: not beyond twice the distance
            rows, own = rows[near], own[near]
            if not len(rows):
                break
            looked[rows] += 1
            d = ((x[rows] - centroids[other]) ** 2).sum(1)
            better = (d < distance[rows]) | ((d == distance[rows]) & (other < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = other, d[better]
    return cluster, distance, looked


def _assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column("cluster").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("vector"), centroids.shape[1])
            cluster, distance, looked = reassign(x, before, centroids)
            columns = [batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(looked)]
            yield pa.RecordBatch.from_arrays(columns, schema=_POINTS)

    return points.mapInArrow(work, POINTS)


def _sums(points: DataFrame, k: int, dims: int) -> DataFrame:
    """(cluster, place, n, total) of all vectors, added up in the tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("vector"), dims)
            for c in np.unique(cluster):
                own = x[cluster == c]
                n[c] += len(own)
                total[c] += own.sum(0)
        there = np.flatnonzero(n)
        columns = [pa.array(there, pa.int32()), pa.array(n[there]), pa.array(total[there].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=_SUMS)

    parts = points.select("cluster", "vector").mapInArrow(work, SUMS)
    each = parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
    return each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))


def clusters(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dims: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, looked); ``looked`` is the
    number of distances that the last round computed for the vector."""
    spark = rows.sparkSession
    points = saved(whole_vectors(rows, scale, dims).select(F.col("vec_id").cast("long").alias("vec_id"), "vector"), "vectors")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = points.withColumn("hash", F.sha2(name, 256)).orderBy("hash", "vector").limit(k).select("vector").collect()  # k rows
    centroids = np.array([r.vector for r in first], np.int64).reshape(len(first), dims)
    nowhere = F.lit(0).cast("long")
    state = points.select("vec_id", "vector", F.lit(0).alias("cluster"), nowhere.alias("distance"), nowhere.alias("looked"))
    if not len(centroids):
        return _result(state, spark, centroids)
    held = None
    for _ in range(rounds):
        state = _assigned(state, centroids).persist(StorageLevel.MEMORY_AND_DISK)
        for r in _sums(state, len(centroids), dims).collect():  # k * dims rows
            centroids[r.cluster, r.place] = int(r.total) // r.n
        if held is not None:
            held.unpersist()
        held = state
    last = saved(_assigned(state, centroids).drop("vector"), "clusters")
    if held is not None:
        held.unpersist()
    return _result(last, spark, centroids)


def _result(last: DataFrame, spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    inertia = {r.cluster: r.total for r in last.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(i, inertia.get(i, 0), sum(inertia.values()), digest(c)) for i, c in enumerate(centroids)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = last.join(F.broadcast(about), "cluster")  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "looked")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds, with their inertia and final centroids."""
    found = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    """Assignment a<i> of all vectors to centroids c<i>, and the next centroids."""
    return f""", a{i} as materialized (
        select vec_id, n, arg_min(cluster, d * 8 + cluster) as cluster, min(d) as distance from (
            select p.vec_id, p.n, c.cluster, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
            from p cross join c{i} c) group by vec_id, n
    ), c{i + 1} as materialized (
        select cluster, coalesce(m.v, c.v) as v from c{i} c left join (
            select cluster, list(f order by place) as v from (
                select cluster, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as f from (
                    select a.cluster, unnest(p.v) as x, generate_subscripts(p.v, 1) as place from a{i} a join p using (n)) group by cluster, place) group by cluster) m using (cluster)
    )"""


OP13_SQL = f"""with p as materialized (
        select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
        where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
    ), c0 as materialized (
        select (row_number() over (order by sha256('3:' || vec_id)) - 1)::int as cluster, v from p order by sha256('3:' || vec_id) limit 8
    ){"".join(map(_round_sql, range(11)))}
    select vec_id, a.cluster, distance, (sum(distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
        sha256(array_to_string(c.v, ',')) as centroid_sha256
    from a10 a join c10 c using (cluster)"""
