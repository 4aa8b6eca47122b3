"""MinHash near-duplicate detection with sequential Bayesian verification.

A document's set holds its distinct five-word shingles.  Sets that are equal are
represented by one document, so exact copies cost one comparison in all.  Bands
of the MinHash signature give candidate pairs, in two rounds that never list all
pairs of a bucket:

1. Every member of a bucket is paired with the bucket's hub, the member that is
   first in one order for all bands.  Verified links join most groups at once.
2. Members that are still in different components of the verified links are
   compared, within buckets that hold more than one component: each member
   outside the bucket's largest component with the members of the other
   components.  Members of one component need no more pairs.  Large buckets are
   compared in blocks of signatures.  A block's survivors become one row for each member,
   with its partners as a list, so that its text meets theirs once.  Where buckets are dense, each block first gives a spanning forest of its
   members, best matches first; its verified links are taken together, and only what
   then is still in different components is compared in full.

A pair is verified step by step: batches of signature rows are compared, and it
is dropped once the posterior probability of a similarity at the threshold or
above, given the matches so far, falls under the miss probability.  Survivors
are verified exactly, on their full sets, which are made anew from the texts:
texts are smaller than sets.  Only texts that share a band with another set are
kept for that, after one shuffle of all texts.

Components come from iterated minimum labels over the verified links, by joins;
nothing is collected.

Cases: a null or empty text, or one without words, has an empty set and is linked
with nothing; a text of fewer than five words is one shingle; a very long text is one
row, whose shingles take eight bytes each; repeated rows with the same doc_id share
their component.  A row without doc_id is linked like any other; the component_id is
the smallest doc_id that isn't null, or null without one.  Such a row stays if its
component has no doc_id and its set is the component's root, or if its set is empty.
An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from .common import documents, map_rows, saved, spread_join, text_of
from .tokens import Memo

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, BAND_ROWS = 36, 5
HASHES = BANDS * BAND_ROWS
#: Signature rows compared at a time, and the probability of dropping a true link.
BATCH, MISS = 36, 1e-5
#: Members of a block in the second round, on average.
BLOCK = 256
#: Pairs to compare for each set from which on buckets count as dense.
DENSE = 10_000
#: Hubs that share the texts of their members.
HUBS = 16
#: Shingles of the sets that a task of the second round holds at a time, but for the last one.
HELD = 1_000_000
_LOWER = bytes(range(256)).translate(
    bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
)
_rng = np.random.default_rng(20240229)
_POSITION = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest, 100_000, "near_dedup")


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, found), np.uint64, len(found))
    n = max(1, len(hashes) - words + 1)
    used = min(words, len(hashes))
    out = np.full(n, np.uint64(used))
    for i in range(used):
        out += hashes[i : i + n] * _POSITION[i]
    return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash signature of a non-empty set of shingle hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):  # keeps the table of products small
        part = _MULTIPLY[:, None] * x[None, at : at + 1024]
        part += _ADD[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def short(sig: np.ndarray) -> np.ndarray:
    """The low halves of a signature's rows; they find every match of whole rows."""
    return sig.astype(np.uint16)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, for rows of short signatures."""
    bands = sigs.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for i in range(BAND_ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key.view(np.int64)


@lru_cache(maxsize=4)
def least_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> tuple[int, ...]:
    """For each number of batches compared, the matches with which a pair may still be a link.

    The prior of the similarity is uniform; the posterior after m matches in n
    rows is Beta(m + 1, n - m + 1), whose tail above the threshold is a binomial
    sum: P(s > t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


SETS = "doc_id long, text_key long, n_shingles long, set_key long, sig binary"


def _described(text: str) -> tuple[int, int | None, bytes | None]:
    """(set size, set key, short signature) of a text."""
    found = shingles(text)
    if not len(found):
        return 0, None, None
    key = xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)
    return len(found), key, short(signature(found)).tobytes()


def document_sets(docs: DataFrame) -> DataFrame:
    """Each document's text hash, set size, set key and short signature; no shuffle."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text_key, text in found:
            yield doc_id, text_key, *_described(text)

    return map_rows(_keyed(docs), rows, SETS)


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


@F.pandas_udf(ArrayType(LongType()))
def bands_of(sigs: pd.Series) -> pd.Series:
    table = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), HASHES)
    return pd.Series(list(band_keys(table)))


@F.pandas_udf(BooleanType())
def may_link(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two signatures survive the sequential test."""
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), HASHES)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), HASHES)
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches()):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return pd.Series(out)


def shared_buckets(table: DataFrame) -> DataFrame:
    """(set_key, number, band) of the bands that different sets share."""
    each = table.where("set_key is not null").select(
        "set_key", F.posexplode(bands_of("sig")).alias("number", "band")
    )
    found = saved(each.groupBy("band").count().where("count > 1").select("band"), "bands")
    rows = saved(each.join(found, "band").distinct(), "buckets")  # without copies
    found = rows.groupBy("band").count().where("count > 1").select("band")
    return rows.join(found, "band").select("set_key", "number", "band")


def candidate_sets(docs: DataFrame, table: DataFrame, buckets: DataFrame) -> DataFrame:
    """set_key, n_shingles, sig and a text of every set that shares a band."""
    place = ["place", "text_key"]  # of a row; text_key stands in where doc_id is null
    first = F.min(F.struct(F.coalesce("doc_id", "text_key").alias("place"), "text_key")).alias("r")
    first = table.where("set_key is not null").groupBy("set_key").agg(first)
    wanted = first.join(buckets.select("set_key").distinct(), "set_key").select("set_key", "r.*")

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for set_key, text in found:
            size, key, sig = _described(text)
            if key == set_key:  # else it is another text with the same place
                yield key, size, sig, text

    texts = _keyed(docs).select(F.coalesce("doc_id", "text_key").alias("place"), "text_key", "text")
    joined = texts.join(wanted, place).select("set_key", "text")
    schema = "set_key long, n_shingles long, sig binary, text string"
    return map_rows(joined, rows, schema).dropDuplicates(["set_key"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, member) of set keys that are links, as (a, b) with a < b."""
    sigs = sets.select("set_key", "sig", "n_shingles")
    found = (
        pairs.join(sigs.toDF("hub", "sig_a", "n_a"), "hub")
        .join(sigs.toDF("member", "sig_b", "n_b"), "member")
        .where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
        .where(may_link("sig_a", "sig_b"))
        .select("hub", "member")
    )
    return confirmed(saved(found, "survivors"), sets)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The saved pairs (hub, member) that are links on their full sets, as (a, b) with a < b.

    A group of about HUBS hubs gets each of its members' texts once.  Groups with many pairs
    are cut by member, and the hubs' texts go to each part.
    """
    groups = -(-pairs.select("hub").distinct().count() // HUBS) or 1
    dealt = pairs.withColumn("group", F.pmod(F.xxhash64("hub"), F.lit(groups)))
    sizes = saved(dealt.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "groups")
    parts = sizes.select("group", F.ceil(F.col("n") / (BLOCK * HUBS)).alias("parts"))
    dealt = spread_join(dealt, parts, ["group"], sizes)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("member"), "parts"))
    members = dealt.groupBy("group", "part", F.col("member").alias("set_key")).agg(F.collect_list("hub").alias("hubs"))
    hubs = dealt.select("group", "part", F.col("hub").alias("set_key")).distinct()
    return _met(hubs.withColumn("hubs", F.lit(None).cast("array<long>")).unionByName(members), ["group", "part"], sets)


def _met(rows: DataFrame, place: list[str], sets: DataFrame) -> DataFrame:
    """Links (a, b) of the rows (place, set_key, hubs), whose texts meet at a place.

    hubs: the set keys of a member's partners at its place; null for a hub.
    """
    together = rows.join(sets.select("set_key", "text"), "set_key").select(*place, "set_key", "hubs", "text")
    together = together.repartition(*place).sortWithinPartitions(*place, F.col("hubs").isNotNull())

    def links(found: Iterator[tuple]) -> Iterator[tuple]:
        own, last = {}, None
        for *at, key, wanted, text in found:
            if at != last:
                own, last = {}, at
            its = shingles(text)
            if wanted is None:
                own[key] = its
                continue
            for hub in wanted:
                if _linked(own[hub], its):
                    yield min(hub, key), max(hub, key)

    return map_rows(together, links, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are a link."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: the smallest node that it can reach.

    Alternating star contraction: neighbours of a node are moved to its smallest
    neighbour until every link points to a root.  Each round halves the
    distances at least; a round's links are a saved table.
    """
    links = saved(links.select("a", "b").distinct(), "links")
    before = None
    while (now := _checksum(links)) != before:
        before = now
        # large star: the larger neighbours of a node point to the smallest node around it
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), "m").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("m").alias("least"))
        small = large.join(least, "a").where("m <> least").select(F.col("m").alias("a"), "least")
        stars = small.union(least).select(F.col("least").alias("a"), F.col("a").alias("b"))
        links = saved(stars.distinct(), "links")
    # each link now is (root, node)
    nodes = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _checksum(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))
    return tuple(links.agg(F.count(F.lit(1)), total).first())


def first_pairs(buckets: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's hub."""
    hub = F.min(F.struct(F.xxhash64("set_key").alias("order"), F.col("set_key").alias("hub")))
    hubs = buckets.groupBy("band").agg(hub.alias("h"))
    return (
        buckets.join(hubs.select("band", "h.hub"), "band")
        .where("set_key <> hub")
        .select("hub", F.col("set_key").alias("member"))
        .distinct()
    )


def second_links(buckets: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a bucket that are in different components."""
    links = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    mixed = saved(mixed_buckets(buckets, roots), "mixed")
    if (mixed.agg(F.sum(F.expr("n * few"))).first()[0] or 0) > DENSE * sets.count():
        forest = saved(cross_pairs(buckets, roots, mixed, sets, forest=True), "forest")
        links = saved(links.union(_met(forest, PLACE, sets)), "links")
        roots = saved(components(links), "roots")
        mixed = saved(mixed_buckets(buckets, roots), "mixed")
    return links.union(_met(saved(cross_pairs(buckets, roots, mixed, sets), "survivors"), PLACE, sets))


def labelled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    found = buckets.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    return found.withColumn("root", F.coalesce("root", "set_key"))


def mixed_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets of several components: the largest one, all members and those outside of it."""
    parts = labelled(buckets, roots).groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    return (
        parts.groupBy("band")
        .agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("band", F.col("m.root").alias("largest"), "n", (F.col("n") - F.col("m.n")).alias("few"))
    )


#: A block of a bucket, and a part of it whose hubs have about HELD shingles.
PLACE = ["band", "i", "j", "part"]
SURVIVORS = "band long, i long, j long, part long, set_key long, hubs array<long>"


def cross_pairs(buckets: DataFrame, roots: DataFrame, mixed: DataFrame, sets: DataFrame, *, forest: bool = False) -> DataFrame:
    """Pairs of a bucket's members in different components that survive the test, by PLACE.

    A row for each hub, and one for each member with its hubs.

    At least one of the two is outside the bucket's largest component.  Buckets
    are compared in blocks: a member meets the others through copies of its signature,
    one for each block, and pairs exist only inside a task's arrays.  A pair is
    looked at in the first band that it shares.  forest: only those that join the
    components of a block, best matches first.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    mixed = mixed.select("band", "largest", blocks("n").alias("all_blocks"), blocks("few").alias("few_blocks"))
    members = labelled(buckets, roots).join(mixed, "band").join(sets.select("set_key", "n_shingles", "sig"), "set_key")
    row = ["band", "number", "set_key", "root", "largest", "n_shingles", "sig"]
    own = F.pmod(F.xxhash64("set_key"), "all_blocks")
    left = members.select(
        *row, F.lit(0).alias("side"), own.alias("i"), F.explode(F.expr("sequence(0, few_blocks - 1)")).alias("j")
    )
    own = F.pmod(F.xxhash64("set_key", F.lit(1)), "few_blocks")
    right = members.where("root <> largest").select(
        *row, F.lit(1).alias("side"), F.explode(F.expr("sequence(0, all_blocks - 1)")).alias("i"), own.alias("j")
    )
    blocks = left.union(right.select(left.columns)).repartition("band", "i", "j")
    return blocks.sortWithinPartitions("band", "i", "j", "side").mapInArrow(partial(_block_pairs, forest), SURVIVORS)


def _block_pairs(forest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SURVIVORS of each block (band, i, j) of rows sorted by block and side."""

    def pairs_of(held: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        found = _compared(held)
        if forest:
            found = _forest(found)
        if len(found):
            yield _by_member(key, found)

    held, key = [], None
    for batch in batches:
        table = batch.to_pandas()
        keys = table[["band", "i", "j"]].to_numpy(np.int64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for part in np.split(np.arange(len(table)), cuts) if len(table) else []:
            if held and tuple(keys[part[0]]) != key:
                yield from pairs_of(held)
                held = []
            key = tuple(keys[part[0]])
            held.append(table.iloc[part])
    if held:
        yield from pairs_of(held)


def _by_member(block: tuple[int, int, int], found: np.ndarray) -> pa.RecordBatch:
    """A block's pairs as SURVIVORS."""
    hubs, first, which = np.unique(found[:, 0], return_index=True, return_inverse=True)
    hub_part = (np.cumsum(found[first, 5]) - found[first, 5]) // HELD
    part, member = hub_part[which], found[:, 1]
    order = np.lexsort((member, part))
    part, member = part[order], member[order]
    new = np.ones(len(order), bool)
    new[1:] = (part[1:] != part[:-1]) | (member[1:] != member[:-1])
    starts = np.flatnonzero(new)
    partners = pa.ListArray.from_arrays(np.append(starts, len(order)).astype(np.int32), pa.array(found[order, 0]))
    n = len(hubs) + len(starts)
    columns = [np.full(n, v) for v in block] + [np.append(hub_part, part[starts]), np.append(hubs, member[starts])]
    lists = pa.concat_arrays([pa.nulls(len(hubs), partners.type), partners])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=[*PLACE, "set_key", "hubs"])


def _forest(found: np.ndarray) -> np.ndarray:
    """The pairs that join components, best matches first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    chosen = []
    order = np.argsort(-found[:, 4], kind="stable")
    for at, (a, b) in zip(order.tolist(), found[order, 2:4].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            chosen.append(at)
    return found[chosen]


def _compared(held: list[pd.DataFrame]) -> np.ndarray:
    """Surviving pairs of a block: rows of two set keys, their two roots, the matches and the first set's size."""
    block = held[0] if len(held) == 1 else pd.concat(held)
    side = block["side"].to_numpy()
    few = np.flatnonzero(side == 1)
    rest = np.flatnonzero(side == 0)
    out = [np.zeros((0, 6), np.int64)]
    key, root = (block[c].to_numpy(np.int64) for c in ("set_key", "root"))
    largest, number = block["largest"].iloc[0], block["number"].iloc[0]
    size = block["n_shingles"].to_numpy(np.int64)
    sig = np.frombuffer(b"".join(block["sig"]), np.uint16).reshape(len(block), HASHES)
    for x in few:
        y = rest[(root[rest] != root[x]) & ((root[rest] == largest) | (key[rest] < key[x]))]
        y = y[100 * np.minimum(size[y], size[x]) >= PERCENT * np.maximum(size[y], size[x])]
        same = sig[y] == sig[x]
        first = same.reshape(-1, BANDS, BAND_ROWS).all(axis=2).argmax(axis=1)
        y, same = y[first == number], same[first == number]
        matches = np.zeros(len(y), np.int64)
        for i, least in enumerate(least_matches()):
            matches += same[:, i * BATCH : (i + 1) * BATCH].sum(axis=1)
            stay = matches >= least
            y, matches, same = y[stay], matches[stay], same[stay]
        if len(y):
            own = [np.full(len(y), v) for v in (key[x], root[x], size[x])]
            out.append(np.stack([own[0], key[y], own[1], root[y], matches, own[2]], axis=1))
    return np.concatenate(out)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _decided(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame) -> DataFrame:
    table = saved(document_sets(docs), "sets")
    buckets = saved(shared_buckets(table), "buckets")
    sets = saved(candidate_sets(docs, table, buckets), "candidates")
    links = saved(verified(first_pairs(buckets), sets), "links")
    roots = saved(components(links), "roots")
    roots = saved(components(second_links(buckets, roots, sets)), "roots")
    # sets first, rows then: copies are joined once
    own = table.where("set_key is not null").groupBy("set_key")
    own = saved(own.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "own-sets")
    own = own.join(roots.toDF("set_key", "root"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    own = saved(own, "own-sets")
    least = own.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    least = saved(least, "components")
    named = spread_join(own.select("set_key", "root", "n"), least.select("root", "component_id"), ["root"], least)
    named = saved(named, "named-sets")
    rows = table.select("doc_id", "text_key", "n_shingles", "set_key")
    rows = spread_join(rows, named.drop("n"), ["set_key"], named, "left")
    # rows with the same doc_id share the smallest component
    shared = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("shared"))
    return (
        rows.join(shared, "doc_id", "left")
        .withColumn("component_id", F.coalesce("shared", "component_id", "doc_id"))
        .withColumn(
            "kept",
            F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("component_id")).otherwise(
                F.col("component_id").isNull() & (F.col("set_key").isNull() | (F.col("set_key") == F.col("root")))
            ),
        )
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = _decided(docs).where("not kept")
    named = gone.where("doc_id is not null").select(F.col("doc_id").alias("__sl_id")).distinct()
    unnamed = gone.where("doc_id is null").select(F.col("text_key").alias("__sl_text")).distinct()
    with_id = docs.where(F.col("doc_id").isNotNull()).join(named, F.col("doc_id").cast("long") == F.col("__sl_id"), "left_anti")
    without = docs.where(F.col("doc_id").isNull()).join(unnamed, F.xxhash64(text_of()) == F.col("__sl_text"), "left_anti")
    return with_id.unionByName(without).select(*docs.columns)
