"""Removal of repeated byte strings with sharded suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else in
the corpus goes.  Strings are judged on the input; matches never cross documents.

1. Anchors.  Each window of LENGTH bytes is represented by its smallest K-gram
   hash, the leftmost of equal ones.  Equal windows have the same anchor, so only
   documents with an anchor that occurs twice can share a window.  The windows of
   one anchor form a range; anchor, range and 80 bits of a BLAKE2 hash of the range's
   bytes are one row, about one for each 80 bytes.
2. Whole ranges.  Where two occurrences have the same anchor and range hash, all
   their windows are repeated.  That settles the inside of repeated passages.
3. Edges.  Other ranges of a repeated anchor are cut out of the texts, one of each
   kind, and dealt by anchor into shards.  A shard's suffix array is built by
   induced sorting, and windows whose common prefix with a neighbour is LENGTH or
   more are repeated.  Bytes are compared there, not hashes.
4. Hot anchors.  The different ranges of an anchor with more than SHARE of them are
   dealt to several shards by their hashes.  Each builds its suffix array; one
   BLAKE2 hash of 128 bits for each of its kinds of windows then goes, dealt by hash,
   to where equal windows of different shards meet.

Cheap hashes only choose anchors; an error there costs time and no result.  Keys
that hold a thousandth of the rows or more are joined by broadcast (``spread_join``).
The texts are shuffled once: both joins use the same exchange.

Cases: a null or empty text, or one shorter than LENGTH, loses nothing; a very long
text is read in segments of SEGMENT window starts; rows are told apart by doc_id and
text (by the text's SHA-256 alone where doc_id is null), so identical rows lose the
same bytes; an empty table gives no rows; other columns, whatever their names, are
ignored by the digest and kept by ``without_repeats``, which drops code points that
lose a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, arrow_schema, documents, map_rows, saved, spread_join, text_of
from .near_dedup import _mix
from .suffix_arrays import hashes_of, permuted_prefixes, prefix_hashes, suffix_array

LENGTH = 200
#: Bytes of the hashed K-grams.
K = 40
#: K-grams in a window.
GRAMS = LENGTH - K + 1
#: Window starts that are handled at a time; bounds a task's memory for long texts.
SEGMENT = 1 << 20
#: Different ranges of an anchor that go to one shard; more are dealt to several.
SHARE = 512
#: Bytes after which a shard's suffix array is built.
SHARD_BYTES = 1_500_000

ANCHORS = "k1 long, k2 long, anchor long, range long, place long"


def _sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys, by prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_ranges(data: np.ndarray, start: int = 0) -> tuple[np.ndarray, ...]:
    """(anchor, range hash, place) of the ranges of a stretch of text that begins at ``start``.

    place: the first window start, 16 more bits of the range's hash, the bytes from
    the first window start to the anchor, and those to the last window start.
    """
    prefix = prefix_hashes(data)
    places = np.arange(len(data) - K + 1)
    grams = _mix(hashes_of(prefix, places, places + K))
    low = np.uint64((1 << 24) - 1)
    least = _sliding_argmin((grams & ~low) | places.astype(np.uint64), GRAMS)
    at = (least & low).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    hi = np.r_[lo[1:], len(at)] - 1
    at = at[lo]
    bytes_of, blake = data.tobytes(), hashlib.blake2b
    ends = (hi + LENGTH).tolist()
    digests = b"".join([blake(bytes_of[a:b], digest_size=10).digest() for a, b in zip(lo.tolist(), ends, strict=True)])
    digests = np.frombuffer(digests, "<u2").reshape(-1, 5)
    ranges = np.ascontiguousarray(digests[:, :4]).view("<i8")[:, 0]
    place = (lo + start) << 32 | digests[:, 4].astype(np.int64) << 16 | (at - lo) << 8 | (hi - lo)
    return grams[at].view(np.int64), ranges, place


def _key() -> tuple[F.Column, F.Column]:
    """A row's key.  First doc_id, or 60 bits of the text's hash in its place; then 60 other
    bits, negative where doc_id is null."""
    text, doc_id = text_of(), F.col("doc_id").cast("long")
    return (
        F.coalesce(doc_id, _bits(text, 16)),
        F.when(doc_id.isNull(), -1 - _bits(text, 1)).otherwise(_bits(text, 1)),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    k1, k2 = _key()
    return docs.select(k1.alias("k1"), k2.alias("k2"), text_of().alias("text"))


def _bits(text: F.Column, first: int) -> F.Column:
    """Fifteen hexadecimal digits of a text's SHA-256; never null, so that both joins read the
    texts through the same plan."""
    return F.coalesce(F.conv(F.substring(F.sha2(text, 256), first, 15), 16, 10).cast("long"), F.lit(0))


def anchors(docs: DataFrame) -> DataFrame:
    """A row for each anchor of each document; no shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ANCHORS)
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            columns = (np.concatenate(c) for c in zip(*held, strict=True))
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        parts = (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))
        for part in parts:
            for k1, k2, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                whole = np.frombuffer(text.encode(), np.uint8)
                for start in range(0, len(whole) - LENGTH + 1, SEGMENT):
                    found = anchor_ranges(whole[start : start + SEGMENT + LENGTH - 1], start)
                    n = len(found[0])
                    held.append([np.full(n, k1, np.int64), np.full(n, k2, np.int64), *found])
                    size += n
                if size > 20_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return _keyed(docs).mapInArrow(rows, ANCHORS)


WANTED = "struct(place, anchor, salt, salts)"
CUT = "k1 long, k2 long, lo long, anchor long, salt long, salts long, bytes binary"


def _cut(texts: DataFrame, fine: DataFrame) -> DataFrame:
    """The bytes of the wanted ranges; ``texts`` is the shuffled side that both joins share."""
    wanted = fine.groupBy("k1", "k2").agg(F.collect_list(F.expr(WANTED)).alias("wanted"))

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k1, k2, text, wanted in found:
            data = text.encode()
            for w in wanted:
                lo = w["place"] >> 32
                own = data[lo : lo + (w["place"] & 255) + LENGTH]
                yield k1, k2, lo, w["anchor"], w["salt"], w["salts"], own

    joined = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted")
    return map_rows(joined, rows, CUT)


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of sorted distinct starts."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.r_[0, cuts + 1]].tolist(), starts[np.r_[cuts, len(starts) - 1]].tolist(), strict=True))


FOUND = "k1 long, k2 long, lo long, hi long"


def _in_groups(found: Iterator[tuple], key) -> Iterator[list[tuple]]:
    """Lists of neighbouring rows with the same key."""
    held, last = [], None
    for row in found:
        if held and key(row) != last:
            yield held
            held = []
        last = key(row)
        held.append(row)
    if held:
        yield held


def shard_repeats(cut: DataFrame) -> DataFrame:
    """Repeated window starts, as runs, by a suffix array for each shard of whole anchors."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        held, size = [], 0
        for group in _in_groups(found, lambda r: r[3]):
            held += group
            size += sum(len(r[6]) for r in group)
            if size >= SHARD_BYTES:
                yield from _repeats_of(held)
                held, size = [], 0
        if held:
            yield from _repeats_of(held)

    return map_rows(cut.repartition("anchor").sortWithinPartitions("anchor"), rows, FOUND)


def _shard(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte of each range, whether a window starts there, its kind) of a shard.

    Windows are of one kind when their LENGTH bytes are equal; ranges are set apart by
    a byte that UTF-8 doesn't have, so a common prefix of LENGTH lies inside of ranges.
    """
    sizes = np.array([len(r[6]) for r in held])
    data = np.frombuffer(b"".join(r[6] + b"\xff" for r in held), np.uint8)
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    valid = np.zeros(len(data) + 1, np.int64)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + sizes - LENGTH + 1, -1)
    order = suffix_array(data)
    shared, _ = permuted_prefixes(data, order)
    kind = np.empty(len(data), np.int64)
    kind[order] = np.cumsum(shared[order] < LENGTH)
    return data, begin, np.cumsum(valid)[:-1] > 0, kind


def _repeated(valid: np.ndarray, kind: np.ndarray) -> np.ndarray:
    counts = np.bincount(kind[valid], minlength=int(kind.max()) + 1)
    return valid & (counts[kind] > 1)


def _runs_of(held: list[tuple], begin: np.ndarray, repeated: np.ndarray) -> Iterator[tuple]:
    for row, b in zip(held, begin.tolist(), strict=True):
        for lo, hi in _runs(np.flatnonzero(repeated[b : b + len(row[6])])):
            yield row[0], row[1], row[2] + lo, row[2] + hi


def _repeats_of(held: list[tuple]) -> Iterator[tuple]:
    _, begin, valid, kind = _shard(held)
    yield from _runs_of(held, begin, _repeated(valid, kind))


SENT = FOUND + ", anchor long, part long, hashes binary, docs binary, starts binary"


def hot_repeats(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For anchors with many different ranges: (runs settled in a shard, window starts that
    repeat in another shard)."""

    def first(found: Iterator[tuple]) -> Iterator[tuple]:
        for held in _in_groups(found, lambda r: (r[3], r[4])):
            for at in range(0, len(held), SHARE):  # a salt's ranges are SHARE on average
                yield from share(held[at : at + SHARE])

    def share(held: list[tuple]) -> Iterator[tuple]:
        data, begin, valid, kind = _shard(held)
        again = _repeated(valid, kind)
        for run in _runs_of(held, begin, again):
            yield *run, None, None, None, None, None
        # one hash for each kind that repeats here (no document), and each single window's
        at = np.flatnonzero(valid)
        _, first = np.unique(kind[at], return_index=True)
        at = at[first]
        owner = np.searchsorted(begin, at, side="right") - 1
        ids = np.array([r[:3] for r in held], np.int64)
        starts = np.where(again[at], -1, ids[owner, 2] + at - begin[owner])
        bytes_of, blake = data.tobytes(), hashlib.blake2b
        hashes = [blake(bytes_of[a : a + LENGTH], digest_size=16).digest() for a in at.tolist()]
        hashes = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
        part = (hashes[:, 0] % np.uint64(held[0][5])).astype(np.int64)
        for p in np.unique(part).tolist():
            own = part == p
            sent = hashes[own], ids[owner[own], :2], starts[own].astype(np.int64)
            yield None, None, None, None, held[0][3], p, *(x.tobytes() for x in sent)

    def second(found: Iterator[tuple]) -> Iterator[tuple]:
        for held in _in_groups(found, lambda r: r[:2]):
            hashes, docs, starts = (
                np.frombuffer(b"".join(x), kind)
                for x, kind in zip(list(zip(*held, strict=True))[2:], ("<u8", np.int64, np.int64), strict=True)
            )
            hashes, docs = hashes.reshape(-1, 2), docs.reshape(-1, 2)
            order = np.lexsort(hashes.T)
            new = np.r_[True, (hashes[order[1:]] != hashes[order[:-1]]).any(axis=1)]
            kind = np.cumsum(new) - 1
            for i in order[(np.bincount(kind)[kind] > 1) & (starts[order] >= 0)].tolist():
                yield int(docs[i, 0]), int(docs[i, 1]), int(starts[i]), int(starts[i])

    dealt = cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    sent = saved(map_rows(dealt, first, SENT), "hot-windows")
    local = sent.where("anchor is null").select(*(f.split()[0] for f in FOUND.split(", ")))
    others = sent.where("anchor is not null").select("anchor", "part", "hashes", "docs", "starts")
    others = others.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return local, map_rows(others, second, FOUND)


def repeated_starts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Row keys and runs (lo, hi) of the starts of repeated windows."""
    table = saved(anchors(docs), "anchors")
    # tables of their own, for the sizes by which hot keys are told apart
    repeated = saved(table.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    found = spread_join(table, repeated.select("anchor"), ["anchor"], repeated)
    found = saved(found.withColumn("more", F.expr("cast(shiftright(place, 16) & 65535 as int)")), "repeated-anchors")
    same = ["anchor", "range", "more"]
    first = F.min(F.struct("k1", "k2", "place")).alias("r")
    kinds = saved(found.groupBy(same).agg(F.count(F.lit(1)).alias("n"), first), "kinds")
    twice = kinds.where("n > 1").select(*same, "n")
    whole = spread_join(found, twice.select(*same), same, twice)
    lo = F.shiftright("place", 32)
    whole = whole.select("k1", "k2", lo.alias("lo"), (lo + F.expr("place & 255")).alias("hi"))
    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least"))
    sizes = saved(sizes.where("n > 1 and least = 1"), "edge-anchors")
    salts = F.ceil(F.col("kinds") / SHARE).cast("long")
    fine = spread_join(kinds.drop("n"), sizes.select("anchor", F.col("n").alias("kinds")), ["anchor"], sizes)
    fine = saved(
        fine.select(
            "r.*",
            "anchor",
            F.when(salts > 1, F.pmod("range", salts)).otherwise(0).alias("salt"),
            salts.alias("salts"),
        ),
        "edges",
    )
    out = whole.union(shard_repeats(_cut(texts, fine.where("salts = 1"))))
    hot = fine.where("salts > 1")
    if not hot.isEmpty():
        for part in hot_repeats(_cut(texts, hot)):
            out = out.union(part)
    return out


def _with_runs(docs: DataFrame) -> DataFrame:
    """Key, text and the runs of repeated window starts of every row."""
    texts = _keyed(docs)
    runs = repeated_starts(docs, texts)
    runs = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    return texts.join(runs, ["k1", "k2"], "left").select("k1", "k2", "text", "runs")


def removed_spans(runs) -> list[tuple[int, int]]:
    """Maximal removed byte spans [start, end) of runs of window starts."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + LENGTH) for r in runs or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(s) for s in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    starts = [*(s for s, _ in spans), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts, strict=True))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeat_digests(docs: DataFrame) -> DataFrame:
    """What each document loses, and the hash of what is left."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k1, k2, text, runs in found:
            data = text.encode()
            spans = removed_spans(runs)
            left = kept_bytes(data, spans)
            yield (
                None if k2 < 0 else k1,
                len(data),
                len(data) - len(left),
                len(spans),
                hashlib.sha256(left).hexdigest(),
            )

    return map_rows(_with_runs(docs), rows, DIGEST)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated strings removed, and n_chars counted anew.

    Code points that lose a byte go as a whole.  Documents of which nothing is
    left stay, with an empty text.
    """

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k1, k2, text, runs in found:
            yield k1, k2, kept_bytes(text.encode(), removed_spans(runs)).decode("utf-8", "ignore")

    own = ["__sl_k1", "__sl_k2", "__sl_left"]
    trimmed = map_rows(_with_runs(docs).where("runs is not null"), rows, ", ".join(f"{c} {t}" for c, t in zip(own, ("long", "long", "string"), strict=True)))
    trimmed = trimmed.dropDuplicates(own[:2])
    k1, k2 = _key()
    out = docs.withColumns({"__sl_k1": k1, "__sl_k2": k2}).join(trimmed, own[:2], "left")
    text = F.coalesce("__sl_left", "text")
    by_name = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return out.select(*(by_name.get(c, c) for c in docs.columns))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))
