"""Quartile bucket digests: locality-sensitive document fingerprints.

A window of five bytes slides over the UTF-8 text.  Six of its byte triplets,
each with a salt of its own, are hashed to one of 256 buckets and counted.  The
digest holds, for each bucket, the quartile of its count (two bits), and in
front the length on a logarithmic scale and the two ratios of the quartile
bounds.  Digests of texts that share content agree in most buckets.

The difference of two digests adds the quartile distances of the buckets, a
distance of three counting as six, and the bounded differences of the header
fields.  Likeness is one minus the difference over ``FAR``, the difference
beyond which texts count as wholly unlike; it lies between 0 and 1.

Cases: a null or empty text, and any text under three bytes, has a digest of no
counts; equal texts have equal digests; rows with the same doc_id follow each
other in the order of their texts; a null doc_id comes first; a single document
is its own next one; an empty table gives no rows; other columns are ignored; a very
long text is digested whole, in the memory of one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, shuffle_partitions, text_of

BUCKETS = 256
#: (places in the window after its first byte, salt) of each triplet.
TRIPLETS = (((1, 2), 2), ((1, 3), 3), ((2, 3), 5), ((2, 4), 7), ((1, 4), 11), ((3, 4), 13))
#: A difference of this size or more is no likeness at all.
FAR = 384
#: A permutation of the bytes, for hashing by table lookups.
MIX = np.random.default_rng(1).permutation(256).astype(np.uint8)
#: FIRST[salt][a << 8 | b] is the hash state after two bytes.
FIRST = {
    salt: MIX[(MIX[MIX[salt] ^ np.arange(256, dtype=np.uint8)])[:, None] ^ np.arange(256, dtype=np.uint8)].reshape(-1)
    for _, salt in TRIPLETS
}


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets; in the last windows of a text only those that fit."""
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    high = b.astype(np.uint16) << 8
    for (second, third), salt in TRIPLETS:
        n = len(b) - third
        if n > 0:
            pairs = high[:n] | b[second : second + n]
            hashed = MIX[FIRST[salt][pairs] ^ b[third : third + n]]
            counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """Hexadecimal digest of 66 bytes: length, quartile ratios, 256 quartile codes."""
    data = text.encode()
    counts = bucket_counts(data)
    low, middle, high = np.sort(counts)[[63, 127, 191]]
    codes = (counts > low).astype(np.uint8) + (counts > middle) + (counts > high)
    four = codes.reshape(-1, 4)
    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    size = min(255, int(8 * np.log2(len(data) + 1)))
    ratios = 0
    if high:
        ratios = int(15 * low / high) << 4 | int(15 * middle / high)
    return bytes([size, ratios]).hex() + packed.tobytes().hex()


#: DISTANCE[a, b]: summed distance of the four codes in two packed bytes.
_CODES = np.stack([(np.arange(256) >> s) & 3 for s in (6, 4, 2, 0)], 1)
DISTANCE = np.array([0, 1, 2, 6])[abs(_CODES[:, None] - _CODES[None])].sum(2).astype(np.int64)


def difference(left: str, right: str) -> int:
    """Difference of two digests, from 0 to FAR."""
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (left, right))
    head = min(24, max(0, abs(int(a[0]) - int(b[0])) - 1) * 2)
    for shift in (4, 0):
        head += min(6, abs((int(a[1]) >> shift & 15) - (int(b[1]) >> shift & 15)))
    return min(FAR, head + int(DISTANCE[a[2:], b[2:]].sum()))


def likeness(left: str, right: str) -> float:
    return 1 - difference(left, right) / FAR


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every document; no shuffle."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in found:
            yield doc_id, len(text), digest(text)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(columns, rows, "doc_id long, n_chars long, fingerprint string")


def in_doc_order(docs: DataFrame) -> DataFrame:
    """(slot, copy, doc_id, text): neighbours by doc_id meet in one slot.

    Slots are ranges of doc_id between quantiles.  The first document of each
    slot is also sent, as a copy, to the end of the slot before (of the first
    slot: to the end of the last), so a slot needs nothing from elsewhere.  Only
    the slots' bounds and first ids, a few per shuffle partition, pass the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    slots = 4 * shuffle_partitions(docs.sparkSession)
    probabilities = [i / slots for i in range(1, slots)]
    bounds = np.unique(ids.approxQuantile("key", probabilities, 0.1 / slots)).astype(np.int64)

    def slot_of(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, keys, side="right")

    @F.pandas_udf("long")
    def slot(keys: pd.Series) -> pd.Series:
        return pd.Series(slot_of(keys.to_numpy(np.int64)))

    heads = ids.groupBy(slot("key").alias("slot")).agg(F.min("key").alias("head")).collect()
    heads = sorted((r["slot"], r["head"]) for r in heads)
    first = np.array([h for _, h in heads], np.int64)
    before = np.roll(np.array([s for s, _ in heads], np.int64), 1)

    @F.pandas_udf("array<long>")
    def places(keys: pd.Series) -> pd.Series:
        """The slot, and for a first document the slot that gets its copy."""
        keys = keys.to_numpy(np.int64)
        at = np.searchsorted(first, keys)
        head = (at < len(first)) & (first[np.minimum(at, len(first) - 1)] == keys)
        return pd.Series(
            [
                [s, before[i]] if h else [s]
                for s, h, i in zip(slot_of(keys), head, at, strict=True)
            ]
        )

    # long doc_ids lose precision in a quantile sketch; any bounds give right results
    return (
        docs.select("*", F.posexplode(places(key)).alias("copy", "slot"))
        .repartition("slot")
        .sortWithinPartitions("slot", "copy", "doc_id", "text")
    )


EDITS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the start of the
    next document's, and their likenesses."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for slot, copy, doc_id, text in found:
            if last and last[:2] == (slot, 1):
                continue  # a copy with the same doc_id as the one before it
            own = digest(text)
            if last and last[0] == slot:
                _, _, its_id, its_text, its_own = last
                half = len(its_text) // 2
                edited = its_text[: len(its_text) - half] + text[:half]
                changed = digest(edited)
                yield (
                    its_id,
                    len(its_text),
                    hashlib.sha256(edited.encode()).hexdigest(),
                    its_own,
                    changed,
                    likeness(its_own, changed),
                    likeness(its_own, own),
                )
            last = (slot, copy, doc_id, text, own)

    ordered = in_doc_order(docs).select("slot", "copy", "doc_id", "text")
    return map_rows(ordered, rows, EDITS)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
