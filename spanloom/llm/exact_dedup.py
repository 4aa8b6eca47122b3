"""Exact deduplication by two-pass Bloom filtering.

Texts are equal when they are identical without the characters of
``[\\x20\\x09-\\x0D]``.  The first pass hashes every text and sets cells of a
two-level Bloom filter: a cell of the second level is set when a cell of the
first one is met again.  A hash of which every second-level cell is set may
repeat; all others certainly don't, and their rows pass straight through
without a shuffle.  The second pass groups only the possible repeats, by the
full SHA-256, so the filter's errors cost time and never change the result.

The filter has a fixed upper size (``MAX_CELLS``); beyond that it lets more
unique rows take part in the second pass.

Groups are aggregated before they are joined back, so a text that makes up a
third of all rows moves as one row per task and group.  Groups that hold a
thousandth of the rows or more are joined back by broadcast, others by a shuffle.

Cases: a null text counts as empty; empty texts are equal to each other; of equal
rows the one with the most code points, then the smallest doc_id stays (null after
all others), then the one that is read first, so that exactly one stays; a very long
text is hashed as a whole, in the JVM; an empty table gives no rows; all columns beside
doc_id and text, whatever their names, pass through ``kept_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, saved, spread_join, text_of

#: [\x20\x09-\x0D]
SPACE = " \t\n\x0b\x0c\r"
HASHES = 3
CELLS_PER_ROW = 24
#: Cells of the filter at most: 8 MiB of bits a level, and 64 MiB of flags in a task.
MAX_CELLS = 1 << 26
#: Cells of a segment, the unit in which parts of the filter are merged.
SEGMENT = 1 << 19
#: Rows that one task of the first pass puts into its own copy of the filter.
ROWS_PER_FILTER = 4_000_000


def _sha() -> F.Column:
    return F.sha2(F.translate(text_of(), SPACE, ""), 256)


def _chars() -> F.Column:
    return F.length(text_of()).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of the text without white space, _chars and a row number."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _sha().alias("text_sha256"),
        _chars().alias("_chars"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _cells(hashes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Double hashing; ``cells`` is a power of two."""
    x = hashes.view(np.uint64)
    step = (x >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((x + np.uint64(i) * step) & np.uint64(cells - 1)).astype(np.int64)


def repeat_filter(hashes: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """(packed second-level bits, cells) of the filter over a one-column frame of long hashes."""
    cells = SEGMENT
    while cells < min(MAX_CELLS, rows * CELLS_PER_ROW):
        cells *= 2

    def fill(batches):
        once, again = np.zeros(cells, bool), np.zeros(cells, bool)
        for batch in batches:
            x = np.unique(batch.column(0).to_numpy(), return_counts=True)
            for cell in _cells(x[0], cells):
                # distinct hashes of this batch that share a cell, or a hash met twice
                hit, index = np.unique(cell, return_inverse=True)
                again[hit] |= once[hit] | (np.bincount(index, x[1]) > 1)
                once[hit] = True
        for k in range(cells // SEGMENT):
            part = slice(k * SEGMENT, (k + 1) * SEGMENT)
            if once[part].any():
                bits = (np.packbits(once[part]).tobytes(), np.packbits(again[part]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), *(pa.array([b], pa.binary()) for b in bits)],
                    names=["segment", "once", "again"],
                )

    def merge(found: Iterator[tuple]) -> Iterator[tuple]:
        """One row a segment, of parts sorted by segment: one part at a time is held."""
        last, once, again = None, None, None
        for segment, a, b in found:
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if segment == last:
                again = again | b | (once & a)
                once = once | a
                continue
            if last is not None:
                yield last, again.tobytes()
            last, once, again = segment, a, b
        if last is not None:
            yield last, again.tobytes()

    spark = hashes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILTER))
    parts = hashes.coalesce(tasks).mapInArrow(fill, "segment long, once binary, again binary")
    together = parts.repartition("segment").sortWithinPartitions("segment")
    merged = map_rows(together, merge, "segment long, again binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.toLocalIterator():  # MAX_CELLS / 8 bytes at most
        at = row["segment"] * SEGMENT // 8
        bits[at : at + SEGMENT // 8] = np.frombuffer(row["again"], np.uint8)
    return bits, cells


def repeat_test(table: DataFrame):
    """A function of a text_sha256 column: false for texts that certainly occur once in table."""
    rows = table.count()
    bits, cells = repeat_filter(table.select(F.xxhash64("text_sha256").alias("h")), rows)
    shared = table.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        found = np.ones(len(hashes), bool)
        for cell in _cells(hashes.to_numpy(np.int64), cells):
            found &= (shared.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return lambda sha: maybe(F.xxhash64(sha))


def _groups(others: DataFrame) -> DataFrame:
    order = F.struct(
        (-F.col("_chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("_row").alias("row")
    )
    return others.groupBy("text_sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))


def decisions(table: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of a saved digest table."""
    marked = table.withColumn("_maybe", repeat_test(table)("text_sha256"))
    alone = marked.where(~F.col("_maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    others = marked.where("_maybe")
    # a table of its own: a join of two plain shuffles can split a hot text's rows
    groups = saved(_groups(others), "groups")
    sizes = groups.select("text_sha256", F.col("group_size").alias("n"))
    joined = spread_join(others, groups, ["text_sha256"], sizes).select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(joined)


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with all its columns.

    Documents that certainly occur once pass straight through; only possible
    repeats are shuffled with their texts.
    """
    table = saved(digests(docs), "digests")
    maybe = repeat_test(table)
    marked = docs.withColumn("__sl_sha", _sha()).withColumn("__sl_chars", _chars())
    marked = marked.withColumn("__sl_maybe", maybe("__sl_sha"))
    alone = marked.where(~F.col("__sl_maybe"))
    first = _groups(table.where(maybe("text_sha256"))).select(
        F.col("text_sha256").alias("__sl_first"), (-F.col("first.less")).alias("__sl_most"), F.col("first.id").alias("__sl_id")
    )
    others = marked.where("__sl_maybe")
    stay = (
        (F.col("__sl_sha") == F.col("__sl_first"))
        & (F.col("__sl_chars") == F.col("__sl_most"))
        & F.col("doc_id").cast("long").eqNullSafe(F.col("__sl_id"))
    )
    others = others.join(first, stay, "left_semi").dropDuplicates(["__sl_sha"])
    return alone.unionByName(others).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(saved(digests(documents(spark, sf_dir)), "digests"))
