"""Shortest-pack-first packing of documents into fixed-length token sequences.

Documents are tokenised once.  A document's ids are cut into full sequences and
one remainder, so only lengths up to the sequence size have to be packed.  The
packing itself works on the histogram of lengths (at most one row per length,
whatever the input): lengths are placed longest first, each into the emptiest
pattern that still has room, and patterns carry counts.  A pattern with count c
that has a slot of length L takes c consecutive ranks of the pieces of length L;
a piece finds its sequence and offset by its rank.

Ranks are counted without gathering a length in one task: pieces of a length are
dealt by hash over about the square root of their number of groups, ranked there,
and the groups' sizes are summed before them.

Cases: a null or empty text packs as its end id alone; repeated rows are packed
once each; an empty table gives no rows; columns other than doc_id and text are
ignored; a null doc_id stays null; a very long text is tokenised whole by one task
and cut into full sequences and a remainder; pieces of equal length are ranked by
groups of a hash, in a group by doc_id, start and checksum, so only equal pieces
may change places.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_rows, saved, text_of
from .tokens import MEMO_CHUNKS, space_dropping

SEQUENCE = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SEQUENCE, with_ids: bool = False,
    memo: int = MEMO_CHUNKS,
) -> DataFrame:
    """The documents' ids, each followed by the end id, cut into pieces of at most ``size``.

    memo: chunks that a worker keeps; more cost memory and save time.
    """

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        tokenizer = space_dropping(tokenizer_path, memo)
        end = np.uint32(end_id).tobytes()
        for doc_id, text in rows:
            ids = tokenizer.encode(text) + end
            total = len(ids) // 4
            for start in range(0, total, size):
                own = ids[4 * start : 4 * (start + size)]
                row = (doc_id, start, len(own) // 4, zlib.crc32(own), total)
                yield *row, *([np.frombuffer(own, "<u4").tolist()] if with_ids else [])

    return map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")),
        pieces,
        PIECES + ", ids array<long>" * with_ids,
    )


def shortest_pack_first(
    histogram: dict[int, int], size: int = SEQUENCE
) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that use up a histogram of lengths.

    ``open_packs[room]`` holds the patterns that have that much room left; a
    heap of the rooms gives the emptiest.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    rooms: list[int] = []
    closed: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, lengths: tuple[int, ...], room: int) -> None:
        if room == 0:
            closed.append((count, lengths))
            return
        if not open_packs[room]:
            heapq.heappush(rooms, -room)
        open_packs[room].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            emptiest = -rooms[0] if rooms else 0
            if emptiest < length:
                # each new pack takes as many as fit before the next one is opened
                fit = size // length
                if left >= fit:
                    put(left // fit, (length,) * fit, size - fit * length)
                if left % fit:
                    put(1, (length,) * (left % fit), size - left % fit * length)
                break
            count, lengths = open_packs[emptiest].pop()
            if not open_packs[emptiest]:
                heapq.heappop(rooms)
            used = min(count, left)
            if count > used:
                put(count - used, lengths, emptiest)
            put(used, (*lengths, length), emptiest - length)
            left -= used
    return closed + [p for packs in open_packs.values() for p in packs]


def rank_intervals(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked_by_length(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with ``rank``: 0, 1, ... within each length; no task gathers a whole length."""
    spark = pieces.sparkSession
    groups = [(n, -(-c // max(128, round(c**0.5)))) for n, c in histogram.items()]
    groups = spark.createDataFrame(groups, "length long, groups long")  # one row per length
    dealt = pieces.join(F.broadcast(groups), "length").withColumn(
        "dealt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("groups"))
    )
    before = Window.partitionBy("length").orderBy("dealt")
    sizes = (
        dealt.groupBy("length", "dealt")
        .count()
        .select(
            "length",
            "dealt",
            (F.sum("count").over(before) - F.col("count")).alias("before"),
        )
    )
    inside = Window.partitionBy("length", "dealt").orderBy("doc_id", "start", "ids_crc32")
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "dealt"])
        .withColumn("rank", F.col("before") + F.col("place"))
        .drop("groups", "dealt", "place", "before")
    )


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """pieces with the sequence_id and offset of each.

    ``pieces`` is read more than once and so should be a saved table.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    intervals = rank_intervals(shortest_pack_first(histogram, size))
    first = np.array([(n << 44) | r for n, r, _, _ in intervals.tolist()], np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast((first, intervals))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first, intervals = shared.value
        key = (length.to_numpy(np.int64) << 44) | rank.to_numpy(np.int64)
        found = intervals[np.searchsorted(first, key, side="right") - 1]
        sequence = found[:, 2] + rank.to_numpy(np.int64) - found[:, 1]
        return pd.DataFrame({"sequence_id": sequence, "offset": found[:, 3]})

    ranked = ranked_by_length(pieces, histogram)
    return (
        ranked.withColumn("placed", place("length", "rank"))
        .select(*pieces.columns, "placed.sequence_id", "placed.offset")
    )


def packed_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, memo: int = MEMO_CHUNKS
) -> DataFrame:
    return pack(saved(token_pieces(docs, tokenizer_path, end_id, memo=memo), "pieces"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )
