"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A table of token files holds blocks of documents in ascending doc_id order.  In
a block, ids are replaced by their rank by frequency within the block, so the
commonest take one byte.  Each rank is written in one to four little-endian data
bytes; the byte counts, two bits each, are kept apart in control bytes.  Both
directions work on whole arrays: lengths come from a 256-row table of the
control bytes, and each data byte is placed by the length's cumulative sums.

The blocks are rows with binary columns, written by Spark's own committed
Parquet writer, so any file system works and a lost executor leaves no debris.

Cases: a null text counts as empty (only the end id is written); rows with the
same doc_id are all kept, next to each other; a null doc_id sorts first; an
empty table gives no blocks; columns other than doc_id and text are ignored; a document
is never divided, so a very long text ends its block, which is larger by its ids; of
ids of equal frequency the smaller one ranks first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_rows, scratch_path, text_of
from .tokens import byte_level

#: A block is closed once it has this many ids; bounds a task's memory.
BLOCK_IDS = 1 << 20

BLOCK_SCHEMA = (
    "shard long, block long, n_ids long, doc_ids binary, doc_lengths binary, "
    "ranked binary, control binary, data binary"
)

#: Row c: the byte counts (1 to 4) of the four integers that control byte c describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack_integers(values: np.ndarray) -> tuple[bytes, bytes]:
    """uint32 values -> (control bytes, data bytes)."""
    n = len(values)
    values = values.astype("<u4")
    extra = (values >= 1 << 8).astype(np.uint8)
    extra += values >= 1 << 16
    extra += values >= 1 << 24
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(n, 4)[kept].tobytes()


def unpack_integers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of pack_integers for n values."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    kept = np.arange(4, dtype=np.uint8) < lengths[:, None]
    out = np.zeros((n, 4), np.uint8)
    out[kept] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by descending frequency, control bytes, data bytes); ties: the smaller id first."""
    counts = np.bincount(ids)
    ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    control, data = pack_integers(rank[ids])
    return ranked.tobytes(), control, data


def decode_block(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranked, "<u4")[unpack_integers(control, data, n)]


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encoded blocks of the documents, in ascending doc_id order of (shard, block)."""

    def blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
        tokenizer = byte_level(tokenizer_path)
        end = np.uint32(end_id).tobytes()
        shard, number = TaskContext.get().partitionId(), 0
        held, total = [], 0

        def block():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            key = np.array([-(1 << 63) if d is None else d for d, _ in held], "<i8")
            sizes = np.array([len(x) // 4 for _, x in held], "<i8")
            return shard, number, len(ids), key.tobytes(), sizes.tobytes(), *encode_block(ids)

        for doc_id, text in rows:
            held.append((doc_id, tokenizer.encode(text) + end))
            total += len(held[-1][1]) // 4
            if total >= BLOCK_IDS:
                yield block()
                held, total, number = [], 0, number + 1
        if held:
            yield block()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    return map_rows(ordered, blocks, BLOCK_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    token_blocks(docs, tokenizer_path, end_id).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    start counts the ids of all documents before it.  Only the blocks' id counts
    meet in one place, summed per shard first.
    """
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(
        "shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start")
    )
    inside = Window.partitionBy("shard").orderBy("block")
    sizes = blocks.select("shard", "block", "n_ids").withColumn(
        "block_start",
        F.coalesce(
            F.sum("n_ids").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    places = sizes.join(shards, "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start")
    )

    def documents_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for shard, block, n, keys, sizes, ranked, control, data in rows:
            ids = decode_block(ranked, control, data, n)
            at = 0
            keys = np.frombuffer(keys, "<i8").tolist()
            for key, size in zip(keys, np.frombuffer(sizes, "<i8").tolist(), strict=True):
                own = ids[at : at + size]
                row = (None if key == -(1 << 63) else key, shard, block, at, size)
                yield *row, zlib.crc32(own), *([own.tolist()] if with_ids else [])
                at += size

    schema = "doc_id long, shard long, block long, at long, n_tokens long, ids_crc32 long"
    decoded = map_rows(
        blocks.select(*(f.split()[0] for f in BLOCK_SCHEMA.split(", "))),
        documents_of,
        schema + ", ids array<long>" * with_ids,
    )
    return decoded.join(places, ["shard", "block"]).select(
        "doc_id",
        (F.col("start") + F.col("at")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_token_files(
        documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return read_token_files(spark, path, with_ids=False)
