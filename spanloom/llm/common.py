"""Shared pieces: scratch tables, text columns and Arrow batch plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import saved, shared_dir

__all__ = ["arrow_schema", "documents", "map_rows", "saved", "scratch_path", "shared_dir", "shuffle_partitions", "spread_join", "text_of", "tuples"]

#: A list that grows to this many rows is handed on as one Arrow batch.
ROWS_PER_BATCH = 4096
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 512


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: A key with at least one in so many rows is joined by broadcast.
SPREAD = 1000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame, how: str = "inner") -> DataFrame:
    """left.join(right, on) for a right side with one row a key, without a hot task.

    ``sizes`` has the rows of ``left`` for each key as ``n``.  At most SPREAD keys hold one in
    SPREAD rows or more; only their rows of ``right`` are broadcast.  All other keys are shuffled.
    """
    total = left.count()
    hot = sizes.where(F.col("n") * SPREAD >= total).select(*on)  # SPREAD rows at most
    hot = saved(right.join(F.broadcast(hot), on, "left_semi"), "hot")
    if hot.isEmpty():
        return left.join(right, on, how)
    few = F.broadcast(hot)
    return left.join(few, on).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right, on, how))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(text: str = "text") -> F.Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def map_rows(
    df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str
) -> DataFrame:
    """Run ``rows`` over each partition's rows, as tuples, through Arrow batches."""
    return df.mapInArrow(_Rows(rows, schema), schema)


def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, some Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


class _Rows:
    def __init__(self, rows, schema):
        self.rows = rows
        self.schema = schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(self.schema)
        held: list[tuple] = []
        for row in self.rows(tuples(batches)):
            held.append(row)
            if len(held) >= ROWS_PER_BATCH:
                yield _batch(held, kinds)
                held = []
        if held:
            yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds
    )


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(schema: str) -> pa.Schema:
    """'a long, b string' as an Arrow schema."""
    fields = [part.split() for part in schema.split(",")]
    return pa.schema([(name, _ARROW[kind]) for name, kind in fields])
