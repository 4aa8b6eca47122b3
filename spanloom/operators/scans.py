"""Scans along long episodes in two levels: inside blocks of the order, then over one row a block.

A block is a column that never falls along the order (``frames_block``, or a day of a
timestamp).  A window holds one block of an episode, or one row for each block of it, so an episode
of ten million frames is 153 tasks' work.  The results are those of one window over the episode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames in a block.
BLOCK = 65_536


def frames_block(frame: str | Column, width: int = BLOCK) -> Column:
    return F.floor((F.col(frame) if isinstance(frame, str) else frame) / width).cast("long")


def _with_blocks(rows: DataFrame, blocks: DataFrame, keys: Sequence[str], added: Sequence[str]) -> DataFrame:
    """Rows joined with what the blocks before theirs hand on; null keys are keys as well."""
    other = blocks.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_b"), *added)
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(other, same).drop("_b", *(f"_k_{k}" for k in keys))


def sums_before(rows: DataFrame, order: Sequence[str], sums: Sequence[str], keys: Sequence[str], block: Column) -> DataFrame:
    """Adds ``before_<c>``, the sum of c over the rows before this one within the keys; rows that are
    equal in ``order`` come in any order, null first.  No rows give no rows."""
    placed = rows.withColumn("_block", block)
    of_block = placed.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"_of_{c}") for c in sums))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    of_block = of_block.withColumns({f"_from_{c}": F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)) for c in sums})
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    joined = _with_blocks(summed, of_block, keys, [f"_from_{c}" for c in sums])
    return joined.select(*rows.columns, *((F.col(f"_from_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in sums))


def last_known(rows: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Nulls of ``column`` replaced by the last value known before them; null where none is."""
    placed = rows.withColumn("_block", block)
    known = F.when(F.col(column).isNotNull(), F.struct(*order))
    ends = placed.groupBy(*keys, "_block").agg(F.max_by(column, known).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("_in", F.last(column, ignorenulls=True).over(inside))
    joined = _with_blocks(filled, ends, keys, ["_carry"])
    return joined.withColumn(column, F.coalesce("_in", "_carry")).select(*rows.columns)


def runs(frames: DataFrame, state: str, keys: Sequence[str], width: int = BLOCK) -> DataFrame:
    """Maximal runs of equal state; a null (unknown) or missing frame ends a run.

    Runs are found inside blocks of frames.  Those that touch a block's edge, at most two for each
    block, meet in one window and are joined; all others are whole already.
    """
    known = frames.where(F.col(state).isNotNull()).withColumn("_block", frames_block("frame", width))
    row = F.row_number().over(Window.partitionBy(*keys, state, "_block").orderBy("frame"))
    parts = known.withColumn("_island", F.col("frame") - row).groupBy(*keys, state, "_block", "_island")
    parts = parts.agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"))
    # a run inside a block is a group of its own; the runs at edges are the group -1
    at_edge = (F.pmod("start", F.lit(width)) == 0) | (F.pmod("end", F.lit(width)) == 0)
    parts = parts.withColumn("_alone", F.when(at_edge, F.lit(-1)).otherwise(F.col("start")).cast("long"))
    order = Window.partitionBy(*keys, state, "_alone").orderBy("start")
    opens = F.coalesce((F.col("start") != F.lag("end").over(order)).cast("int"), F.lit(1))
    return (
        parts.withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(order))
        .groupBy(*keys, state, "_alone", "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(*keys, "start", "end", F.col(state).alias("state"))
    )


def previous(rows: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "previous") -> DataFrame:
    """Adds ``name``: the column's value in the row before this one within the keys, null for the first."""
    placed = rows.withColumn("_block", block)
    ends = placed.groupBy(*keys, "_block").agg(F.max_by(column, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    shifted = placed.withColumns({"_in": F.lag(column).over(inside), "_opens": F.row_number().over(inside) == 1})
    joined = _with_blocks(shifted, ends, keys, ["_carry"])
    return joined.select(*rows.columns, F.when(F.col("_opens"), F.col("_carry")).otherwise(F.col("_in")).alias(name))
