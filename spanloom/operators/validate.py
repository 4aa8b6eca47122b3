"""Rules as tables of violations (rule, episode, place): nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule that is unknown for a row is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def violations(rows: DataFrame, rules: dict[str, Column], *columns: str) -> DataFrame:
    """One row for each rule that a row breaks."""
    return rows.withColumn("rule", F.explode(broken(rules))).select("rule", *columns)


def first_reason(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """rows with the first reason that holds, null for none."""
    chosen = reduce(lambda c, kv: c.when(kv[1], F.lit(kv[0])), reasons.items(), F)
    return rows.withColumn("reason", chosen.otherwise(F.lit(None)))


def partition_violations(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """Places where segments aren't contiguous from frame 0 to the episode's end."""
    order = Window.partitionBy("episode").orderBy("start")
    cursor = F.lag("end", 1, 0).over(order)
    gaps = segments.withColumn("cursor", cursor).where("cursor <> start").select(
        F.lit("gap").alias("rule"), "episode", F.col("start").alias("place")
    )
    ends = segments.groupBy("episode").agg(F.max("end").alias("place")).join(episodes, "episode")
    return gaps.union(ends.where("place <> n_frames").select(F.lit("not_at_end"), "episode", "place"))


def equal_neighbours(segments: DataFrame, *state: str) -> DataFrame:
    """Adjacent segments of equal state: they should be one."""
    order = Window.partitionBy("episode").orderBy("start")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lag(c).over(order)) for c in state))
    touching = F.lag("end").over(order) == F.col("start")
    return segments.withColumn("_bad", same & touching).where("_bad").select(
        F.lit("equal_neighbours").alias("rule"), "episode", F.col("start").alias("place")
    )


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem) for keys that are missing, unexpected or returned more than once."""
    wanted = expected.select(key).distinct().withColumn("_wanted", F.lit(True))
    counts = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    problem = (
        F.when(F.col("_n").isNull(), "missing")
        .when(F.col("_wanted").isNull(), "unexpected")
        .when(F.col("_n") > 1, "duplicate")
    )
    both = wanted.join(counts, key, "full_outer").withColumn("problem", problem)
    return both.where("problem is not null").select(key, "problem")


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, block: Column | None = None) -> DataFrame:
    """(keys..., position, left, right, problem): the rows of both sides paired by their place in ``order`` within the
    keys, from 0; the sides are structs of their other columns.  Where one is longer, the rest of it is kept with
    the problem ``left_longer`` or ``right_longer``.  ``block`` cuts a long key, as in ``scans``."""
    sides = []
    for name, rows in (("left", left), ("right", right)):
        placed = rows.withColumn("_one", F.lit(1).cast("long"))
        placed = scans.sums_before(placed, [order], ["_one"], keys, F.lit(0) if block is None else block)
        sides.append(placed.select(*keys, F.col("before__one").alias("position"), F.struct(*(c for c in rows.columns if c not in keys)).alias(name)))
    both = sides[0].join(sides[1], [*keys, "position"], "full_outer")
    return both.withColumn("problem", F.when(F.col("right").isNull(), "left_longer").when(F.col("left").isNull(), "right_longer"))


def strictly_zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, block: Column | None = None) -> DataFrame:
    """``zipped``, failing where one side is longer."""
    found = zipped(left, right, keys, order, block)
    place = F.concat_ws(" ", F.col("problem"), *(F.col(k).cast("string") for k in keys))
    kept = F.when(F.col("problem").isNull(), F.col("position")).otherwise(F.raise_error(place).cast("long"))
    return found.select(*keys, kept.alias("position"), "left", "right")
