"""Exact order statistics of many keys, by refining a histogram around the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

#: Ranges of values that a pass counts.
RANGES = 1024

#: Distinct values of one key and range that a task may sort.
SORTED = 1_000_000


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return same


def _renamed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds _range, the place of _v among cuts that deal all rows evenly; NaN is the last range."""
    found = rows.agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = sorted({c for c in found if float("-inf") < c < float("inf")})
    if not cuts:
        return rows.withColumn("_range", F.when(F.isnan("_v"), 1.0).otherwise(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol="_v", outputCol="_range", handleInvalid="keep").transform(rows)


def quantiles(
    rows: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), *, weight: str | None = None,
    most: int = SORTED, ranges: int = RANGES,
) -> DataFrame:
    """(keys..., n, q): the number of values and an array with their quantiles, interpolated linearly
    between the ranks around (n - 1) * p.  With ``weight`` (whole numbers), a row stands for that many.

    Rows are counted by key and distinct value first.  While a key has more than ``most`` distinct values
    left, they are cut into ranges, the ranges are counted, and only those with a wanted rank stay.
    So no task sorts all values of a hot key.  Values are compared as doubles; nulls and weights of 0 or
    less are left out, and a key with nothing else has no row.  NaN is above all numbers.  Null is a
    key like any other.  ``value`` and ``weight`` aren't keys.
    """
    keys = list(keys)
    times = F.sum(F.col(weight).cast("long")) if weight else F.count(F.lit(1))
    counted = rows.where(F.col(value).isNotNull())
    if weight:
        counted = counted.where(F.col(weight) > 0)
    counted = saved(counted.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(times.alias("_n")), "counts")
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("n")).where("n > 0")
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    wanted = [f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]
    ranks = _renamed(sizes.select(*keys, F.array_distinct(F.array(*wanted)).alias("_ranks")), keys)
    left = counted.withColumn("_base", F.lit(0).cast("long"))
    largest = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).first()[0] or 0
    while largest > most:
        placed = _ranged(left, ranges)
        sums = placed.groupBy(*keys, "_base", "_range").agg(F.sum("_n").alias("_s"), F.count(F.lit(1)).alias("_d"))
        earlier = Window.partitionBy(*keys, "_base").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
        holds = F.exists("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_s")))
        hit = sums.join(ranks, _same(keys)).where(holds).select(*keys, "_base", "_range", "_from", "_d")
        hit = saved(_renamed(hit, keys).withColumnsRenamed({"_base": "_b", "_range": "_r"}), "ranges")
        same = _same(keys) & (F.col("_base") == F.col("_b")) & (F.col("_range") == F.col("_r"))
        left = saved(placed.join(hit, same).select(*keys, "_v", "_n", F.col("_from").alias("_base")), "counts")
        now = hit.agg(F.max("_d")).first()[0] or 0
        if now >= largest:
            break  # one range holds them all: they are sorted as they are
        largest = now
    inside = Window.partitionBy(*keys, "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    at = left.withColumn("_at", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    covers = F.filter("_ranks", lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_n")))
    found = at.join(ranks, _same(keys)).select(*keys, "_v", F.explode(covers).alias("_rank"))
    # at most two values for each quantile
    table = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_values"))
    low = lambda p: F.element_at("_values", F.floor(place(p)).cast("long"))
    high = lambda p: F.element_at("_values", F.ceil(place(p)).cast("long"))
    share = lambda p: place(p) - F.floor(place(p))
    between = [F.when(share(p) == 0, low(p)).otherwise(low(p) * (1 - share(p)) + high(p) * share(p)) for p in probs]
    return sizes.join(_renamed(table, keys), _same(keys)).select(*keys, "n", F.array(*between).alias("q"))
