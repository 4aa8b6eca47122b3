"""Soft agreement of segmentations: matched boundaries weighted by a kernel of their distance.

A boundary is where two segments touch.  It carries its time and the shorter duration of the two.  For a distance in
seconds, r = distance / tau, with tau a number of seconds (``absolute``), a share of the shorter duration at both
boundaries (``relative``), or at least a quarter of a second of that (``hybrid``).  The score is twice the largest
total weight of an ordered matching over the number of boundaries of both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans
from .matching import matched
from .timeline import BIN, binned

#: Weights below e^-40 don't show in a double of that size: pairs further apart aren't candidates.
TAIL = 40.0
LEAST_SECONDS = 0.25
MEASURE = ("kernel", "kind", "scale")


def touching(segments: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Boundaries (keys..., frame, seconds, near, fps) of segments (keys..., start, end, fps)."""
    rows = segments.withColumn("_span", F.struct("start", "end"))
    rows = scans.previous(rows, "_span", keys, ["start"], scans.frames_block("start"), "before")
    shorter = F.least(F.col("end") - F.col("start"), F.col("before.end") - F.col("before.start"))
    return rows.where("before.end = start").select(
        *keys, F.col("start").alias("frame"), (F.col("start") / F.col("fps")).alias("seconds"), (shorter / F.col("fps")).alias("near"), "fps"
    )


def tau(kind: Column, scale: Column, near: Column) -> Column:
    share = scale * near
    return F.when(kind == "absolute", scale).when(kind == "relative", share).otherwise(F.greatest(F.lit(LEAST_SECONDS), share))


def weight(kernel: Column, ratio: Column) -> Column:
    """hard: 1 up to tau (with slack for rounding); linear: falls to 0 at tau; exp: e^-r."""
    hard, linear = (ratio <= 1 + 1e-9).cast("double"), F.greatest(F.lit(0.0), 1 - ratio)
    return F.when(kernel == "hard", hard).when(kernel == "linear", linear).otherwise(F.exp(-ratio))


def kernel_scores(left: DataFrame, right: DataFrame, clocks: DataFrame, measures: Sequence[tuple[str, str, float]], keys: Sequence[str] = ("episode",)) -> DataFrame:
    """(keys..., kernel, kind, scale, n_left, n_right, total, score) for each row of ``clocks`` (keys..., fps) and
    each measure (kernel, kind, scale); left and right are segments.  Without boundaries the score is 1.

    A boundary looks for partners only within the reach of the measure, in bins of frames.
    """
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("kernel"), F.lit(b).alias("kind"), F.lit(c).cast("double").alias("scale")) for a, b, c in measures)))
    clock = clocks.select(*keys, "fps")
    a, b = (touching(side.select(*keys, "start", "end").join(clock, list(keys)), keys) for side in (left, right))
    asked = a.withColumn("m", each).select("*", "m.*").drop("m")
    seconds = tau(F.col("kind"), F.col("scale"), F.col("near")) * F.when(F.col("kernel") == "exp", TAIL).otherwise(1.0)
    asked = asked.withColumn("_reach", F.ceil(seconds * F.col("fps") + 1e-6))
    asked = binned(asked, F.col("frame") - F.col("_reach"), F.col("frame") + F.col("_reach") + 1).drop("fps", "_reach")
    met = asked.withColumnsRenamed({"frame": "left", "seconds": "left_at", "near": "left_near"}).join(
        b.select(*keys, F.col("frame").alias("right"), F.col("seconds").alias("right_at"), F.col("near").alias("right_near"), F.floor(F.col("frame") / BIN).alias("_bin")),
        [*keys, "_bin"],
    )
    near = F.least("left_near", "right_near")
    apart = F.abs(F.col("left_at") - F.col("right_at")) / F.greatest(tau(F.col("kind"), F.col("scale"), near), F.lit(1e-9))
    by = [*keys, *MEASURE]
    pairs = met.select(*by, "left", "right", weight(F.col("kernel"), apart).alias("score")).where("score > 0")
    best = matched(pairs, by, "alignment", (F.least("left", "right"), F.greatest("left", "right") + 1))
    totals = best.groupBy(*by).agg(F.sum("score").alias("total"))
    counted = lambda side, name: side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    base = clock.join(counted(a, "n_left"), list(keys), "left").join(counted(b, "n_right"), list(keys), "left").fillna(0, ["n_left", "n_right"])
    base = base.withColumn("m", each).select(*keys, "m.*", "n_left", "n_right")
    found = base.join(totals, by, "left").fillna(0.0, ["total"])
    n = F.col("n_left") + F.col("n_right")
    return found.withColumn("score", F.when(n == 0, 1.0).otherwise(F.try_divide(2 * F.col("total"), n.cast("double"))))
