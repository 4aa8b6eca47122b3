"""Ranks, AUROC, thresholds, bootstrap intervals and shift nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved
from . import scans
from .quantiles import quantiles
from .shifts import below, null_statistics, pieces
from .timeline import to_runs


def running(rows: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str] = (), parts: int = 256) -> DataFrame:
    """Adds ``before_<c>``, the sum of c over the rows before this one in ``order`` (a number) within
    ``keys``, and ``total_<c>``, the sum over all rows of the keys.

    Rows are cut into about ``parts`` ranges of equal size, summed within a range, and the sums of the
    ranges before are added, so that neither one key nor a table without keys is one task's work.
    Null comes first, NaN last.
    """
    probes = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(order, probes, 10_000)).first()[0] or []
    cuts = sorted({float(c) for c in found if float("-inf") < c < float("inf")})
    score = F.col(order).cast("double")
    placed = rows.withColumn("_range", F.lit(0.0))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        bucketizer = Bucketizer(splits=splits, inputCol="_score", outputCol="_range", handleInvalid="keep")
        placed = bucketizer.transform(rows.withColumn("_score", F.coalesce(score, F.lit(float("-inf"))))).drop("_score")
    added = placed.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_of_{c}") for c in sums))
    all_rows = Window.partitionBy(*keys)
    earlier = all_rows.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    added = added.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"),
        *(F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)).alias(f"_from_{c}") for c in sums),
        *(F.sum(f"_of_{c}").over(all_rows).alias(f"total_{c}") for c in sums),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return summed.join(added, same).select(
        *(F.col(c) for c in rows.columns),
        *((F.col(f"_from_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in sums),
        *(f"total_{c}" for c in sums),
    )


def average_rank(rows: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean: counts per value first, then one running sum."""
    counts = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(counts, score, ["_n"], keys).withColumn("avg_rank", F.col("before__n") + (F.col("_n") + 1) / 2)
    return rows.join(ranks.select(*keys, score, "avg_rank"), [*keys, score])


def auroc(rows: DataFrame, score: str, label: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the curve with ties at half, from counts per distinct score; null if one class
    is missing."""
    pos, neg = F.count_if(label), F.count_if(~label)
    counts = rows.groupBy(*keys, score).agg(pos.alias("p"), neg.alias("n"))
    wins = running(counts, score, ["n"], keys).withColumn("w", F.col("p") * (F.col("before_n") + F.col("n") / 2))
    return wins.groupBy(*keys).agg(
        F.try_divide(F.sum("w"), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"),
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
    )


def best_threshold(rows: DataFrame, score: str, label: Column) -> DataFrame:
    """The threshold (predict at or above it) with the largest F1; ties: the lowest one."""
    counts = rows.groupBy(score).agg(F.count_if(label).alias("p"), F.count(F.lit(1)).alias("k"))
    tp, predicted = F.col("total_p") - F.col("before_p"), F.col("total_k") - F.col("before_k")
    swept = running(counts, score, ["p", "k"]).withColumn("f1", 2 * tp / (predicted + F.col("total_p")))
    return swept.orderBy(F.col("f1").desc(), score).limit(1).select(F.col(score).alias("threshold"), "f1")


def pairwise_auroc(rows: DataFrame, score: str, group: str, groups: Sequence[str]) -> DataFrame:
    """(left_group, right_group, auroc) for each two of the named groups, in their order: how often a score of the left
    one is above one of the right one, ties at half.  Rows of other groups or without a score take no part.

    Rows are counted by group and distinct score; each count then goes to the comparisons of its group.
    """
    pairs = [(x, y) for i, x in enumerate(groups) for y in groups[i + 1 :]]
    compared = F.array(*(F.struct(F.lit(x).alias("left_group"), F.lit(y).alias("right_group")) for x, y in pairs))
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    sides = counts.withColumn("c", F.explode(F.filter(compared, lambda c: (c["left_group"] == F.col("_g")) | (c["right_group"] == F.col("_g")))))
    side = lambda name: F.sum(F.when(F.col(f"c.{name}") == F.col("_g"), F.col("_n")).otherwise(0))
    keys = ["left_group", "right_group"]
    met = sides.groupBy("c.left_group", "c.right_group", "_s").agg(side("left_group").alias("p"), side("right_group").alias("n"))
    wins = running(met, "_s", ["n"], keys).withColumn("w", F.col("p") * (F.col("before_n") + F.col("n") / 2))
    return wins.groupBy(*keys).agg(F.try_divide(F.sum("w"), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))


def fitted_thresholds(rows: DataFrame, score: str, label: Column) -> DataFrame:
    """(rule, threshold, value): two ways to fit a threshold on scores.

    ``midpoint_f1`` predicts above the threshold; candidates lie between neighbouring scores and just outside them, and
    of those within 1e-12 of the largest F1 the nearest to 0.5 is taken, then the lower.  ``balanced`` predicts at or
    above it; candidates are 0, 1 and the scores, and the lowest one of the largest balanced accuracy is taken (no row
    where a class is missing).  Rows without a score take no part; a label that is null is negative.
    """
    positive = F.coalesce(label, F.lit(False))
    seen = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count(F.lit(1)).alias("k"))
    ends = rows.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "s double, p long, k long")  # two rows
    counts = seen.unionByName(ends).groupBy("s").agg(F.sum("p").alias("p"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("one"))
    swept = saved(running(counts, "s", ["p", "k"]), "swept")
    tp, predicted = F.col("total_p") - F.col("before_p"), F.col("total_k") - F.col("before_k")
    negatives = F.col("total_k") - F.col("total_p")
    balanced = swept.select(F.lit("balanced").alias("rule"), F.col("s").alias("threshold"), (0.5 * (F.try_divide(tp.cast("double"), F.col("total_p").cast("double")) + F.try_divide((F.col("before_k") - F.col("before_p")).cast("double"), negatives.cast("double")))).alias("value"))
    balanced = balanced.where("value is not null").orderBy(F.col("value").desc(), "threshold").limit(1)

    ranked = running(seen.withColumn("one", F.lit(1).cast("long")), "s", ["p", "k", "one"])
    ranked = scans.previous(ranked, "s", [], ["s"], F.floor(F.col("before_one") / scans.BLOCK), "lower")
    f1 = F.coalesce(F.try_divide((2 * tp).cast("double"), (predicted + F.col("total_p")).cast("double")), F.lit(0.0))
    middle = F.when(F.col("lower").isNull(), F.col("s") - 1e-6).otherwise((F.col("lower") + F.col("s")) / 2)
    above = ranked.agg((F.max("s") + 1e-6).alias("threshold"), F.lit(0.0).alias("value")).where("threshold is not null")
    cuts = saved(ranked.select(middle.alias("threshold"), f1.alias("value")).unionByName(above), "cuts")
    best = cuts.agg(F.max("value").alias("best"))
    near = cuts.join(F.broadcast(best), F.col("value") >= F.col("best") - 1e-12)  # one row
    midpoint = near.orderBy(F.abs(F.col("threshold") - 0.5), "threshold").limit(1).select(F.lit("midpoint_f1").alias("rule"), "threshold", "value")
    return midpoint.unionByName(balanced)


def held_out_thresholds(rows: DataFrame, fold: str, score: str, label: Column, digits: int = 2) -> DataFrame:
    """(fold, threshold, fitted, held_out, n): for each fold the threshold of the largest balanced accuracy on all
    other folds, the lowest one of equals, and what it reaches on the fold itself.

    Scores are clipped to 0..1 and rounded to ``digits``, so that there are 10^digits + 1 levels; candidates are 0, 1
    and the levels that the other folds have.  A fold's counts by level are taken from the total's, so that a fold
    costs as many rows as there are levels.  A value without both classes is null; rows without a score take no part.
    """
    top = 10**digits
    level = F.round(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * top).cast("int")
    positive = F.coalesce(label, F.lit(False))
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(fold).alias("fold"), level.alias("level"))
    counts = saved(counts.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q")), "levels")
    every = Window.partitionBy("fold").orderBy("level")
    before, whole = every.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("fold")

    def swept(given: DataFrame) -> DataFrame:
        grid = given.select("fold").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        full = grid.join(given, ["fold", "level"], "left").fillna(0, ["p", "q"])
        under = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        return full.withColumns({"np": F.sum("p").over(whole), "nq": F.sum("q").over(whole), "tp": F.sum("p").over(whole) - under("p"), "tq": under("q"), "here": F.col("p") + F.col("q")})

    names = ["np", "nq", "tp", "tq", "here"]
    own = swept(counts)
    total = counts.groupBy("level").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).withColumn("fold", F.lit(0))
    total = swept(total).select("level", *(F.col(c).alias(f"all_{c}") for c in names))
    both = own.join(F.broadcast(total), "level")  # 10^digits + 1 rows
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    rest = {c: F.col(f"all_{c}") - F.col(c) for c in names}
    fitted = 0.5 * (share(rest["tp"], rest["np"]) + share(rest["tq"], rest["nq"]))
    held = 0.5 * (share(F.col("tp"), F.col("np")) + share(F.col("tq"), F.col("nq")))
    candidate = (rest["here"] > 0) | F.col("level").isin(0, top)
    scored = both.where(candidate).withColumns({"fitted": fitted, "held_out": held, "n": F.col("np") + F.col("nq")})
    chosen = scored.groupBy("fold").agg(F.max_by(F.struct("level", "fitted", "held_out", "n"), F.struct(F.coalesce("fitted", F.lit(-1.0)), -F.col("level"))).alias("b"))
    return chosen.select("fold", (F.when(F.col("b.fitted").isNotNull(), F.col("b.level")) / top).alias("threshold"), "b.fitted", F.when(F.col("b.fitted").isNotNull(), F.col("b.held_out")).alias("held_out"), "b.n")


#: Draws that a task makes.
DRAWS = 1_000_000


def bootstrap_draws(ids: DataFrame, key: str, rounds: int, seed: str) -> DataFrame:
    """(round, key, times): draws with replacement from hashes of seed, round and slot, so that
    any engine can repeat them.  The key is a number."""
    numbered = running(ids.select(key, F.lit(1).cast("long").alias("_one")), key, ["_one"]).select(key, F.col("before__one").alias("slot"))
    numbered = saved(numbered, "slots")  # read twice below
    n = numbered.count()
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "round", "slot")), 1, 12), 16, 10).cast("long") % n
    # a few rows become many: tasks are as many as draws ask for, not as the small table of slots does
    slots = numbered.select("slot").repartition(max(1, -(-n * rounds // DRAWS))).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = slots.select("round", draw.alias("slot")).groupBy("round", "slot").agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(numbered, "slot").select("round", key, "times")


def bootstrap_interval(draws: DataFrame, values: DataFrame, key: str, tops: str, bottoms: str) -> DataFrame:
    """Percentile interval of sum(top) / sum(bottom) over the draws."""
    each = draws.join(values, key).groupBy("round").agg(
        F.try_divide(F.sum(F.col(tops) * F.col("times")).cast("double"), F.sum(F.col(bottoms) * F.col("times")).cast("double")).alias("v")
    )
    each = each.where("v is not null and not isnan(v)")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return each.agg(q.alias("q"), F.count(F.lit(1)).alias("rounds")).select(
        "rounds", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high")
    )


def paired_bootstrap(
    draws: DataFrame, values: DataFrame, key: str, left: tuple[str, str], right: tuple[str, str]
) -> DataFrame:
    """Percentile interval of the difference of two ratios (top, bottom) over the same draws."""
    total = lambda c: F.sum(F.col(c) * F.col("times")).cast("double")
    ratio = lambda x: F.try_divide(total(x[0]), total(x[1]))
    each = draws.join(values, key).groupBy("round").agg((ratio(left) - ratio(right)).alias("v"))
    each = each.where("v is not null and not isnan(v)")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return each.agg(q.alias("q"), F.count(F.lit(1)).alias("rounds")).select(
        "rounds", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high")
    )


def shift_null(frames: DataFrame, a: str, b: str, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Overlap of two tracks against all circular shifts of one: observed, the null's mean (the
    product of the tracks' shares) and the share of shifts that reach the observed value."""
    sizes, cut = _shifted(frames, a, b, keys)
    value, slope, count = F.col("value"), F.col("slope"), F.col("until") - F.col("shift")
    reached = cut.groupBy(*keys).agg(F.sum(count - below(F.col("observed"), value, slope, count)).alias("reached"))
    return sizes.join(reached, list(keys)).select(
        *keys, "observed", (F.col("na") * F.col("nb") / F.col("n_frames")).alias("null_mean"), (F.col("reached") / F.col("n_frames")).alias("share")
    )


def shift_null_bands(frames: DataFrame, a: str, b: str, exclusions: Sequence[float], keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Dice of two tracks against its null over circular shifts, without those nearer to 0 than each
    exclusion: see ``shifts.null_statistics``."""
    sizes, cut = _shifted(frames, a, b, keys)
    return null_statistics(saved(cut, "pieces"), sizes, exclusions, keys)


def _shifted(frames: DataFrame, a: str, b: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    tracks = saved(frames.select(*keys, "n_frames", "frame", a, b), "tracks")  # read three times
    sizes = track_sizes(tracks, a, b, keys)
    left, right = (to_runs(tracks.where(c), c, keys) for c in (a, b))
    return sizes, pieces(left, right, sizes, keys)


def track_sizes(frames: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    counts = frames.groupBy(*keys, "n_frames").agg(
        F.count_if(F.col(a)).alias("na"), F.count_if(F.col(b)).alias("nb"), F.count_if(F.col(a) & F.col(b)).alias("observed")
    )
    return saved(counts, "sizes")


def summary(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, population deviation, 5 %, median and 95 % with linear interpolation.  Keys without a value
    have an n of 0 and nulls."""
    moments = rows.groupBy(*keys).agg(F.count(value).alias("_count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    marks = quantiles(rows, value, [0.05, 0.5, 0.95], keys).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return moments.join(marks, same, "left").select(
        *keys, F.col("_count").alias("n"), "mean", "sd", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95")
    )
