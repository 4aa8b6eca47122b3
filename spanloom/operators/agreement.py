"""Agreement of labelers: cells, ratios with an explicit rule for zero denominators, strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import within

#: What a ratio without cases is: undefined, 0 or 1.
ZERO = {"null": None, "zero": 0.0, "one": 1.0}


def ratio(top: Column | str, bottom: Column | str, zero: str = "null") -> Column:
    top, bottom = (F.col(c) if isinstance(c, str) else c for c in (top, bottom))
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if zero == "null" else F.coalesce(value, F.lit(ZERO[zero]))


def cells(frames: DataFrame, pred: str, ref: str, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn and the unknowns of both kinds; a null prediction is no negative."""
    p, r = F.col(pred), F.col(ref)
    kinds = {
        "tp": p & r, "fp": p & ~r, "fn": ~p & r, "tn": ~p & ~r,
        "unknown_pos": p.isNull() & r, "unknown_neg": p.isNull() & ~r,
    }
    one = weight if weight is not None else F.lit(1).cast("long")
    return frames.groupBy(*keys).agg(
        *(F.sum(F.when(c, one).otherwise(one * 0)).alias(n) for n, c in kinds.items())
    )


def unknown_aware(c: DataFrame, zero: str = "null") -> DataFrame:
    """Ratios in which unknown positives count against recall, F1 and IoU, unknown negatives
    against specificity, and precision ignores unknowns."""
    total = sum((F.col(x) for x in ("fp", "fn", "tn", "unknown_pos", "unknown_neg")), F.col("tp"))
    missed = F.col("fn") + F.col("unknown_pos")
    known = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.withColumns(
        {
            "coverage": ratio(known, total, zero),
            "agreement": ratio(F.col("tp") + F.col("tn"), total, zero),
            "precision": ratio("tp", F.col("tp") + F.col("fp"), zero),
            "recall": ratio("tp", F.col("tp") + missed, zero),
            "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + missed, zero),
            "iou": ratio("tp", F.col("tp") + F.col("fp") + missed, zero),
            "specificity": ratio("tn", F.col("tn") + F.col("fp") + F.col("unknown_neg"), zero),
        }
    )


def suite(c: DataFrame, zero: str = "null") -> DataFrame:
    """The 2x2 suite of columns tp, fp, fn, tn (weighted or not)."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agreement = ratio(tp + tn, n, zero)
    f1, f1_neg = ratio(2 * tp, 2 * tp + fp + fn, zero), ratio(2 * tn, 2 * tn + fp + fn, zero)
    iou, iou_neg = ratio(tp, tp + fp + fn, zero), ratio(tn, tn + fp + fn, zero)
    chance = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n, zero)
    q = ratio((tp + fp) + (tp + fn), 2 * n, zero)
    by_chance = 2 * q * (1 - q)
    recall, specificity = ratio(tp, tp + fn, zero), ratio(tn, tn + fp, zero)
    return c.withColumns(
        {
            "agreement": agreement, "f1": f1, "macro_f1": (f1 + f1_neg) / 2,
            "iou": iou, "mean_iou": (iou + iou_neg) / 2,
            "kappa": ratio(agreement - chance, 1 - chance, zero),
            "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), zero),
            "precision": ratio(tp, tp + fp, zero), "recall": recall, "specificity": specificity,
            "balanced_accuracy": (recall + specificity) / 2,
            "ac1": ratio(agreement - by_chance, 1 - by_chance, zero),
            "prevalence": ratio(tp + fn, n, zero),
        }
    )


def weightings(frames: DataFrame, pred: str, ref: str) -> DataFrame:
    """Cells per weighting: frames count 1, seconds 1/fps, equal episodes 1/n_frames."""
    weights = F.explode(
        F.array(
            F.struct(F.lit("frames").alias("weighting"), F.lit(1.0).alias("w")),
            F.struct(F.lit("seconds").alias("weighting"), (1 / F.col("fps")).alias("w")),
            F.struct(F.lit("episodes").alias("weighting"), (1 / F.col("n_frames")).alias("w")),
        )
    )
    # counts per episode first: three weights for each episode, not for each frame
    each = cells(frames, pred, ref, ["episode", "fps", "n_frames"]).withColumn("_w", weights)
    sums = [F.sum(F.col(x) * F.col("_w.w")).alias(x) for x in ("tp", "fp", "fn", "tn")]
    return each.groupBy(F.col("_w.weighting").alias("weighting")).agg(*sums)


def confusion(rows: DataFrame, ref: str, pred: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts by reference, a column for each predicted value and one for missing predictions."""
    counts = [F.count_if(F.col(pred) == v).alias(f"pred_{v}") for v in values]
    missing = F.count_if(F.col(pred).isNull()).alias("pred_missing")
    return rows.groupBy(*keys, ref).agg(*counts, missing)


def vote_patterns(frames: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Histogram of the raters' votes as a bit code, the first rater highest."""
    code = sum((F.col(r).cast("int") * (1 << i) for i, r in enumerate(reversed(raters))), F.lit(0))
    return frames.groupBy(code.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "votes", F.bit_count("pattern")
    )


def fleiss_kappa(patterns: DataFrame, raters: int) -> DataFrame:
    """Unanimity, Jaccard (all over any) and Fleiss' kappa of a vote histogram."""
    n, v, k = F.col("n"), F.col("votes"), raters
    s = patterns.agg(
        F.sum("n").alias("frames"),
        F.sum(n * v).alias("yes"),
        F.sum(n * (v * (v - 1) + (k - v) * (k - v - 1))).alias("agreeing"),
        F.sum(F.when((v == k) | (v == 0), n).otherwise(0)).alias("unanimous"),
        F.sum(F.when(v == k, n).otherwise(0)).alias("all_yes"),
        F.sum(F.when(v > 0, n).otherwise(0)).alias("any_yes"),
    )
    p = F.col("yes") / (F.col("frames") * k)
    observed, chance = F.col("agreeing") / (F.col("frames") * k * (k - 1)), p * p + (1 - p) * (1 - p)
    return s.select(
        "frames",
        ratio("unanimous", "frames").alias("unanimity"),
        ratio("all_yes", "any_yes").alias("jaccard"),
        ratio(observed - chance, 1 - chance).alias("fleiss_kappa"),
    )


def defined_mean(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Means over the rows where a value is defined (not null, not NaN), and their number."""
    aggs = []
    for c in columns:
        known = F.when(~F.isnan(c), F.col(c))
        aggs += [F.avg(known).alias(f"mean_{c}"), F.count(known).alias(f"n_{c}")]
    return rows.groupBy(*keys).agg(*aggs)


def state_agreement(frames: DataFrame, left: Sequence[str], right: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Agreement of two labelers on two axes (such as progress and failure) and on their four joint states.

    Frames are counted by pair of states first, at most 16 rows for each key.  Frames with an unknown axis take no part.
    """
    code = lambda axes: F.col(axes[0]).cast("int") * 2 + F.col(axes[1]).cast("int")
    coded = frames.select(*keys, code(left).alias("l"), code(right).alias("r")).where("l is not null and r is not null")
    counts = coded.groupBy(*keys, "l", "r").agg(F.count(F.lit(1)).alias("k"))
    where = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    bit = lambda side, axis: F.col(side).bitwiseAND(2 - axis) > 0
    sums = {"frames": F.sum("k"), "joint": where(F.col("l") == F.col("r"))}
    for axis in (0, 1):
        sums[f"same_{axis}"] = where(bit("l", axis) == bit("r", axis))
        sums[f"both_{axis}"] = where(bit("l", axis) & bit("r", axis))
        sums[f"either_{axis}"] = where(bit("l", axis)) + where(bit("r", axis))
    for state in range(4):
        sums[f"chance_{state}"] = where(F.col("l") == state).cast("double") * where(F.col("r") == state).cast("double")
    per = counts.groupBy(*keys).agg(*(c.alias(name) for name, c in sums.items()))
    n, accuracy = F.col("frames").cast("double"), F.col("joint") / F.col("frames")
    chance = (F.col("chance_0") + F.col("chance_1") + F.col("chance_2") + F.col("chance_3")) / (n * n)
    return per.select(
        *keys, "frames", ((F.col("same_0") + F.col("same_1")) / (2 * n)).alias("axis_accuracy"), accuracy.alias("joint_accuracy"),
        ratio(accuracy - chance, 1 - chance).alias("joint_kappa"),
        *(ratio(2 * F.col(f"both_{axis}"), f"either_{axis}").alias(f"dice_{axis}") for axis in (0, 1)),
    )


def type_agreement(frames: DataFrame, left: Sequence[str], right: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Agreement on several labels at once, a boolean column each; a null is a label that isn't set.

    Jaccard is over the frames that have any label, ``exact`` over all; ``macro_dice`` is the mean over the labels that
    either side uses (their number: ``eligible``), ``micro_dice`` pools them.
    """
    on = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    both, either = (sum((f(on(x), on(y)) for x, y in zip(left, right, strict=True)), F.lit(0)) for f in (F.least, F.greatest))
    sized = frames.withColumns({"_both": both, "_either": either})
    per = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.when(F.col("_either") > 0, F.col("_both") / F.col("_either"))).alias("jaccard"),
        F.avg((F.col("_either") > 0).cast("double")).alias("nonempty"), F.avg((F.col("_both") == F.col("_either")).cast("double")).alias("exact"),
        F.array(*(ratio(2 * F.sum(F.least(on(x), on(y))), F.sum(on(x) + on(y))) for x, y in zip(left, right, strict=True))).alias("dice"),
        ratio(2 * F.sum("_both"), F.sum(F.col("_both") + F.col("_either"))).alias("micro_dice"),
    )
    defined = F.array_compact("dice")
    total = F.aggregate(defined, F.lit(0.0), lambda s, x: s + x)
    macro = F.when(F.size(defined) > 0, total / F.size(defined))
    return per.select(*keys, "frames", "jaccard", "nonempty", "exact", macro.alias("macro_dice"), "micro_dice", F.size(defined).cast("long").alias("eligible"))


def tolerant_hits(refs: DataFrame, preds: DataFrame, gap: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """(side, category, segments, hit, same_category): segments (keys..., start, end, categories) that have one of the
    other side at most ``gap`` frames away, and of those the ones that share a category with such a one.

    A row for all segments of each side and one for each category of the references; a segment without categories
    counts as ``none``, one with several in each.  Segments are told apart by their start.
    """
    pairs = within(refs.select(*keys, "start", "end", "categories"), preds.select(*keys, "start", "end", "categories"), gap, keys)
    shared = F.coalesce(F.arrays_overlap("left_categories", "right_categories"), F.lit(False))
    sides = []
    for side, rows, start in (("reference", refs, "left_start"), ("predicted", preds, "right_start")):
        near = pairs.groupBy(*keys, F.col(start).alias("start")).agg(F.max(shared).alias("_same"))
        found = rows.join(near, [*keys, "start"], "left")
        kinds = F.transform(F.coalesce("categories", F.array()), lambda c: c.cast("string"))
        named = F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("none")))
        listed = F.concat(F.array(F.lit("all")), F.array_distinct(named)) if side == "reference" else F.array(F.lit("all"))
        sides.append(found.select(F.lit(side).alias("side"), F.explode(listed).alias("category"), "_same"))
    both = sides[0].unionByName(sides[1])
    return both.groupBy("side", "category").agg(
        F.count(F.lit(1)).alias("segments"), F.count("_same").alias("hit"), F.count_if("_same").alias("same_category")
    )
