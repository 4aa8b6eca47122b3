"""Deterministic sampling and splits by hash order, the same in any engine and layout."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shards import next_fit_shards  # noqa: F401


def hash_key(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *columns), 256)


def sample(rows: DataFrame, seed: str, key: str, count: int) -> DataFrame:
    """``count`` rows without replacement, those with the lowest hashes."""
    return rows.orderBy(hash_key(seed, key), key).limit(count)


def hash_ranked(rows: DataFrame, seed: str, key: str, groups: Sequence[str]) -> DataFrame:
    """Adds ``_place`` (from 1, in order of the hash, then of the key) and ``_size`` of each group.

    Rows are ranked within the 4,096 ranges of a hash's first three digits and the sizes of the
    ranges before are added, so that a hot group is many tasks' work.
    """
    hashed = rows.withColumn("_hash", hash_key(seed, key)).withColumn("_range", F.substring("_hash", 1, 3))
    sizes = hashed.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    all_rows = Window.partitionBy(*groups)
    earlier = all_rows.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(all_rows).alias("_size"),
    )
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    place = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy("_hash", key))
    placed = hashed.withColumn("_in", place).join(sizes, same)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_in")).alias("_place"), "_size")


def balanced_order(rows: DataFrame, seed: str, key: str, groups: Sequence[str]) -> DataFrame:
    """Round robin over groups: ``turn`` is a row's place in its shuffled group, and rows are in
    order of (turn, hash of the group, ...)."""
    ranked = hash_ranked(rows, seed, key, groups).withColumn("turn", F.col("_place").cast("int")).drop("_place", "_size")
    return ranked.withColumn("group_order", hash_key(seed, *groups))


def proportional_split(rows: DataFrame, seed: str, key: str, groups: Sequence[str], share: float) -> DataFrame:
    """``split`` is eval for round(share * size) rows of each group, train for the others."""
    chosen = F.col("_place") <= F.bround(F.col("_size") * share)
    ranked = hash_ranked(rows, seed, key, groups)
    return ranked.withColumn("split", F.when(chosen, "eval").otherwise("train")).drop("_place", "_size")


def hash_mod3(column: str) -> Column:
    """sha256 of the text, modulo 3: the sum of the hexadecimal digits has the same remainder."""
    digits = F.split(F.sha2(F.col(column).cast("string"), 256), "(?!^)")
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.instr(F.lit("0123456789abcdef"), d) - 1)
    return total % 3


def blind_id(seed: str, column: str) -> Column:
    return F.substring(hash_key(seed, column), 1, 12)


def stride_frames(n: Column, stride: int) -> Column:
    """0, stride, 2 * stride, ... and the last frame."""
    return F.array_union(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(stride).cast("long")), F.array(n - 1))


def evenly(n: Column, k: int) -> Column:
    """k frames from first to last, places rounded half up."""
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1) + 0.5))
    return F.array_distinct(places)


def capped_frames(n: Column, fps: Column, rate: float, cap: int) -> Column:
    """Frames at ``rate`` a second and the last one, at most ``cap`` (2 or more) of them or, where the last one
    comes on top, one more stride apart; null without frames or clock."""
    stride = F.greatest(F.lit(1), F.ceil(fps / rate), F.ceil((n - 1) / (cap - 1))).cast("long")
    frames = F.array_union(F.sequence(F.lit(0).cast("long"), n - 1, stride), F.array(n - 1))
    return F.when((n > 0) & (fps > 0), frames)


def evenly_from(pool: Column, k: Column) -> Column:
    """k of the frames of a sorted pool, from its first to its last, places rounded half up in whole numbers; all of
    them if there are fewer, the first for one, none for none."""
    size, count = F.size(pool).cast("long"), F.least(k.cast("long"), F.size(pool).cast("long"))
    place = lambda i: F.floor((i * (size - 1) * 2 + (count - 1)) / (2 * (count - 1))).cast("int")
    several = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0))), lambda i: F.get(pool, place(i)))
    return F.when(count > 1, several).when(count == 1, F.slice(pool, 1, 1)).otherwise(F.slice(pool, 1, 0))


def prefix_within_budget(rows: DataFrame, cost: str, budget: float, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, in order, whose running cost stays within the budget."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(window)).where(F.col("running") <= budget)


def replay(rows: DataFrame, positive: Column, repeats: int) -> DataFrame:
    """Positives ``repeats`` times over, the others once, with the number of the copy."""
    copies = F.when(positive, F.sequence(F.lit(0), F.lit(repeats - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies))


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First-wins deduplication in an explicit order."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def closest_subset(sizes: dict[str, int], target: int) -> set[str]:
    """Groups whose sizes sum up closest to the target, an undershoot before an overshoot.

    ``sizes`` is a table of split groups, not of rows.
    """
    reached: dict[int, tuple[str, ...]] = {0: ()}
    for name in sorted(sizes):
        for total, names in list(reached.items()):
            reached.setdefault(total + sizes[name], (*names, name))
    best = min(reached, key=lambda t: (abs(t - target), t > target))
    return set(reached[best])


def closest_pairs(lefts: list[tuple], rights: list[tuple]) -> list[tuple]:
    """(gap, left key, right key), taken greedily from lists of (value, key): the least |ln(value ratio)|
    first, then the lesser keys, each row once.

    Rows of equal value are one place.  The next pair is in one place or in two neighbouring ones,
    one of each side, so a heap of neighbours and a linked list of places do, and memory is linear.
    """
    places = sorted({v for v, _ in lefts} | {v for v, _ in rights})
    number = {v: i for i, v in enumerate(places)}
    keys: list[tuple[list, list]] = [([], []) for _ in places]
    for side, rows in enumerate((lefts, rights)):
        for v, key in sorted(rows, reverse=True):  # the least key is the last
            keys[number[v]][side].append(key)
    before, after = list(range(-1, len(places) - 1)), list(range(1, len(places) + 1))
    heap: list[tuple] = []

    def offer(i: int, j: int) -> None:
        """Both ways in which place i's and place j's rows make a pair."""
        if 0 <= i and j < len(places):
            for a, b in {(i, j), (j, i)}:
                if keys[a][0] and keys[b][1]:
                    gap = abs(math.log(places[a] / places[b]))
                    heapq.heappush(heap, (gap, keys[a][0][-1], keys[b][1][-1], a, b))

    for i in range(len(places)):
        offer(i, i)
        offer(i, after[i])
    found = []
    while heap:
        gap, x, y, a, b = heapq.heappop(heap)
        if not keys[a][0] or not keys[b][1] or keys[a][0][-1] != x or keys[b][1][-1] != y:
            continue  # one of the rows is taken; what is left there has been offered anew
        found.append((gap, x, y))
        keys[a][0].pop()
        keys[b][1].pop()
        for i in {a, b}:
            if not keys[i][0] and not keys[i][1]:
                left, right = before[i], after[i]
                if left >= 0:
                    after[left] = right
                if right < len(places):
                    before[right] = left
                offer(left, right)
            else:
                offer(i, i)
                offer(before[i], i)
                offer(i, after[i])
    return found


def matched_pairs(left: DataFrame, right: DataFrame, stratum: str, value: str, key: str) -> DataFrame:
    """Pairs one of each side within a stratum, by ascending |ln(value ratio)|, then keys, each row once.

    A row whose value is null, NaN, infinite, zero or negative has no ratio and is in no pair, as is one
    without a key; null is a stratum.  Keys are distinct within a side.  A stratum is one task, in memory that
    grows with its rows.
    """
    schema = f"{stratum} string, left_key long, right_key long, distance double"

    def pair(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [list(zip(part[value].tolist(), part[key].tolist(), strict=True)) for part in (pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1])]
        return pd.DataFrame([(k[0], x, y, gap) for gap, x, y in closest_pairs(*sides)], columns=[stratum, "left_key", "right_key", "distance"])

    columns = [stratum, F.col(key).cast("long").alias(key), F.col(value).cast("double").alias(value)]
    both = left.select(*columns, F.lit(0).alias("_side")).union(right.select(*columns, F.lit(1).alias("_side")))
    usable = (F.col(value) > 0) & (F.col(value) < float("inf")) & F.col(key).isNotNull()
    return both.where(usable).groupBy(stratum).applyInPandas(pair, schema)


def quota_take(rows: DataFrame, group: str, outcome: str, order: Sequence[str], count: int) -> DataFrame:
    """``count`` rows of each group that keep the outcomes balanced.

    Taken one by one, the next row is of the outcome with the fewest so far, the least of
    equal ones: that is the order of (place within the outcome, outcome).  At most ``count``
    rows of an outcome are ranked together, so a hot group is no hot task in the second window.
    """
    within = Window.partitionBy(group, outcome).orderBy(*order)
    ranked = rows.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= count)
    window = Window.partitionBy(group).orderBy("_place", outcome)
    return ranked.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= count).drop("_place", "_r")


def components(edges: DataFrame, save) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) is linked with.

    Large-star and small-star rounds by joins until nothing changes; ``save`` cuts
    the lineage of a round (a written table in a folder that executors share).
    """
    links = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = save(small.union(root.select("a", F.col("m").alias("b"))).distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


