"""Scans by block, order statistics and the shift null against plain programs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import scans, shifts, stats, timeline
from spanloom.operators.quantiles import quantiles


def test_runs_across_blocks(spark):
    rng, width = random.Random(5), 4
    rows, wanted = [], []
    for episode in (1, 2, None):
        state, last = None, None
        for f in range(200):
            v = rng.choice((True, True, False, None))
            if rng.random() < 0.1:
                last = None  # a missing frame
                continue
            rows.append((episode, f, v))
            if v is None:
                last = None
            elif last == f - 1 and v == state:
                wanted[-1][2] = f + 1
                last = f
            else:
                wanted.append([episode, f, f + 1, v])
                state, last = v, f
    frames = spark.createDataFrame(rows, "episode long, frame long, v boolean")
    for w in (width, 1, 1000):
        found = scans.runs(frames, "v", ["episode"], w).collect()
        assert sorted(map(repr, map(list, found))) == sorted(map(repr, wanted))


def test_one_long_run_is_one_run(spark):
    frames = spark.range(1000).select(F.lit(1).alias("episode"), F.col("id").alias("frame"), F.lit(True).alias("v"))
    assert [tuple(r) for r in scans.runs(frames, "v", ["episode"], 8).collect()] == [(1, 0, 1000, True)]
    assert scans.runs(frames.limit(0), "v", ["episode"], 8).collect() == []


def test_last_known_and_sums_by_block(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice((None, None, None, rng.randint(0, 9)))) for k in (1, None) for i in range(300)]
    wanted = {}
    for k in (1, None):
        last, total = None, 0
        for i, v in ((i, v) for key, i, v in rows if key == k):
            last = v if v is not None else last
            wanted[k, i] = (last, total)
            total += v or 0
    table = spark.createDataFrame(rows, "k long, i long, v long")
    block = scans.frames_block("i", 16)
    filled = {(r.k, r.i): r.v for r in scans.last_known(table, "v", ["k"], ["i"], block).collect()}
    sums = {(r.k, r.i): r.before_v for r in scans.sums_before(table, ["i"], ["v"], ["k"], block).collect()}
    assert filled == {key: w[0] for key, w in wanted.items()}
    assert sums == {key: w[1] for key, w in wanted.items()}


def test_a_hot_episode_is_many_groups(spark):
    frames = spark.range(300_000).select(F.lit(1).alias("episode"), F.col("id").alias("frame"), (F.col("id") % 3 == 0).alias("v"))
    found = timeline.to_runs(frames, "v")
    assert found.count() == 200_000
    assert frames.select(scans.frames_block("frame")).distinct().count() == 5
    plan = found._jdf.queryExecution().toString()
    assert "_block" in plan and "_alone" in plan


def test_states_as_of_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    states = spark.createDataFrame([(i % 3, rng.randint(0, 99) * 10, float(i)) for i in range(60)], "episode long, at long, value double")
    states = states.dropDuplicates(["episode", "at"])
    events = spark.createDataFrame([(i % 3, rng.randint(0, 999), i) for i in range(200)], "episode long, at long, id long")
    plain = {r.id: r.value for r in timeline.as_of(events, states).collect()}
    assert plain == {r.id: r.value for r in timeline.as_of(events, states, block=F.floor(F.col("at") / 50)).collect()}
    assert any(v is not None for v in plain.values())


@pytest.mark.parametrize("most", [1, 40, 1_000_000])
def test_quantiles_by_refinement(spark, most):
    rng = random.Random(11)
    values = {"hot": [rng.gauss(0, 1) * 10 ** rng.randint(-3, 6) for _ in range(4000)], "ties": [1.0] * 900 + [2.0] * 3, "one": [5.0], None: [0.0, 1.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("hot", None), ("empty", None)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(3)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    found = {r.k: r for r in quantiles(table, "v", probs, ["k"], most=most, ranges=16).collect()}
    assert set(found) == set(values)
    for k, vs in values.items():
        assert found[k].n == len(vs)
        assert found[k].q == pytest.approx(list(np.quantile(vs, probs)))


def test_quantiles_with_weights_and_odd_values(spark):
    rows = [(3.0, 2), (1.0, 3), (9.0, 0), (7.0, -1), (None, 4), (4.0, None)]
    table = spark.createDataFrame(rows, "v double, w long")
    assert [tuple(r) for r in quantiles(table, "v", [0.5, 0.75], weight="w").collect()] == [(5, [1.0, 3.0])]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.0,)], "v double")
    low, middle, high = quantiles(odd, "v", [0.0, 0.5, 1.0], most=1, ranges=4).first().q
    assert (low, middle) == (0.0, float("inf")) and math.isnan(high)
    assert quantiles(table.limit(0), "v", [0.5]).collect() == []
    assert quantiles(table.limit(0), "v", [0.5], ["w"]).collect() == []


def test_summary_of_a_key_without_values(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0)], "k string, v double")
    found = {r.k: tuple(r)[1:] for r in stats.summary(table, "v", ["k"]).collect()}
    assert found["b"] == (0, None, None, None, None, None)
    assert found[None] == (1, 4.0, 0.0, 4.0, 4.0, 4.0)
    assert found["a"][0] == 2 and found["a"][4] == 1.5


TRACKS = {
    "random": ([i * 7919 % 11 < 4 for i in range(97)], [i * 104729 % 13 < 6 for i in range(97)]),
    "one run": ([10 <= i < 20 for i in range(40)], [15 <= i < 30 for i in range(40)]),
    "wraps": ([i < 5 or i >= 35 for i in range(40)], [i >= 30 for i in range(40)]),
    "all and some": ([True] * 12, [i % 2 == 0 for i in range(12)]),
    "none and some": ([False] * 9, [i < 2 for i in range(9)]),
    "neither": ([False] * 6, [False] * 6),
    "one frame": ([True], [True]),
}


@pytest.mark.parametrize("width", [5, 65_536])
def test_shift_null_from_runs(spark, width):
    rows = [(name, len(a), i, x, y) for name, (a, b) in TRACKS.items() for i, (x, y) in enumerate(zip(a, b))]
    frames = spark.createDataFrame(rows, "episode string, n_frames long, frame long, a boolean, b boolean")
    sizes = stats.track_sizes(frames, "a", "b", ["episode"])
    sides = [timeline.to_runs(frames, c).where("state") for c in "ab"]
    cut = shifts.pieces(*sides, sizes, width=width)
    walks = {name: {} for name in TRACKS}
    for r in cut.collect():
        for k in range(r.shift, r.until):
            assert k not in walks[r.episode]
            walks[r.episode][k] = r.value + r.slope * (k - r.shift)
    over = {name: [sum(x and b[i - k] for i, x in enumerate(a)) for k in range(len(a))] for name, (a, b) in TRACKS.items()}
    assert {name: [walks[name][k] for k in sorted(walks[name])] for name in TRACKS} == over

    found = {(r.episode, r.exclusion): r for r in shifts.null_statistics(cut, sizes, [0.0, 0.1, 0.25]).collect()}
    for name, (a, b) in TRACKS.items():
        for x in (0.0, 0.1, 0.25):
            n, den = len(a), sum(a) + sum(b)
            kept = [k for k in range(n) if math.ceil(x * n) <= k <= math.floor((1 - x) * n)]
            if not den or not kept:
                assert (name, x) not in found
                continue
            row, counts, seen = found[name, x], np.array([over[name][k] for k in kept]), over[name][0]
            null = 2 * counts / den
            assert row.shifts == len(kept)
            assert [row.raw, row.null_mean, row.null_sd, row.null_q05, row.null_q50, row.null_q95] == pytest.approx(
                [2 * seen / den, null.mean(), null.std(), *np.quantile(null, [0.05, 0.5, 0.95])], abs=1e-9
            )
            assert row.percentile == pytest.approx(np.mean(counts < seen) + np.mean(counts == seen) / 2)
            assert row.excess == pytest.approx(row.raw - null.mean(), abs=1e-9)
            assert (row.z is None) == (null.std() < 1e-8)
            assert (row.anchor is None) == (1 - null.mean() <= 1e-10)


def test_null_mean_adds_doubles_from_the_last_shift(spark):
    """The SQL's mean adds doubles; 51 / 640 is half-way between two rounded values, and the sum is below it."""
    n, counts = 64, [(k * 7) % 5 for k in range(64)]
    cut = spark.createDataFrame([("x", n, counts[0], k, k + 1, v, 0) for k, v in enumerate(counts)], "episode string, n_frames long, observed long, shift long, until long, value long, slope long")
    sizes = spark.createDataFrame([("x", n, 30, 19)], "episode string, n_frames long, na long, nb long")
    row = shifts.null_statistics(cut, sizes).first()
    total = 0.0
    for v in reversed(counts):
        total += 2 * v / 49
    assert row.null_mean == total / n != 2 * sum(counts) / (49 * n)
