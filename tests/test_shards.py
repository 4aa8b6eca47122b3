"""Next-fit shards by blocks against the sequential rule."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.sampling import next_fit_shards


def sequential(rows, most, most_rows):
    found, shard, used, n = {}, {}, {}, {}
    for g, i, *sizes in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        sizes = [s or 0 for s in sizes]
        after = [u + s for u, s in zip(used.get(g, [0] * len(sizes)), sizes)]
        if g not in shard:
            shard[g], n[g] = 0, 0
        elif n[g] + 1 > most_rows or any(u > m for u, m in zip(after, most)):
            shard[g], n[g], after = shard[g] + 1, 0, sizes
        used[g], n[g] = after, n[g] + 1
        found[g, i] = shard[g]
    return found


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_equal_to_the_sequential_rule(spark, width):
    rng = random.Random(width)
    rows = []
    for g, n in (("hot", 1500), ("small", 9), (None, 40)):
        at = 0
        for _ in range(n):
            at += rng.choice((1, 1, 1, 30))  # some blocks are empty
            rows.append((g, at, rng.choice((0.1, 0.7, 3.3, 12.5, 150.0, None)), rng.randint(0, 40)))
    table = spark.createDataFrame(rows, "g string, i long, bytes double, tokens long").repartition(5)
    block = F.floor(F.col("i") / width)
    found = next_fit_shards(table, "g", ["i"], ["bytes", "tokens"], [100.0, 300], 20, block).collect()
    assert len(found) == len(rows)
    assert {(r.g, r.i): r.shard for r in found} == sequential(rows, [100.0, 300], 20)
    one = next_fit_shards(table, "g", ["i"], "bytes", 100.0, 20, block)
    assert {(r.g, r.i): r.shard for r in one.collect()} == sequential([r[:3] for r in rows], [100.0], 20)


def test_no_rows(spark):
    table = spark.createDataFrame([], "g string, i long, bytes double")
    assert next_fit_shards(table, "g", ["i"], "bytes", 1.0, 2, F.col("i")).collect() == []
