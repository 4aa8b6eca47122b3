"""Closest pairs against the greedy rule over all pairs."""

from __future__ import annotations

import math
import random

import pytest

from spanloom.operators.sampling import closest_pairs, matched_pairs
from spanloom.plans.registry import QUERIES


def greedy(lefts, rights):
    order = sorted((abs(math.log(v / w)), x, y) for v, x in lefts for w, y in rights)
    found, used = [], (set(), set())
    for gap, x, y in order:
        if x not in used[0] and y not in used[1]:
            used[0].add(x)
            used[1].add(y)
            found.append((gap, x, y))
    return found


def test_equal_to_the_greedy_rule():
    rng = random.Random(8)
    for round_ in range(400):
        values = [float(2 ** rng.randint(0, 6)) if round_ % 2 else rng.uniform(1, 50) for _ in range(rng.randint(1, 40))]
        sides = [[(rng.choice(values), key) for key in rng.sample(range(100), rng.randint(0, 30))] for _ in "lr"]
        assert closest_pairs(*sides) == greedy(*sides)


def test_odd_rows(spark):
    schema = "s string, id long, v double"
    left = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 4.0), ("a", 3, None), ("a", 4, -2.0), (None, 5, 1.0), ("a", None, 4.0), ("b", 6, 1.0)], schema)
    right = spark.createDataFrame([("a", 1, 2.0), ("a", 9, 0.0), ("a", 8, float("nan")), (None, 5, 1.0), ("a", 7, float("inf"))], schema)
    found = matched_pairs(left, right, "s", "v", "id").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [("a", 2, 1, math.log(2)), (None, 5, 5, 0.0)]))
    assert matched_pairs(left.limit(0), right, "s", "v", "id").collect() == []


def test_registered_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    strata = {}
    for r in rows.select("source", "doc_id", "n_chars", "quality").collect():
        if r.n_chars and r.quality in (0, 1):
            strata.setdefault(r.source, ([], []))[r.quality].append((float(r.n_chars), r.doc_id))
    found = {}
    for r in QUERIES["jn14_matched_pairs"](spark, sf).collect():
        found.setdefault(r.source, []).append((r.distance, r.left_key, r.right_key))
    assert sum(map(len, found.values())) > 0
    for source, sides in strata.items():
        wanted = greedy(*sides)
        assert sorted(p[1:] for p in found.get(source, [])) == sorted(p[1:] for p in wanted)
        assert sorted(p[0] for p in found.get(source, [])) == pytest.approx(sorted(p[0] for p in wanted))
