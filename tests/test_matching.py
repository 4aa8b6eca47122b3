"""Matchings by cluster against matchings of whole episodes, and on long chains."""

from __future__ import annotations

import random
from itertools import combinations, permutations

import pytest

from spanloom.operators import matching, timeline


def segments(rng, episodes, n, reach):
    """Segments that don't overlap within a track."""
    rows = []
    for e in range(episodes):
        points = sorted(rng.sample(range(reach), 2 * n))
        rows += [(e, *points[2 * i : 2 * i + 2]) for i in range(n)]
    return rows


@pytest.mark.parametrize("method", ["ordered", "alignment", "greedy", "most"])
def test_clusters_settle_as_whole_episodes_do(spark, monkeypatch, method):
    monkeypatch.setattr(matching, "REACH", 16)
    rng = random.Random(5)
    schema = "episode long, start long, end long"
    left, right = (spark.createDataFrame(segments(rng, 6, 25, 400), schema).repartition(3) for _ in range(2))
    pairs = timeline.overlaps(left, right).select("episode", "left_start", "left_end", "right_start", "right_end", "iou").where("iou >= 0.05")
    found = matching.settled_segments(pairs, "iou", method, ["episode"]).collect()
    for e in range(6):
        scored = {(r.left_start, r.right_start): r.iou for r in pairs.where(f"episode = {e}").collect()}
        whole = matching.METHODS[method](scored)
        own = [(r.left_start, r.right_start) for r in found if r.episode == e]
        assert len(own) == len(whole)
        assert sum(scored[p] for p in own) == pytest.approx(sum(scored[p] for p in whole)) or method == "most"


def test_islands_of_spans(spark, monkeypatch):
    monkeypatch.setattr(matching, "REACH", 8)
    from pyspark.sql import functions as F

    rng = random.Random(6)
    spans = [(e, s, s + rng.randint(1, 30)) for e in range(3) for s in rng.sample(range(600), 25)] + [(9, 5, 300), (9, 20, 21), (9, 299, 301), (9, 301, 302), (9, 5, 6)]
    rows = spark.createDataFrame(spans, "episode long, s long, t long")
    found = {(r.episode, r.s, r.t): r._cluster for r in matching.clustered(rows, ["episode"], F.col("s"), F.col("t")).collect()}
    assert len(found) == len(set(spans))
    for e in {x[0] for x in spans}:
        reach, first = -1, None
        for s, t in sorted((x[1], x[2]) for x in spans if x[0] == e):
            if s >= reach:
                first = s
            reach = max(reach, t)
            assert found[e, s, t] == first


def test_a_chain_of_contested_pairs(spark):
    """3,000 staggered segments: one cluster, in which every pair contests the next."""
    n = 3000
    left = spark.range(n).selectExpr("0L as episode", "id * 2 as start", "id * 2 + 10 as end")
    right = spark.range(n).selectExpr("0L as episode", "id * 2 + 1 as start", "id * 2 + 11 as end")
    for method in ("most", "ordered", "greedy"):
        assert matching.match_segments(left, right, 0.1, method).count() == n


def test_clusters_that_go_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left = spark.range(400).selectExpr("id % 3 as episode", "id div 3 * 4 as start", "id div 3 * 4 + 3 as end")
        right = spark.range(400).selectExpr("id % 3 as episode", "id div 3 * 4 + 1 as start", "id div 3 * 4 + 6 as end")
        assert matching.match_segments(left, right, 0.1).count() == 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_most_pairs_finds_a_largest_matching():
    rng = random.Random(7)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        edges = {i: sorted(j for j in range(m) if rng.random() < 0.4) for i in range(n)}
        found = matching.most_pairs(edges, n)
        assert all(j in edges[i] for i, j in found)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        largest = next(k for k in range(min(n, m), -1, -1) if any(all(j in edges[i] for i, j in zip(x, y, strict=True)) for x in combinations(range(n), k) for y in permutations(range(m), k)))
        assert len(found) == largest


def test_an_ordered_matching_is_a_best_assignment_of_two_tracks():
    """Segments of a track that don't overlap: no assignment, crossing ones included, is better."""
    rng = random.Random(8)
    for _ in range(150):
        a, b = ([x[1:] for x in segments(rng, 1, rng.randint(1, 4), 30)] for _ in range(2))
        iou = {}
        for x in a:
            for y in b:
                both = min(x[1], y[1]) - max(x[0], y[0])
                if both > 0 and both / (max(x[1], y[1]) - min(x[0], y[0])) >= 0.1:
                    iou[x[0], y[0]] = both / (max(x[1], y[1]) - min(x[0], y[0]))
        best = (0, 0.0)
        for k in range(1, min(len(a), len(b)) + 1):
            for xs in combinations(a, k):
                for ys in permutations(b, k):
                    values = [iou.get((x[0], y[0])) for x, y in zip(xs, ys, strict=True)]
                    if None not in values:
                        best = max(best, (k, sum(values)))
        found = matching.ordered(iou)
        assert (len(found), pytest.approx(sum(iou[p] for p in found))) == best
