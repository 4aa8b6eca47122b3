"""Hard negatives and centroid clusters against plain programs."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import hard_negatives, sort_means
from spanloom.llm.vectors import whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cluster string, norm string, a string, rank string, hash string, part string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def random_rows(n, dims, seed, labels=4, kinds=None):
    rng = np.random.default_rng(seed)
    size = rng.choice([0.1, 1.0, 4.0], n)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, size[i], dims)], int(rng.integers(labels))) for i in range(n)]
    return [(i, rows[i % kinds][1] if kinds and i % 3 == 0 else v, c) for i, v, c in rows]  # a third are copies


def odd_rows(dims):
    good = [0.25] * dims
    return [
        (None, good, 1), (501, None, 1), (502, [float("nan")] * dims, 1), (503, [None, *good[1:]], 1), (504, [float("inf"), *good[1:]], 1),
        (505, good, None), (506, [], 1), (507, good, 1), (507, good, 1), (508, good[1:], 1),
    ]


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def plain_negatives(rows, step):
    items = [(i, c, [int(np.floor(256 * x)) for x in v]) for i, v, c in rows if c is not None and sound(v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, c, v in items:
        if i is None or i % step:
            continue
        score = [(sum(x * y for x, y in zip(v, w, strict=False)), j, d) for j, d, w in items if j != i]
        for s, p, _ in sorted((x for x in score if x[2] == c), key=key)[:5]:
            inside = sorted((x for x in score if x[2] != c and 80 * s <= 100 * x[0] <= 100 * s), key=key)[:5]
            out += [(i, p, k + 1, j, s, t) for k, (t, j, _) in enumerate(inside)]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize(("bucket", "group", "shard"), [(1024, 1 << 16, 1 << 16), (7, 40, 9)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, bucket, group, shard):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    rows = random_rows(400, 6, 5, kinds=9) + odd_rows(6)
    found = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0).drop("positive_rank")
    assert ordered(found.collect()) == ordered(plain_negatives(rows, 10))


def test_hard_negatives_of_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(v * 1000)) for v in e], c) for i, e, c in random_rows(60, 3, 6)]
    found = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 5 == 0).drop("positive_rank")
    assert ordered(found.collect()) == ordered(plain_negatives(rows, 5))


def test_short_vectors_leave_out_no_bucket_that_matters(spark):
    """Buckets are left out only where their longest vector can't reach a limit."""
    queries = hard_negatives._Search(2, True)
    import pyarrow as pa

    column = lambda x, t: pa.array(x, t)
    lists = pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays(
        [column([1], pa.int64()), column([0], pa.int64()), column([0], pa.int64()), column([5.0], pa.float64()), column([[3, 4]], lists), column([[-hard_negatives.MOST]], lists), column([[hard_negatives.MOST]], lists)],
        names=list(hard_negatives.QUERY),
    )

    class Fails:
        shape = (1, 2)

        def astype(self, *_):
            raise AssertionError("a bucket out of reach was read")

        T = property(lambda self: self)

    near = (10.0, np.array([7, 8]), np.array([0, 0]), np.array([[6, 8], [6, 8]]))
    far = (1.0, np.array([9]), np.array([0]), Fails())
    assert queries.search(batch, [near, far]).column("vec_id").to_pylist() == [7, 8]


def test_hard_negatives_of_nothing(spark):
    none = vectors(spark, [])
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    lone = vectors(spark, [(0, [1.0, 2.0], 3), (10, [1.0, 2.0], 4)])
    assert hard_negatives.hard_negatives(lone, F.col("vec_id") % 10 == 0).count() == 0


def plain_clusters(rows, k, rounds, dims):
    points = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if sound(v) and len(v) == dims]
    name = lambda i: "null" if i is None else str(i)
    centroids = [v for _, v in sorted(points, key=lambda p: (hashlib.sha256(f"3:{name(p[0])}".encode()).hexdigest(), p[1]))[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((d(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in points]
        for j in range(len(centroids)):
            if members := [v for (_, v), c in zip(points, own, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in points]
    each = [sum(s for _, c, s in found if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, s, each[c], sum(each), digest[c]) for i, c, s in found]


@pytest.mark.parametrize("n", [3, 300])
def test_clusters_equal_brute_force(spark, n):
    rows = random_rows(n, 4, 7, kinds=9) + odd_rows(4)
    found = sort_means.clusters(vectors(spark, rows), dims=4, rounds=6).drop("looked")
    assert ordered(found.collect()) == ordered(plain_clusters(rows, 8, 6, 4))


def test_scans_stop_early_and_at_ties_go_on():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (8, 2))
    x = centres[rng.integers(0, 8, 500)] + rng.integers(-200, 200, (500, 2))
    before = rng.integers(0, 8, 500)
    cluster, distance, _ = sort_means.reassign(x, before, centres)
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all()
    assert (distance == every.min(1)).all()
    assert sort_means.reassign(x, cluster, centres)[2].mean() < 4  # of 8
    tie = sort_means.reassign(np.array([[0, 0]]), np.array([1]), np.array([[2, 0], [-2, 0]]))
    assert tie[0][0] == 0  # the other centroid is at exactly twice the distance


def test_clusters_of_nothing_and_components_that_are_too_large(spark):
    assert sort_means.clusters(vectors(spark, []), dims=4).count() == 0
    with pytest.raises(Exception, match="scales to over"):
        whole_vectors(vectors(spark, [(1, [1e30], 1)]), 256).collect()
