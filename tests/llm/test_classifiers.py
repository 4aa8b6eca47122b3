"""Classifiers: fitted parameters against known ones, and held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np

from spanloom.llm import quality, toxicity

from .conftest import TEXTS

LARGE = "/root/testdata/sf0.01"


def test_quadratic_scores_follow_the_densities():
    rng = np.random.default_rng(2)
    parts = [rng.normal(m, s, (4000, 2)) for m, s in ((0.0, 1.0), (1.5, 2.0))]
    n = np.array([len(p) for p in parts], float)
    model = quality.QuadraticModel.from_sums(n, np.array([p.sum(0) for p in parts]), np.array([p.T @ p for p in parts]))
    x = np.array([[0.0, 0.0], [5.0, 5.0], [-5.0, -5.0]])
    score = model.score(x)
    assert score[0] < 0.5 < score[1]
    assert score[2] > 0.5  # the wide class holds both tails


def test_op3_held_out_accuracy(spark):
    found = quality.op3_quality(spark, LARGE).toPandas()
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas()
    assert found["score"].between(0, 1).all()
    both = found[found["held_out"]].merge(labels, on="doc_id")
    assert (both["predicted"] == both["quality"]).mean() > 0.95


def test_op3_against_plain_log_densities(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"].fillna("")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    x = {i: np.array(quality.statistics(text)) for i, text in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in x}
    classes = [np.array([x[i] for i, q in labels.items() if q == c and not held[i]]) for c in (0, 1)]
    own = [np.cov(part.T, bias=True) for part in classes]
    n = np.array([len(part) for part in classes])
    pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
    density = []
    for part, cov in zip(classes, own, strict=True):
        cov = (1 - quality.TO_POOLED) * cov + quality.TO_POOLED * pooled
        cov = (1 - quality.TO_DIAGONAL) * cov + quality.TO_DIAGONAL * np.diag(np.maximum(np.diag(pooled), 1e-6))
        away = np.array(list(x.values())) - part.mean(axis=0)
        square = (away * np.linalg.solve(cov, away.T).T).sum(axis=1)
        density.append(np.log(len(part) / n.sum()) - 0.5 * (np.linalg.slogdet(cov)[1] + square))
    z = np.clip((density[1] - density[0]) / quality.TEMPERATURE, -60, 60)
    wanted = dict(zip(x, 1 / (1 + np.exp(-z)), strict=True))
    found = quality.op3_quality(spark, sf).collect()
    assert len(found) == len(x) and all(r.held_out == held[r.doc_id] for r in found)
    assert np.allclose([r.score for r in found], [wanted[r.doc_id] for r in found], atol=1e-6)
    assert all(r.predicted == int(r.score >= 0.3) for r in found)


def test_op3_odd_rows(odd, none):
    assert quality.document_statistics(odd).count() == len(TEXTS)
    assert all(np.isfinite(r.x).all() for r in quality.document_statistics(odd).collect())
    assert quality.document_statistics(none).count() == 0
    assert {r.score for r in quality.scores(quality.document_statistics(odd), None).collect()} == {1.0}


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.integers(0, 2, (n, 3)).astype(float)
    z = x @ [2.0, -1.0, 0.0] + rng.logistic(size=n)
    grades = np.searchsorted([0.0, 1.5, 3.0], z)
    rows, columns = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, np.ones(n), 3)
    assert np.allclose(w, [2, -1, 0], atol=0.25)
    assert np.allclose(t, [0, 1.5, 3], atol=0.25)


def test_gradient_of_the_likelihood_vanishes_at_the_fit():
    rng = np.random.default_rng(4)
    n, ridge = 600, 1e-2
    x = rng.integers(0, 3, (n, 4)).astype(float)
    grades = np.searchsorted([0.5, 2.0, 3.0], x @ [1.0, -0.5, 0.3, 0.0] + rng.logistic(size=n))
    weights = np.where(grades > 0, 0.5, 1.0)
    rows, columns = np.nonzero(x)

    def objective(w, t):
        above = np.c_[np.ones(n), 1 / (1 + np.exp(t - (x @ w)[:, None])), np.zeros(n)]
        chance = above[np.arange(n), grades] - above[np.arange(n), grades + 1]
        return (weights * np.log(chance)).sum() / weights.sum() - ridge * (w**2).sum() / 2

    w, t = toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, weights, 4, ridge=ridge, steps=2000)
    for i, h in [(i, h) for i in range(7) for h in (1e-4, -1e-4)]:
        moved = np.r_[w, t]
        moved[i] += h
        assert (objective(moved[:4], moved[4:]) - objective(w, t)) / abs(h) < 2e-3


def test_best_cut_by_hand():
    p, toxic = np.array([0.9, 0.6, 0.6, 0.3, 0.2, 0.1]), np.array([1, 1, 0, 1, 0, 0])
    assert toxicity.best_cut(p, toxic, np.ones(6)) == 0.25  # recall 1, false alarms 1/3
    assert toxicity.best_cut(p, toxic, np.array([1.0, 1, 100, 1, 1, 1])) == 0.75  # recall 1/3, no false alarm


def test_op5_on_rows_that_the_fit_never_saw(spark):
    large = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    held = labels.where("crc32(cast(doc_id as string)) % 5 = 0").withColumnRenamed("toxic", "label")
    found = toxicity.graded(docs, model).join(held, "doc_id").toPandas()
    assert found.loc[found["label"] == 1, "toxic"].mean() >= 0.9
    assert found.loc[found["label"] == 0, "toxic"].mean() <= 0.03


def test_op5_columns(spark):
    found = toxicity.op5_toxicity(spark, LARGE).toPandas()
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas()
    both = found.merge(labels.rename(columns={"toxic": "label"}), on="doc_id")
    assert both.loc[both["label"] == 1, "toxic"].mean() > 0.9
    assert both.loc[both["label"] == 0, "toxic"].mean() < 0.03
    assert found["expected_severity"].between(0, toxicity.GRADES - 1).all()
    assert ((found["grade"] > 0) == found["toxic"]).all()
    assert (found["toxic"] != found["kept"]).all()
    clean = toxicity.clean_documents(spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet"))
    assert {r.doc_id for r in clean.select("doc_id").collect()} == set(found.loc[found["kept"], "doc_id"])


def test_op5_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (9, 0), (12, 0), (None, 1), (99, 1), (8, None)], "doc_id long, toxic int")
    assert toxicity.clean_documents(odd, labels).columns == odd.columns
    only = labels.where("toxic = 0")
    assert toxicity.clean_documents(odd, only).count() == len(TEXTS)
    assert toxicity.clean_documents(none, labels).count() == 0
