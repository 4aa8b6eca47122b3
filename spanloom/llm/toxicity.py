"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the words of a text, without case and outer punctuation, and their
beginnings of four to six letters; a feature counts with the logarithm of one
plus its occurrences.  P(grade > k) is the logistic function of w.x - t_k: all
thresholds t_0 < t_1 < ... share the weights w.  A document's severity is the
expected grade, the sum of these probabilities.  It is toxic when P(grade > 0) is
at least the model's cut: that at which recall less false alarms is largest on
labelled rows which the scoring fit hasn't seen (FOLDS fits, each with features of
its own).

The classifier is fitted on at most ``SAMPLE`` labelled documents of each class
(the lowest hashes of their ids; weights restore the classes' shares).  Labels
only tell toxic from clean, so a toxic document's grade, from 1 to GRADES - 1, is
the quantile of the density of features that mark the toxic class.  Scoring reads
every text whole, in one pass without a shuffle.

Cases: a null or empty text has no features; without labels of both classes no
document is toxic; labels that are null or belong to no document are left out; a
doc_id with several labels counts once, with its highest, and one of several
labelled texts, the smallest; a very long text is one row, read word by word, and
its words of over 64 characters aren't kept; repeated rows and ties have equal
scores; an empty table gives no rows; other columns pass through ``scored``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import SLICE, documents, map_rows, saved, text_of
from .tokens import Memo

GRADES = 4
#: Labelled documents of each class that the classifier is fitted on, at most.
SAMPLE = 10_000
#: Features at most: those that tell the classes apart best.
FEATURES = 4096
#: A feature occurs in so many sampled documents, and is so many times as common in one class.
LEAST_DOCUMENTS, LEAST_LIFT = 5, 4.0
PREFIXES = (4, 5, 6)
#: Weight of the squared weights against the mean log-likelihood, chosen on held-out labels.
RIDGE = 1e-3
STEPS = 300
#: Parts of the sample that are scored by a fit on the others, for the cut.
FOLDS = 3
OUTER = ".,;:!?\"'()[]{}<>«»“”‘’¡¿…*-_"


def word_features(chunk: str) -> tuple[str, ...]:
    word = chunk.strip(OUTER).lower()
    if not word:
        return ()
    return (word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n))


@dataclass(frozen=True)
class OrdinalModel:
    """A weight for each feature, the thresholds and the cut."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    #: A document is toxic from this P(grade > 0) on.
    cut: float = 0.5

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), one column for each threshold."""
        z = np.subtract.outer(score, np.array(self.thresholds))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def features_of(text: str, known: Memo) -> Counter:
    """Counts of the known features of a text."""
    found: Counter = Counter()
    for features in map(known.__getitem__, text.split()):
        if features:
            found.update(features)
    return found


def known_features(names) -> Memo:
    return Memo(lambda chunk: tuple(f for f in word_features(chunk) if f in names), 50_000, "toxicity")


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray,
    weights: np.ndarray, n_features: int, *, ridge: float = RIDGE, steps: int = STEPS,
) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, thresholds) of the penalised likelihood, by Adam.

    rows, columns, values: the sparse features.  Thresholds are kept in order by
    their form: the first one, and logarithms of the gaps.
    """
    n, levels = len(grades), int(grades.max())
    total = weights.sum()
    share = [(weights * (grades > k)).sum() / total for k in range(levels)]
    start = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate([np.zeros(n_features), start[:1], gaps])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, low, gap = x[:n_features], x[n_features], np.exp(x[n_features + 1 :])
        t = low + np.r_[0, np.cumsum(gap)]
        score = np.bincount(rows, values * w[columns], minlength=n)
        # P(grade = k) is a difference of two neighbouring logistic functions
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - t, -40, 40)))
        above = np.c_[np.ones(n), p, np.zeros(n)]
        slope = np.c_[np.zeros(n), p * (1 - p), np.zeros(n)]
        at = np.arange(n)
        chance = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        up, down = slope[at, grades] / chance, slope[at, grades + 1] / chance
        by_score = weights * (up - down)
        by_t = np.zeros((n, levels + 2))
        by_t[at, grades] -= weights * up
        by_t[at, grades + 1] += weights * down
        dt = by_t[:, 1 : levels + 1].sum(axis=0)
        dw = np.bincount(columns, values * by_score[rows], minlength=n_features)
        rest = np.cumsum(dt[::-1])[::-1]
        gradient = np.concatenate([dw, [rest[0]], rest[1:] * gap]) / total
        gradient[:n_features] -= ridge * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * (1 - step / (steps + 1))
        x = x + rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return x[:n_features], x[n_features] + np.r_[0, np.cumsum(np.exp(x[n_features + 1 :]))]


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Saved (doc_id, text, toxic, fold) of the sampled labelled documents, and the labels' class counts."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    chosen = parts[0].union(parts[1])  # 2 * SAMPLE rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return saved(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")), "toxic-sample"), counts


@dataclass
class _Sample:
    """The sampled documents' features on the driver: at most 2 * SAMPLE rows of known features."""

    toxic: np.ndarray
    fold: np.ndarray
    words: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    counted: np.ndarray
    weights: np.ndarray

    def fitted(self, chosen: np.ndarray, marks: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, thresholds) on the rows ``train``, for the features ``chosen``."""
        local = np.full(int(self.columns.max(initial=0)) + 1 + len(chosen), -1)
        local[chosen] = np.arange(len(chosen))
        place = np.cumsum(train) - 1
        use = train[self.rows] & (local[self.columns] >= 0)
        rows, columns, counted = place[self.rows[use]], local[self.columns[use]], self.counted[use]
        toxic, n = self.toxic[train], int(train.sum())
        density = np.bincount(rows, counted * marks[columns], minlength=n) / np.maximum(1, self.words[train])
        bounds = np.quantile(density[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
        grades = np.where(toxic == 1, 1 + np.searchsorted(bounds, density, side="right"), 0)
        return fit_ordinal(rows, columns, np.log1p(counted), grades, self.weights[train], len(chosen))

    def scores(self, chosen: np.ndarray, w: np.ndarray) -> np.ndarray:
        full = np.zeros(int(self.columns.max(initial=0)) + 1 + len(chosen))
        full[chosen] = w
        return np.bincount(self.rows, np.log1p(self.counted) * full[self.columns], minlength=len(self.toxic))


def best_cut(p: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The cut at which recall less the rate of false alarms is largest; the middle between
    the two probabilities around it, and the highest of equally good ones."""
    order = np.argsort(-p, kind="stable")
    p, toxic, weights = p[order], toxic[order], weights[order]
    gain = np.cumsum(weights * (toxic == 1)) / (weights * (toxic == 1)).sum()
    loss = np.cumsum(weights * (toxic == 0)) / (weights * (toxic == 0)).sum()
    last = np.flatnonzero(np.r_[p[1:] != p[:-1], True])  # equal probabilities fall together
    at = last[np.argmax((gain - loss)[last])]
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2)


NO_MODEL = (60.0,) * (GRADES - 1)


def fit(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    sample, counts = labelled_sample(docs, labels)

    def presence(found: Iterator[tuple]) -> Iterator[tuple]:
        seen: Counter = Counter()
        cut = Memo(word_features, 50_000, "toxicity")
        for _, text, toxic, fold in found:
            for feature in {f for chunk in set(text.split()) for f in cut[chunk]}:
                seen[feature, toxic, fold] += 1
            if len(seen) > 500_000:
                yield from ((*key, n) for key, n in seen.items())
                seen.clear()
        yield from ((*key, n) for key, n in seen.items())

    total = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    size = {c: sum(n for (k, _), n in total.items() if k == c) for c in (0, 1)}
    if not size[0] or not size[1]:
        return OrdinalModel({}, NO_MODEL)
    each = map_rows(sample, presence, "feature string, class int, fold int, n long")
    part = lambda condition, name: F.sum(F.expr(f"if({condition}, n, 0)")).alias(name)
    held = [part(f"class = {c} and fold = {k}", f"n{c}_{k}") for c in (0, 1) for k in range(FOLDS)]
    table = each.groupBy("feature").agg(part("class = 0", "n0"), part("class = 1", "n1"), *held)
    table = saved(table.where(F.col("n0") + F.col("n1") >= LEAST_DOCUMENTS), "toxic-features")

    def best(fold: int | None) -> list:
        """The features that tell the classes apart best outside a fold."""
        out = 0 if fold is None else 1
        n = {c: size[c] - out * total.get((c, fold), 0) for c in (0, 1)}
        shares = [(F.col(f"n{c}") - (F.col(f"n{c}_{fold}") if out else 0) + 0.5) / (n[c] + 1) for c in (0, 1)]
        shares = table.select("feature", shares[0].alias("p0"), shares[1].alias("p1"))
        shares = shares.where(F.greatest(F.expr("p1 / p0"), F.expr("p0 / p1")) >= LEAST_LIFT)
        order = F.abs(F.expr("(p1 - p0) / sqrt(p1 + p0)")).desc()
        return shares.orderBy(order, "feature").limit(FEATURES).collect()

    sets = {fold: best(fold) for fold in (None, *range(FOLDS))}
    if not sets[None]:
        return OrdinalModel({}, NO_MODEL)
    index = {f: i for i, f in enumerate(dict.fromkeys(r["feature"] for rows in sets.values() for r in rows))}

    def sparse(found: Iterator[tuple]) -> Iterator[tuple]:
        known = known_features(index)
        for doc_id, text, toxic, fold in found:
            counted = features_of(text, known)
            columns = np.array([index[f] for f in counted], "<i4").tobytes()
            yield doc_id, toxic, fold, len(text.split()), columns, np.array(list(counted.values()), "<f4").tobytes()

    schema = "doc_id long, toxic int, fold int, words long, columns binary, counts binary"
    data = map_rows(sample, sparse, schema).orderBy("doc_id").collect()  # as many rows as the sample
    columns = [np.frombuffer(r["columns"], "<i4") for r in data]
    toxic = np.array([r["toxic"] for r in data])
    shares = np.array([counts[c] / size[c] for c in (0, 1)])
    known = _Sample(
        toxic,
        np.array([r["fold"] for r in data]),
        np.array([r["words"] for r in data]),
        np.repeat(np.arange(len(data)), [len(c) for c in columns]),
        np.concatenate(columns).astype(np.int64),
        np.concatenate([np.frombuffer(r["counts"], "<f4") for r in data]).astype(float),
        shares[toxic] / shares.max(),
    )
    chosen = {k: np.array([index[r["feature"]] for r in rows], np.int64) for k, rows in sets.items()}
    marks = {k: np.array([r["p1"] > r["p0"] for r in rows], bool) for k, rows in sets.items()}
    outside = np.full(len(data), np.nan)
    for k in range(FOLDS):
        train = known.fold != k
        if len(chosen[k]) and {0, 1} <= set(toxic[train].tolist()):
            w, t = known.fitted(chosen[k], marks[k], train)
            p = OrdinalModel({}, tuple(t.tolist())).probabilities(known.scores(chosen[k], w))[:, 0]
            outside[~train] = p[~train]
    seen = ~np.isnan(outside)
    both = {0, 1} <= set(toxic[seen].tolist())
    cut = best_cut(outside[seen], toxic[seen], known.weights[seen]) if both else 0.5
    w, t = known.fitted(chosen[None], marks[None], np.ones(len(data), bool))
    weights = {r["feature"]: float(x) for r, x in zip(sets[None], w, strict=True)}
    return OrdinalModel(weights, tuple(t.tolist()), cut)


def scored(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with __sl_grades: P(grade > k) for each threshold; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    at = docs.columns.index("text")
    names = [*docs.columns, "__sl_grades"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known, weights = known_features(model.weights), model.weights
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                scores = [
                    sum(weights[f] * log1p(n) for f, n in sorted(features_of(t or "", known).items()))
                    for t in part.column(at).to_pylist()
                ]
                grades = model.probabilities(np.array(scores, float)).tolist()
                grades = pa.array(grades, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, grades], names=names)

    schema = StructType([*docs.schema.fields, StructField("__sl_grades", ArrayType(DoubleType()))])
    return docs.mapInArrow(score, schema)


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    model = fit(docs, labels)
    return scored(docs, model).where(F.col("__sl_grades")[0] < model.cut).select(*docs.columns)


def graded(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, p_toxic, expected_severity, grade, toxic and kept of every document."""
    p = F.col("__sl_grades")[0]
    toxic = p >= model.cut
    above = F.size(F.filter("__sl_grades", lambda x: x >= 0.5))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        p.alias("p_toxic"),
        F.aggregate("__sl_grades", F.lit(0.0), lambda a, b: a + b).alias("expected_severity"),
        F.when(toxic, F.greatest(above, F.lit(1))).otherwise(0).alias("grade"),
        toxic.alias("toxic"),
        (~toxic).alias("kept"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return graded(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
