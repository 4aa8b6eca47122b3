"""Document quality by regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics: sizes, shares of character
classes, repetition and compressibility.  Each class has a normal density whose
covariance is shrunk towards the pooled one and towards its diagonal.  A score is
the logistic function of the difference of the classes' log-densities (Mahalanobis
distances by cached Cholesky factors) plus that of their shares, divided by a
temperature, since the statistics depend on each other.

Means and covariances are sums over all labelled training rows, added up by
Spark, one row for each class and pair of statistics.

Cases: a null or empty text has the statistics of no text, and a score; labels
that are null or belong to no document are left out; without labels of both classes
every score is 1; rows that are repeated are scored and, when labelled,
counted each; an empty table gives no rows; other columns are ignored; a very long
text is read whole, by one task; rows of equal statistics have equal scores, and a
score equal to the threshold is predicted as 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import documents, map_rows, saved, text_of

#: Shrinkage to the pooled covariance and to its diagonal, and the temperature of scores.
TO_POOLED, TO_DIAGONAL, TEMPERATURE = 0.05, 0.02, 4.0
THRESHOLD = 0.3
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOPS = np.isin(_BYTES, list(b".,;:?'\""))
_MARKS = (_BYTES > 32) & (_BYTES < 127) & ~(_UPPER | _LOWER | _DIGIT | _STOPS)
_WIDE = _BYTES >= 128


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text."""
    data = text.encode()
    size = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [line for line in data.split(b"\n") if line]
    n_words, n_lines = len(words), len(lines)
    seen = Counter(words)
    log = lambda part, whole: float(np.log((part + 0.5) / (whole + 1)))
    p = counts[counts > 0] / max(size, 1)
    letters = counts[_UPPER | _LOWER | _WIDE].sum()
    line_words = np.array([line.count(b" ") + 1 for line in lines] or [0])
    return [
        float(np.log1p(size)),
        float(np.log1p(n_words)),
        float(np.log1p(n_lines)),
        float(np.log((size + 1) / (n_words + 1))),
        log(counts[_UPPER].sum(), letters),
        log(counts[_DIGIT].sum(), size),
        log(counts[_STOPS].sum(), n_words),
        log(counts[_MARKS].sum(), size),
        log(counts[33], n_words),
        log(counts[124], n_words),
        log(counts[_WIDE].sum(), size),
        log(len(seen), n_words),
        log(max(seen.values(), default=0), n_words),
        log(n_lines - len(set(lines)), n_lines),
        float(np.log1p(line_words.std())),
        float(-(p * np.log2(p)).sum()),
        float(np.log((len(zlib.compress(data, 1)) + 1) / (size + 12))),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics; no shuffle."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in found:
            yield doc_id, statistics(text)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(columns, rows, "doc_id long, x array<double>")


@dataclass(frozen=True)
class QuadraticModel:
    """For each class the mean, the inverse of the Cholesky factor and the log-determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    @classmethod
    def from_sums(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> QuadraticModel:
        """n, sums and sums of outer products, a row for each of the two classes."""
        means = sums / n[:, None]
        own = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
        scale = np.maximum(np.diag(pooled), 1e-6)
        factors, offsets = [], []
        for c in (0, 1):
            shrunk = (1 - TO_POOLED) * own[c] + TO_POOLED * pooled
            shrunk = (1 - TO_DIAGONAL) * shrunk + TO_DIAGONAL * np.diag(scale)
            factor = np.linalg.cholesky(shrunk)
            factors.append(np.linalg.inv(factor))
            offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(factors), np.array(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        density = [
            self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1)
            for c in (0, 1)
        ]
        z = np.clip((density[1] - density[0]) / TEMPERATURE, -60, 60)
        return 1 / (1 + np.exp(-z))


def fit(labelled: DataFrame) -> QuadraticModel | None:
    """The model of a frame with x and label (0 or 1)."""

    def partial(found: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[int, np.ndarray] = {}
        for x, label in found:
            row = np.r_[1.0, x]
            sums[label] = sums.get(label, 0) + np.outer(row, row)
        for label, total in sums.items():
            yield from ((label, i, v) for i, v in enumerate(total.reshape(-1).tolist()))

    parts = map_rows(labelled.select("x", "label"), partial, "label long, i long, v double")
    rows = parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (d + 1)^2 rows
    if {r["label"] for r in rows} != {0, 1}:
        return None
    d = round(max(r["i"] for r in rows) + 1) ** 0.5
    table = np.zeros((2, round(d) ** 2))
    for r in rows:
        table[r["label"], r["i"]] = r["v"]
    table = table.reshape(2, round(d), round(d))
    return QuadraticModel.from_sums(table[:, 0, 0], table[:, 0, 1:], table[:, 1:, 1:])


def scores(table: DataFrame, model: QuadraticModel | None) -> DataFrame:
    """doc_id and score of a table of statistics."""
    if model is None:
        return table.select("doc_id", F.lit(1.0).alias("score"))
    shared = table.sparkSession.sparkContext.broadcast(model)  # fixed size

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(x.to_list())) if len(x) else [], dtype=float)

    return table.select("doc_id", score("x").alias("score"))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = saved(document_statistics(documents(spark, sf_dir)), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality in (0, 1)")
    labels = labels.select("doc_id", F.col("quality").cast("long").alias("label"))
    model = fit(table.where(~held_out()).join(labels, "doc_id"))
    return scores(table, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
