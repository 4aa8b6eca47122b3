"""Bit-parallel measures and the TF-IDF index against plain programs."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences
from spanloom.functions import text as tx


def tables(a, b):
    """Edit distance and common subsequence by their tables."""
    edits, common = list(range(len(b) + 1)), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        next_edits, next_common = [i], [0]
        for j, y in enumerate(b, 1):
            next_edits.append(min(edits[j] + 1, next_edits[-1] + 1, edits[j - 1] + (x != y)))
            next_common.append(common[j - 1] + 1 if x == y else max(common[j], next_common[-1]))
        edits, common = next_edits, next_common
    return edits[-1], common[-1]


def test_measures_equal_the_tables():
    rng = random.Random(1)
    for _ in range(1500):
        labels = "abcdefghij"[: rng.randint(1, 10)]
        a, b = ([rng.choice(labels) for _ in range(rng.randint(0, 90))] for _ in "ab")
        assert (sequences.levenshtein(a, b), sequences.subsequence_length(a, b)) == tables(a, b)


def test_a_thousand_labels_take_milliseconds():
    rng = random.Random(2)
    a, b = ([rng.choice("abcd") for _ in range(1000)] for _ in "ab")
    began = time.perf_counter()
    for _ in range(10):
        sequences.levenshtein(a, b)
        sequences.subsequence_length(a, b)
    assert time.perf_counter() - began < 2  # 17 s for one pair with higher-order functions


def test_columns_with_odd_rows(spark):
    rows = [(1, ["a", "b"], ["a"]), (2, None, ["a"]), (3, [], []), (4, ["a", None], [None, "a"]), (5, [], ["x", "y"]), (6, ["a"] * 5000, ["b"])]
    table = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    found = table.select("id", tx.edit_distance(a, b), tx.common_subsequence(a, b), tx.edit_similarity(a, b)).collect()
    assert [tuple(r)[1:] for r in sorted(found)] == [(1, 1, 0.5), (None, None, None), (0, 0, 1.0), (2, 1, 0.0), (2, 0, 0.0), (5000, 0, 0.0)]
    assert table.limit(0).select(tx.edit_distance(a, b)).collect() == []


@pytest.mark.parametrize("least", [0.05, 0.3, 0.8])
@pytest.mark.parametrize("kind", ["words", "chars"])
def test_similar_texts(spark, least, kind):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 12))) for _ in range(60)]
    texts += [texts[0], texts[0], "b a", "a  B", "", None, "abc"]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, t string")

    def terms(t):
        if kind == "words":
            return t.lower().split()
        plain = " ".join(t.lower().split())
        return [plain[i : i + 4] for i in range(len(plain) - 3)] or ([plain] if plain else [])

    bags = [Counter(terms(t or "")) for t in texts]
    df, n = Counter(w for bag in bags for w in bag), len(texts)
    vectors = []
    for bag in bags:
        v = {w: tf * (math.log((1 + n) / (1 + df[w])) + 1) for w, tf in bag.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / length for w, x in v.items()})
    wanted, least_of = {}, {}
    stands = [least_of.setdefault(frozenset(bag.items()), i) for i, bag in enumerate(bags)]
    for i in range(n):
        for j in range(i + 1, n):
            c = sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items())
            if (c >= least and stands[i] == i and stands[j] == j) or (bags[i] and stands[j] == i):
                wanted[i, j] = c
    grams = tx.words if kind == "words" else tx.char_grams
    found = [tuple(r) for r in tx.similar_texts(table, "id", "t", least, grams).collect()]
    assert sorted(p[:2] for p in found) == sorted(wanted)
    assert all(c == pytest.approx(wanted[x, y]) for x, y, c in found)
