"""Prediction by partial matching against a plain program over dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import ppm

from .conftest import LONG, TEXTS, rows


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def words_of(text) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_scores(texts, order):
    """doc_id, tokens, known, base and score of each text, one byte at a time."""
    streams = [(i, words_of(t), (" ".join(words_of(t)) + "\n").encode()) for i, t in texts]
    follows, tokens = defaultdict(Counter), Counter()
    for i, words, stream in streams:
        if not held_out(i):
            tokens.update([*words, "\n"])
            data = b"\n" * order + stream
            for at in range(order, len(data)):
                for n in range(order + 1):
                    follows[data[at - n : at]][data[at]] += 1
    total, kinds = sum(tokens.values()), len(tokens)
    for i, words, stream in streams:
        data, score = b"\n" * order + stream, 0.0
        for at in range(order, len(data)):
            excluded, byte = set(), data[at]
            for n in range(order, -1, -1):
                left = {b: c for b, c in follows.get(data[at - n : at], {}).items() if b not in excluded}
                whole = sum(left.values()) + len(left)
                if byte in left:
                    score += math.log10(left[byte] / whole)
                    break
                if left:
                    score += math.log10(len(left) / whole)
                    excluded |= set(left)
            else:
                score -= math.log10(max(252 - len(excluded), 1))
        own = [*words, "\n"]
        base = sum(math.log10((tokens[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        yield i, held_out(i), len(own), sum(tokens[w] > 0 for w in own), total, base, score


def compared(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[2:5], round(r[5], 6), round(r[6], 6))
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=1e-9)


@pytest.mark.parametrize("order", [2, 5])
def test_scores_of_odd_rows(odd, order):
    compared(ppm.scores(odd, order).collect(), plain_scores(TEXTS, order))


def test_op11_on_the_documents(spark, sf):
    found = ppm.op11_lm_scores(spark, sf)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    compared(found.collect(), plain_scores(texts, ppm.ORDER))


def test_many_blocks_and_cut_texts(spark, monkeypatch):
    texts = [(i, f"{LONG[: 900 * (i % 7)]} end{i % 5}") for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    monkeypatch.setattr(ppm, "BLOCK", 4000)
    monkeypatch.setattr(ppm, "PIECE", 1500)
    compared(ppm.scores(docs, 4).collect(), plain_scores(texts, 4))
    bodies = [ppm.normalised(t) for _, t in texts]
    grams, n = ppm.counted(bodies, 4)
    assert (np.diff(grams) > 0).all()
    assert n.sum() == sum(map(len, bodies))


def test_no_texts_and_no_training_texts(spark, none):
    assert ppm.scores(none).count() == 0
    free = next(i for i in range(100) if held_out(i))
    lone = [(free, "ab"), (None, "A\tb"), (free, None)]
    docs = spark.createDataFrame(rows(lone), none.schema)
    found = ppm.scores(docs).collect()
    compared(found, plain_scores(lone, ppm.ORDER))
    assert {r.held_out for r in found} == {True}
    assert {r.n_known for r in found} == {0}


def test_probabilities_of_a_context_add_up(spark):
    """All bytes that can follow a context share one, up to what exclusion leaves."""
    texts = [(i, "abab abc abd" if i % 2 else "bab cab") for i in range(1, 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = {r.doc_id: r.score for r in ppm.scores(docs, 2).collect()}
    assert all(-40 < s < 0 for s in one.values())
    assert len(set(round(s, 9) for s in one.values())) == 2
