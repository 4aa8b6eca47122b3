"""Operators that compare documents, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, fixity, near_dedup, substring_dedup
from spanloom.llm.suffix_arrays import permuted_prefixes, suffix_array

from .conftest import SCHEMA, TEXTS, rows


def documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def check_exact(docs, texts):
    found = exact_dedup.decisions(saved(docs)).collect()
    groups = {}
    for doc_id, text in texts:
        groups.setdefault(bare(text), []).append((-len(text or ""), doc_id))
    assert len(found) == len(texts)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    for text, members in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in found if r.text_sha256 == sha]
        assert {(r.keep_id, r.group_size) for r in own} == {(min(members)[1], len(members))}
        assert kept[sha] == 1


def saved(docs):
    from spanloom.llm.common import saved

    return saved(exact_dedup.digests(docs), "digests")


def test_op7_exact_dedup(spark, odd, none, sf):
    check_exact(odd, TEXTS)
    check_exact(*documents(spark, sf))
    assert exact_dedup.decisions(saved(none)).count() == 0
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({bare(t) for _, t in TEXTS})
    assert exact_dedup.kept_documents(none).count() == 0


def test_op7_rows_without_doc_id(spark):
    docs = spark.createDataFrame(rows([(None, "a b"), (2, "ab"), (5, "a b"), (None, "c"), (None, "c")]), SCHEMA)
    found = sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in exact_dedup.decisions(saved(docs)).collect())
    assert found == sorted(map(repr, [(None, 5, 3, False), (2, 5, 3, False), (5, 5, 3, True), (None, None, 2, True), (None, None, 2, False)]))
    assert sorted(repr((r.doc_id, r.text)) for r in exact_dedup.kept_documents(docs).collect()) == ["(5, 'a b')", "(None, 'c')"]


def test_filter_finds_every_repeat(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", exact_dedup.SEGMENT)
    values = [i // 2 for i in range(0, 4000)] + list(range(10_000, 30_000))
    hashes = spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v").alias("h"))
    bits, cells = exact_dedup.repeat_filter(hashes.repartition(5), len(values))
    found = np.array([r.h for r in hashes.distinct().collect()], np.int64)
    hit = np.ones(len(found), bool)
    for cell in exact_dedup._cells(found, cells):
        hit &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    again = {r.h for r in hashes.groupBy("h").count().where("count > 1").collect()}
    assert again <= set(found[hit].tolist())
    assert hit.sum() < len(found) / 2


def shingle_set(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def check_near(docs, texts):
    found = near_dedup.near_duplicates(docs).collect()
    sets = [(i, shingle_set(t)) for i, t in texts]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert len(found) == len(texts)
    sizes = dict(sets)
    for r in found:
        assert (r.n_shingles, r.component_id) == (len(sizes[r.doc_id]), find(r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)


def near_copies(count):
    """A group in which many copies link only through others: edits of one text at random depth."""
    random.seed(5)
    base = [f"word{i}" for i in range(120)]
    out = []
    for i in range(count):
        words = list(base)
        for at in random.sample(range(120), random.choice([1, 2, 3, 4, 5, 6, 8])):
            words[at] = f"edit{i}x{at}"
        out.append((100 + i, " ".join(words)))
    return out


def test_op9_near_duplicates(spark, odd, none, sf, monkeypatch):
    check_near(odd, TEXTS)
    check_near(*documents(spark, sf))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    group = near_copies(120)
    check_near(spark.createDataFrame(rows(group), SCHEMA), group)
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.kept_documents(odd)
    assert kept.columns == odd.columns
    two = spark.createDataFrame(rows([(1, "a b c d e f"), (1, "u v w x y z"), (0, "u v w x y z")]), SCHEMA)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(two).collect())
    assert found == [(0, 2, 0), (1, 2, 0), (1, 2, 0)]


@pytest.mark.parametrize("dense", [0, 10**9])
def test_op9_dense_and_sparse_buckets(spark, monkeypatch, dense):
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    group = near_copies(60)
    check_near(spark.createDataFrame(rows(group), SCHEMA), group)


def test_op9_survivors_by_member(monkeypatch):
    monkeypatch.setattr(near_dedup, "HELD", 100)
    sizes = {1: 80, 2: 70, 3: 10, 4: 500}
    pairs = [(4, 9), (1, 7), (2, 7), (3, 8), (2, 8), (3, 7), (1, 9)]
    found = np.array([(hub, member, 0, 0, 0, sizes[hub]) for hub, member in pairs])
    held = near_dedup._by_member((5, 6, 7), found).to_pylist()
    assert {(r["band"], r["i"], r["j"]) for r in held} == {(5, 6, 7)}
    hubs = {r["set_key"]: r["part"] for r in held if r["hubs"] is None}
    members = [r for r in held if r["hubs"] is not None]
    assert hubs == {1: 0, 2: 0, 3: 1, 4: 1}
    assert sorted((hub, r["set_key"]) for r in members for hub in r["hubs"]) == sorted(pairs)
    assert all(hubs[hub] == r["part"] for r in members for hub in r["hubs"])
    assert len({(r["part"], r["set_key"]) for r in members}) == len(members)


def test_op9_rows_without_doc_id(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    texts = [(1, text), (None, text), (None, text + " more"), (None, other), (None, other + " end"), (None, other), (None, None)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    found = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.n_shingles, r.component_id) for r in found if r.component_id is not None) == [(56, 1), (56, 1), (57, 1)]
    assert {r.kept for r in found if r.component_id == 1 and r.doc_id is None} == {False}
    kept = [r.text for r in near_dedup.kept_documents(docs).collect()]
    assert sorted(map(str, kept)) in (["None", other, other, text], sorted(["None", other + " end", text]))


def test_sequential_bounds_follow_the_posterior():
    least = near_dedup.least_matches()
    assert list(least) == sorted(least)
    assert least[-1] < 0.75 * near_dedup.HASHES
    miss = [np.random.default_rng(s).binomial(near_dedup.HASHES, 0.75) < least[-1] for s in range(3000)]
    assert sum(miss) <= 3


def check_substrings(docs, texts, length=200):
    found = substring_dedup.repeat_digests(docs).collect()
    data = [(i, (t or "").encode()) for i, t in texts]
    starts = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    wanted = []
    for doc_id, b in data:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        wanted.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


@pytest.mark.parametrize("share", [512, 2])
def test_op10_repeated_substrings(spark, odd, none, sf, monkeypatch, share):
    monkeypatch.setattr(substring_dedup, "SHARE", share)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 5000)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 50_000)
    short = [(i, t if t is None or len(t) < 20_000 else t[:9000]) for i, t in TEXTS]
    check_substrings(spark.createDataFrame(rows(short), SCHEMA), short)
    check_substrings(*documents(spark, sf))
    assert substring_dedup.repeat_digests(none).count() == 0
    out = substring_dedup.without_repeats(odd)
    assert out.columns == odd.columns
    found = sorted((r.doc_id, r.text, r.n_chars, r.k1, r.left_text) for r in out.collect())
    wanted = {i: t for i, t in TEXTS if i in (22, 23, 14)}
    assert [r[1] for r in found if r[0] in wanted] == [wanted[i] for i in sorted(wanted)]
    assert len(found) == len(TEXTS)
    assert all(r[2] == len(r[1]) and r[3:] == ("k1", "left_text") for r in found if r[1] is not None)


#: Documents without a common string of 200 bytes whose hashes modulo 2**64 are alike.
ALIKE = [
    "!::!:!!::!!:!::!:!!:!::!!::!:!!:.11.1..11..1.11.1..1.11..11.1..1#aa#a##aa##a#aa#a##a#aa##aa#a##a(..(.((..((.(..(.((.(..((..(.((.dadajecpkjmpkp adnnkjl odllgaipgnpmjfnpgkpalml cohjamelifcakimjeniofnpbi",
    "!!:!::!!::!:!!:!::!:!!::!!:!::!1..1.11..11.1..1.11.1..11..1.11.a##a#aa##aa#a##a#aa#a##aa##a#aa#.((.(..((..(.((.(..(.((..((.(..(dadajecpkjmpkp adnnkjl odllgaipgnpmjfnpgkpalml cohjamelifcakimjeniofnpbi",
]


def test_op10_compares_bytes(spark):
    texts = [*enumerate(ALIKE, 1), (None, ALIKE[0][:150] + "x"), (None, "z" * 10 + ALIKE[1])]
    check_substrings(spark.createDataFrame(rows(texts), SCHEMA), texts)
    found = substring_dedup.repeat_digests(spark.createDataFrame(rows(texts[:2]), SCHEMA)).collect()
    assert [r.n_removed for r in found] == [0, 0]


def test_suffix_arrays():
    random.seed(1)
    for case in range(300):
        data = bytes(random.choice(b"ab" if case % 3 else b"abcdz") for _ in range(random.randint(0, 50)))
        data *= 1 + case % 3
        symbols = np.frombuffer(data, np.uint8)
        order = suffix_array(symbols)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared, before = permuted_prefixes(symbols, order)
        for here, there in zip(order[1:], order[:-1], strict=True):
            n = 0
            while max(here, there) + n < len(data) and data[here + n] == data[there + n]:
                n += 1
            assert (shared[here], before[here]) == (n, there)


def test_op2_audit_finds_damage(spark, none):
    ids = [(i, 10 + i % 7, f"h{i}") for i in range(9000) if i % 13]
    index = fixity.with_offsets(spark.createDataFrame(ids, "id long, length long, digest string"))
    from spanloom.llm.common import saved

    index = saved(index, "index")
    damaged = index.where("id <> 4100").withColumn(
        "digest", F.when(F.col("id").isin(5, 8191), F.lit("bad")).otherwise(F.col("digest"))
    )
    found = fixity.audit(fixity.leaves(index), fixity.leaves(damaged)).join(index, ["file", "position"])
    assert {(r.id, r.kind) for r in found.collect()} == {(5, "changed"), (8191, "changed"), (4100, "missing")}
    assert fixity.audit(fixity.leaves(index), fixity.leaves(index)).count() == 0
    assert fixity.audit(fixity.leaves(index.limit(0)), fixity.leaves(index.limit(0))).count() == 0
