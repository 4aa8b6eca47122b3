"""Operators that work document by document, against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import fingerprints, packing, pieces, token_files, tokens

from .conftest import TEXTS

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MIXED = st.text(st.sampled_from(list("abThe '.,12\n\t\r éßΣ日😀▁́\x1c-=")), max_size=30)


def library(path):
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize(("path", "make"), [(BYTES, tokens.byte_level), (WORDS, tokens.space_dropping)])
def test_memo_tokenizers_match_the_library(path, make):
    own, whole = make(path), library(path)

    @settings(max_examples=400, deadline=None)
    @given(MIXED)
    def same(text):
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids

    same()
    for _, text in TEXTS:
        same.hypothesis.inner_test(text or "")


def test_memo_keeps_what_is_met_again():
    calls = []
    memo = tokens.Memo(lambda k: calls.append(k) or k, 2)
    assert [memo[k] for k in "abcab"] == list("abcab")
    assert calls == ["a", "b", "c"]


def test_pieces_match_the_library():
    own, whole = pieces.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)

    @settings(max_examples=400, deadline=None)
    @given(MIXED)
    def same(text):
        ids = own.encode(text)
        assert ids == ",".join(map(str, whole.encode(text)))
        assert own.decode(ids) == whole.decode(whole.encode(text))

    same()
    for _, text in TEXTS:
        same.hypothesis.inner_test(text or "")


def test_op6_query_on_odd_rows(odd, none):
    found = sorted(map(tuple, pieces.encoded_pieces(odd, PIECES, with_ids=False).collect()))
    whole = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    wanted = []
    for doc_id, text in TEXTS:
        ids = whole.encode(text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids) if ids else "")))
    assert found == sorted(wanted)
    assert pieces.encoded_pieces(none, PIECES).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_integer_coding_round_trip(values):
    x = np.array(values, np.uint32)
    assert token_files.unpack_integers(*token_files.pack_integers(x), len(x)).tolist() == values


def test_frequent_ids_take_one_byte():
    ids = np.array([70000] * 900 + list(range(1000, 1400)), np.uint32)
    ranked, control, data = token_files.encode_block(ids)
    assert np.frombuffer(ranked, "<u4")[0] == 70000
    assert len(control) == len(ids) // 4
    assert len(data) == 900 + 255 + 2 * (400 - 255)
    assert token_files.decode_block(ranked, control, data, len(ids)).tolist() == ids.tolist()


def check_token_files(spark, docs, expected, path):
    token_files.write_token_files(docs, path, BYTES, 2)
    found = token_files.read_token_files(spark, path).collect()
    whole, start, wanted = library(BYTES), 0, []
    for doc_id, text in sorted(expected, key=lambda r: r[0]):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((doc_id, start, len(ids), zlib.crc32(ids), ids.tolist()))
        start += len(ids)
    assert sorted(map(tuple, found)) == wanted


def test_op8_token_files(spark, odd, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 5000)
    check_token_files(spark, odd, TEXTS, str(tmp_path / "odd"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_token_files(spark, docs, [(r.doc_id, r.text) for r in docs.collect()], str(tmp_path / "docs"))


def test_op8_of_no_documents(spark, none, tmp_path):
    token_files.write_token_files(none, str(tmp_path / "none"), BYTES, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def brute_spfhp(histogram, size):
    """The same rule, one pack at a time."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = [size - sum(p) for p in packs]
            best = max(range(len(packs)), key=lambda i: room[i], default=None)
            if best is None or room[best] < length:
                packs.append([length])
            else:
                packs[best].append(length)
    return packs


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=8))
def test_histogram_packing_is_that_of_single_packs(histogram):
    patterns = packing.shortest_pack_first(histogram, 20)
    used = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 20
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == histogram
    assert sum(c for c, _ in patterns) == len(brute_spfhp(histogram, 20))


def check_packing(spark, docs, texts):
    found = packing.packed_documents(docs, WORDS, end_id=1).collect()
    whole = library(WORDS)
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for doc_id, text in dict(texts).items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
        times = sum(i == doc_id for i, _ in texts)
        assert sum(r.length for r in by_doc[doc_id]) == times * len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE


def test_op4_packing(spark, odd, none, sf):
    check_packing(spark, odd, TEXTS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_packing(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.packed_documents(none, WORDS).count() == 0


def check_fingerprints(docs, texts):
    """Whole rows as multisets: repeated rows have different next documents."""
    found = fingerprints.edited_fingerprints(docs).collect()
    texts = sorted(((i, t or "") for i, t in texts), key=lambda r: r)
    wanted = []
    for (doc_id, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = map(fingerprints.digest, (text, edited, after))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        near = fingerprints.likeness(own, other), fingerprints.likeness(own, following)
        assert 0 <= near[1] <= 1
        wanted.append((doc_id, len(text), sha, own, other, *near))
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_op1_fingerprints(spark, odd, none, sf):
    check_fingerprints(odd, TEXTS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_fingerprints(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.edited_fingerprints(odd.where("doc_id = 9")).collect()[0].near_next == 1


def test_bucket_counts_by_hand():
    data = b"abcdef"
    counts = np.zeros(256, int)
    mix = fingerprints.MIX
    for (second, third), salt in fingerprints.TRIPLETS:
        for i in range(len(data) - third):
            h = mix[salt]
            for at in (0, second, third):
                h = mix[h ^ data[i + at]]
            counts[h] += 1
    assert fingerprints.bucket_counts(data).tolist() == counts.tolist()
    assert fingerprints.likeness(fingerprints.digest("a"), fingerprints.digest("")) > 0
