"""Exact SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The library joins the pair of neighbouring symbols with the best score again and
again.  The outcome is the only way to cut a text into pieces in which every two
neighbours, merged anew on their own, come out as the same two pieces.  So the
encoder takes the longest piece at each position, found with an Aho-Corasick
automaton, checks that it is compatible with the piece before, falls back to
shorter ones, and steps back where none is left.  A bitfield remembers positions
from which no cut can be completed.

No piece holds a space mark behind another character, so units that start with a
space mark are encoded on their own, and each worker keeps the units it has met.

Characters without a piece become their UTF-8 bytes' pieces.  Decoding looks
every id up in a table and drops the space in front of the text.

Cases: a null or empty text has no ids and decodes to an empty text; an empty
table gives no rows; repeated rows are encoded once each; columns other than
doc_id and text are ignored; bytes that are no UTF-8 decode to U+FFFD; a null doc_id
stays null; a very long text is encoded whole, by one task, unit by unit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, text_of
from .tokens import Memo

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
PAIRS = 200_000


class PieceModel:
    """Pieces, scores and the decoding table of a BPE model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [
            i
            for i in ids
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        surface = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        surface |= {i: bytes([b]) for b, i in self.bytes.items()}
        surface[self.unknown] = " ⁇ ".encode()
        self.surface = {str(i): surface.get(i, b"") for i in ids}
        self.whole = Memo(lambda p: self.merged(p) == [p], PAIRS, "pieces")
        self.compatible = Memo(lambda ab: self.merged(ab[0] + ab[1]) == [ab[0], ab[1]], PAIRS, "pieces")
        self.units = Memo(self._unit, 250_000, "pieces")

    def merged(self, text: str) -> list[str]:
        """Symbols after merging: the best score first, the leftmost of equal ones."""
        symbols = list(text)
        scores = self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def cut(self, text: str) -> list[str]:
        """The pieces of a text (or characters without a piece), by backtracking."""
        n = len(text)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.automaton.iter(text):
            starts[end - length + 1].append(length)
        for at, lengths in enumerate(starts):
            if not lengths or lengths[0] != 1:
                lengths.insert(0, 1)  # a single character always can stay on its own
        out: list[str] = []
        failed = 0  # bit i: no cut of text[i:] completes
        at, choice = 0, len(starts[0]) - 1 if n else 0
        while at < n:
            while choice >= 0:
                length = starts[at][choice]
                piece = text[at : at + length]
                if (
                    not failed >> (at + length) & 1
                    and (length == 1 or self.whole[piece])
                    and (not out or self.compatible[out[-1], piece])
                ):
                    break
                choice -= 1
            if choice >= 0:
                out.append(piece)
                at += length
                choice = len(starts[at]) - 1 if at < n else 0
            else:
                failed |= 1 << at
                back = out.pop()
                at -= len(back)
                choice = starts[at].index(len(back)) - 1
        return out

    def _unit(self, unit: str) -> str:
        ids: list[int] = []
        for piece in self.cut(unit):
            if piece in self.ids:
                ids.append(self.ids[piece])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode())
            else:
                ids.append(self.unknown)
        return "".join(f",{i}" for i in ids)

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        if "  " in text or MARK in text or text[0] == " ":
            units = UNIT.findall(MARK + text.replace(" ", MARK))
        else:
            units = (MARK + text.replace(" ", " " + MARK)).split(" ")
        return "".join(map(self.units.__getitem__, units))[1:]

    def decode(self, ids: str) -> str:
        """The text of decimal ids joined by commas."""
        if not ids:
            return ""
        data = b"".join(map(self.surface.__getitem__, ids.split(",")))
        if data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded_pieces(docs: DataFrame, model_path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded texts."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        model = piece_model(model_path)
        for doc_id, text in found:
            ids = model.encode(text)
            decoded = model.decode(ids)
            yield (
                doc_id,
                ids.count(",") + 1 if ids else 0,
                hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
                *([list(map(int, ids.split(","))) if ids else [], decoded] if with_ids else []),
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")),
        rows,
        schema + ", ids array<long>, decoded string" * with_ids,
    )


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encoded_pieces(documents(spark, sf_dir), path, with_ids=False)
