"""Exact, memoised use of the tokenizers library inside Spark tasks.

Words repeat far more often than they are new, so each Python worker keeps the
ids of the chunks that it has met.  A chunk is cut only where the tokenizer's
own pre-tokenizer always cuts, so joining the chunks' ids gives the ids of the
whole text.
"""

from __future__ import annotations

import re
import struct
import weakref
from functools import lru_cache

from tokenizers import Tokenizer

#: Entries in each of a memo's two generations; bounds a worker's memory.
MEMO_CHUNKS = 400_000
#: Longer keys aren't kept, so that texts without spaces don't fill a worker's memory.
LONGEST = 64


class Memo(dict):
    """key -> compute(key); when full, the entries not met since the last turn go.

    A worker runs the tasks of many operators one after another.  Memos of other
    users are emptied when a user's memo starts to fill, so their sizes don't add up.
    """

    user = None
    memos: list[weakref.ref[Memo]] = []

    def __init__(self, compute, limit: int = MEMO_CHUNKS, user: str = "tokens"):
        super().__init__()
        self.compute, self.limit, self.own, self.old = compute, limit, user, {}
        Memo.memos.append(weakref.ref(self))

    def __missing__(self, key):
        if Memo.user != self.own:
            self._take_over()
        if len(key) > LONGEST:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def _take_over(self) -> None:
        Memo.user = self.own
        Memo.memos[:] = [r for r in Memo.memos if r() is not None]
        for other in (r() for r in Memo.memos):
            if other is not None and other.own != self.own:
                other.clear()
                other.old = {}


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies use for each byte: itself if it is printable
    and no space, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_BYTES = dict(enumerate(_byte_characters()))


class WordTokenizer:
    """Ids of a text, packed as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, memo: int = MEMO_CHUNKS):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.normalizer = self.library.normalizer
        self.pieces = self.library.pre_tokenizer
        self.piece_ids = Memo(self._piece, memo)

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str, space: str = "") -> bytes:
        """A chunk with ``space`` in front.  Letters, and letters with one common mark behind
        them, need no pre-tokenizer to be cut."""
        if self.normalizer is not None:
            chunk = chunk.lower() if chunk.isascii() else self.normalizer.normalize_str(chunk)
        if chunk.isalpha():
            return self.piece_ids[self._letters(space + chunk)]
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return self.piece_ids[self._letters(space + chunk[:-1])] + self.piece_ids[chunk[-1]]
        cut = self.pieces.pre_tokenize_str(space + chunk)
        return b"".join(self.piece_ids[piece] for piece, _ in cut)

    @staticmethod
    def _letters(piece: str) -> str:
        return piece.encode().decode("latin-1").translate(_BYTES)

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class SpaceDroppingTokenizer(WordTokenizer):
    """For vocabularies whose pre-tokenizer drops white space: any space is a cut."""

    def __init__(self, path: str, memo: int = MEMO_CHUNKS):
        super().__init__(path, memo)
        self.chunks = Memo(lambda c: self._chunk(c) if c else b"", memo)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


class ByteLevelTokenizer(WordTokenizer):
    """For byte-level vocabularies, in which a space belongs to the word behind it.

    Runs of up to two white-space characters inside a text are cut the same way
    whatever surrounds them; other texts are encoded by the library as a whole.
    """

    IRREGULAR = re.compile(r"\s\s\s|\s\s\Z")

    def __init__(self, path: str, memo: int = MEMO_CHUNKS):
        super().__init__(path, memo)
        self.first = Memo(lambda c: self._chunk(c) if c else b"", memo // 4)
        self.later = Memo(lambda c: self._chunk(c, " "), memo)
        self.newline = self._chunk("\n")

    def encode(self, text: str) -> bytes:
        if self.IRREGULAR.search(text):
            return self._whole(text)
        out: list[bytes] = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.newline)
            out.append(self.first[words[0]])
            out.extend(map(self.later.__getitem__, words[1:]))
        return b"".join(out[1:])


@lru_cache(maxsize=4)
def space_dropping(path: str, memo: int = MEMO_CHUNKS) -> SpaceDroppingTokenizer:
    return SpaceDroppingTokenizer(path, memo)


@lru_cache(maxsize=4)
def byte_level(path: str, memo: int = MEMO_CHUNKS) -> ByteLevelTokenizer:
    return ByteLevelTokenizer(path, memo)
