"""Distances of label sequences, by bit-parallel programs over Arrow batches.

A sequence is an array of labels.  Each distinct label of one array is a set of bits, its places there, and
one step for each label of the other array updates all places at once, so two sequences of
1,000 labels take about 1,000 steps on numbers of 1,000 bits.  A null array gives null; a null label is a label
of its own, equal to itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def subsequence_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: zeros of ``open_`` are its steps over a."""
    if len(a) < len(b):
        a, b = b, a  # fewer steps on longer numbers
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for x in b:
        met = open_ & places.get(x, 0)
        open_ = (open_ + met | open_ - met) & every
    return len(a) - open_.bit_count()


def levenshtein(a: list, b: list) -> int:
    """Insertions, deletions and substitutions that turn a into b.

    ``up`` and ``down`` hold where a column of the distance table rises or falls by one; the last
    row's differences are added up.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    size = len(a)
    every, last = (1 << size) - 1, 1 << size - 1
    up, down, distance = every, 0, size
    for x in b:
        same = places.get(x, 0)
        straight = ((same & up) + up ^ up) | same | down  # where the diagonal doesn't rise
        rises = (down | ~(straight | up)) & every
        falls = straight & up
        distance += bool(rises & last) - bool(falls & last)
        rises = rises << 1 | 1
        up = (falls << 1 | ~(straight | rises)) & every
        down = straight & rises & every
    return distance


def _measured(measure) -> object:
    @F.arrow_udf(T.IntegerType())
    def apply(a: pa.Array, b: pa.Array) -> pa.Array:
        # one pair at a time as Python lists: a batch's labels stay in Arrow
        pairs = zip(a, b, strict=True)
        return pa.array((measure(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in pairs), pa.int32())

    return apply


_edits, _common = _measured(levenshtein), _measured(subsequence_length)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of labels."""
    return _edits(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the distance over the longer length, from 0 to 1; two empty arrays are equal: 1."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(longer == 0, 1.0).otherwise(1 - edit_distance(a, b) / longer))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    return _common(a, b)
