"""Table functions: rows from a value, and rows from the sorted rows of a key.

A table function is a row-at-a-time Python worker; use it where a value's shape isn't known before (nested
JSON), or where SQL text calls for one.  ``spark.udtf.register`` makes any of them a SQL name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@udtf(returnType="frame long")
class SegmentFrames:
    """The frames of [start, end); none for an empty or unknown segment."""

    def eval(self, start: int | None, end: int | None) -> Iterator[tuple]:
        if start is not None and end is not None:
            for frame in range(start, end):
                yield (frame,)


def identities(value, first: str, second: str) -> Iterator[tuple[str | None, int]]:
    """(first, second) of every object at any depth that has both fields, the outer ones first; ``second`` is a whole number."""
    waiting = [value]
    while waiting:  # no recursion: nesting is as deep as the text likes
        one = waiting.pop()
        if isinstance(one, dict):
            if first in one and second in one:
                yield (None if one[first] is None else str(one[first])), int(one[second])
            waiting.extend(reversed(list(one.values())))
        elif isinstance(one, list):
            waiting.extend(reversed(one))


@udtf(returnType="name string, number long")
class Identities:
    """The identities in a JSON text; none in a text that is null or no JSON."""

    def eval(self, text: str | None, first: str, second: str) -> Iterator[tuple]:
        if text is None:
            return
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return
        yield from identities(value, first, second)


@udtf
class StateRuns:
    """Maximal runs of equal known state from a table argument with ``frame``, the partition's key columns and
    the column named by ``state``.

    The call is polymorphic: the result has the key columns with the types that the table has.  The rows
    must be partitioned by the keys; their order by frame is asked for here.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, state: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        if not (key.isConstantExpression and state.isConstantExpression):
            raise ValueError("the names of the columns must be constants")
        fields = {f.name: f.dataType for f in rows.dataType.fields}
        for name in (key.value, state.value, "frame"):
            if name not in fields:
                raise ValueError(f"the table has no column {name}")
        schema = T.StructType([
            T.StructField(key.value, fields[key.value]), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("state", fields[state.value]),
        ])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("frame")])

    def __init__(self):
        self.run = None

    def eval(self, rows: T.Row, key: str, state: str) -> Iterator[tuple]:
        frame, now = rows["frame"], rows[state]
        if self.run is not None and (self.run[2] != frame or self.run[3] != now):
            yield self.run
            self.run = None
        if now is not None:
            self.run = (rows[key], frame, frame + 1, now) if self.run is None else (*self.run[:2], frame + 1, now)

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self.run
