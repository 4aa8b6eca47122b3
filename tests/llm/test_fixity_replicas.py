"""The fixity audit of replicas that have a layout each."""

from __future__ import annotations

from spanloom.llm import fixity
from spanloom.llm.common import saved

SCHEMA = "id long, length long, digest string"


def laid_out(spark, rows):
    return fixity.leaves(saved(fixity.with_offsets(spark.createDataFrame(rows, SCHEMA)), "index"))


def found(one, two):
    return sorted((r.record_id, r.record_offset, r.record_length, r.kind) for r in fixity.audit(one, two).collect())


def test_a_lost_record_moves_no_other(spark):
    rows = [(i, 10 + i % 7, f"h{i}") for i in range(-50, 9000) if i % 13]
    rows += [(30, 12, "h30"), (30, 9, "other"), (31, 11, "second")]
    offsets, ends = {}, {}
    for i, length, digest in sorted(rows, key=lambda r: (r[0], r[2])):
        offsets[i, digest] = offsets.get((i, digest), ends.get(i // 4096, 0))
        ends[i // 4096] = ends.get(i // 4096, 0) + length
    gone, bad = {(4100, "h4100"), (-49, "h-49"), (30, "other")}, {5, 8191}
    damaged = [(i, n, "bad" if i in bad else x) for i, n, x in rows if (i, x) not in gone] + [(13, 20, "new")]
    before = sum(n for i, n, x in damaged if 0 <= i < 13)
    wanted = [(i, offsets[i, x], n, "missing") for i, n, x in rows if (i, x) in gone]
    wanted += [(i, offsets[i, f"h{i}"], 10 + i % 7, "changed") for i in bad]
    assert found(laid_out(spark, rows), laid_out(spark, damaged)) == sorted([*wanted, (13, before, 20, "extra")])


def test_replicas_with_negative_or_no_ids_or_empty(spark):
    rows = [(-1, 10, "a"), (-1, 11, "b")]
    one, empty = laid_out(spark, rows), laid_out(spark, rows).limit(0)
    assert found(one, one) == []
    assert found(one, laid_out(spark, rows[1:])) == [(-1, 0, 10, "missing")]
    assert [r[3] for r in found(empty, one)] == ["extra", "extra"]
    assert found(one, laid_out(spark, [(2**60, 5, "far"), *rows])) == [(2**60, 0, 5, "extra")]
