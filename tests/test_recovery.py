"""Recovery of logs, gates, chained streams, archives and replaced tables, on planted rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.sources import tables
from spanloom.streaming import journal


def lines(spark, rows):
    return spark.createDataFrame(rows, "log string, line long, text string")


ok, no = '{{"seq":{},"status":"verified"}}'.format, '{{"seq":{},"status":"rejected"}}'.format


def test_prefix_rejections_and_unsent_work(spark):
    rows = [("a", 1, ok(0)), ("a", 2, ok(2)), ("a", 3, ok(1)), ("a", 4, no(3)), ("a", 5, '{"seq":4,"sta'), ("b", 1, ok(1)), ("c", 1, '{"s'), ("a", 6 - 6, ok(0))]
    entries = journal.log_entries(lines(spark, rows), "log", "line", "text")
    assert {(r.log, r.verified) for r in journal.verified_prefix(entries, "log").collect()} == {("a", 3), ("b", 0)}
    assert [tuple(r) for r in journal.rejections(entries, "log", "line", "text").collect()] == [("a", 4, no(3))]
    expected = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 0), ("c", 0)], "log string, seq long")
    unsent = {tuple(r) for r in journal.never_sent(expected, entries, "log").collect()}
    assert unsent == {("a", 4), ("a", 5), ("b", 0), ("c", 0)}


def test_a_torn_line_inside_a_log_is_an_error(spark):
    with pytest.raises(journal.TornLine):
        journal.log_entries(lines(spark, [("a", 1, ok(0)), ("a", 2, "{"), ("a", 3, ok(1))]), "log", "line", "text")
    empty = journal.log_entries(lines(spark, []), "log", "line", "text")
    assert journal.verified_prefix(empty, "log").collect() == []


def test_phases_stop_at_the_first_failure(spark):
    rows = [("q", i, i in (2, 4)) for i in range(5)] + [("r", 0, False), (None, 0, True), (None, 1, False)]
    found = journal.phase_states(spark.createDataFrame(rows, "q string, i int, bad boolean"), "q", "i", F.col("bad")).collect()
    states = {(r.q, r.i): r.state for r in found}
    assert [states["q", i] for i in range(5)] == ["done", "done", "failed", "waiting", "waiting"]
    assert (states["r", 0], states[None, 0], states[None, 1]) == ("done", "failed", "waiting")


def test_gate_goes_on_after_a_restart(spark, tmp_path):
    def feed(rows):
        spark.createDataFrame(rows, "job long, good boolean, day int").write.mode("append").parquet(f"{tmp_path}/in")
        reports = journal.read_journal(spark, f"{tmp_path}/in", "job long, good boolean, day int", files_per_batch=100)
        journal.publish_gate(reports, F.col("good"), F.col("day") < 5, str(tmp_path)).awaitTermination()
        return {r.job: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert feed([(1, True, 1), (2, False, 1), (3, None, 1)]) == {1: "published", 2: "invalid", 3: "invalid"}
    assert feed([(4, True, 9), (5, True, None)]) == {1: "published", 2: "invalid", 3: "invalid", 4: "late", 5: "late"}


def test_consumer_stops_behind_a_part_that_never_becomes_valid(spark, tmp_path):
    rows = [(1, p, 1) for p in range(6)] + [(2, p, int(p != 2)) for p in range(5)]
    spark.createDataFrame(rows, "episode long, part long, size int").repartition(3).write.parquet(f"{tmp_path}/in")
    items = journal.read_journal(spark, f"{tmp_path}/in", "episode long, part long, size int")
    prepare = lambda df: df.select("episode", "part", (F.col("size") > 0).alias("valid"))
    done = journal.prepared_and_checked(items, prepare, str(tmp_path)).where("state = 'released'")
    assert sorted((r.episode, r.part) for r in done.collect()) == [(1, p) for p in range(6)] + [(2, 0), (2, 1)]


def test_tar_members_against_a_manifest(spark):
    files = {"b.txt": b"two", "a.txt": b"", "c/d.bin": bytes(range(256)) * 40, "é.txt": b"x"}
    members = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, body binary")
    packed = tables.tar_archives(members, "name", "body", 2)
    found = tables.tar_members(packed)
    assert {r.name: bytes(r.content) for r in found.collect()} == files
    manifest = found.select("name", "length", "sha256")
    assert tables.tar_faults(found, manifest).collect() == []
    listed = manifest.where("name <> 'b.txt'").withColumn("sha256", F.when(F.col("name") == "é.txt", "0").otherwise(F.col("sha256")))
    listed = listed.withColumn("length", F.when(F.col("name") == "a.txt", 1).otherwise(F.col("length"))).union(manifest.where("name = 'b.txt'").replace("b.txt", "z.txt"))
    faults = {r.name: r.fault for r in tables.tar_faults(found.union(found.where("name = 'c/d.bin'")), listed).collect()}
    assert faults == {"b.txt": "extra", "z.txt": "missing", "é.txt": "sha256", "a.txt": "length", "c/d.bin": "repeated"}
    short = packed.withColumn("content", F.expr("substring(content, 1, 700)"))
    with pytest.raises(Exception, match=r"unexpected end of data|ends early|ReadError"):
        tables.tar_members(short).collect()


def test_replaced_table_is_old_or_new(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(ValueError, match="no version"):
        tables.read_current(spark, path)
    tables.replace_table(spark.range(3).toDF("x"), path)
    before = tables.read_current(spark, path)
    tables.replace_table(before.where("x > 0"), path)
    assert sorted(r.x for r in tables.read_current(spark, path).collect()) == [1, 2]
    assert before.count() == 3


def test_a_prefix_is_found_in_two_groupings(spark):
    """Long and short logs, a gap, a rejected first entry, repeats and no log at all; no join of the entries with themselves."""
    from spanloom.streaming import journal as jr

    rows = [("a", i, "verified") for i in range(300)] + [("b", 0, "verified"), ("b", 2, "verified"), ("b", 0, "verified"), ("c", 0, "rejected"), ("c", 1, "verified"), (None, 0, "verified")]
    found = jr.verified_prefix(spark.createDataFrame(rows, "log string, seq long, status string"), "log")
    assert {r.log: r.verified for r in found.collect()} == {"a": 300, "b": 1, "c": 0, None: 0}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
