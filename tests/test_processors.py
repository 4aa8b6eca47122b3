"""Streams with timers, map state and journalled effects, over several micro-batches, restarts and crashes."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.streaming import effects, journal, processors

JOBS = "job long, ts timestamp, kind string, allowed_ms long, valid boolean"


def minute(n):
    return datetime(2024, 1, 1) + timedelta(minutes=n)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture()
def rocks(spark):
    processors.use_map_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_report_that_never_comes_is_late_by_its_timer(rocks, tmp_path):
    """Two runs with a restart between them: job 2 says nothing any more, job 3 too late, job 4 never started."""
    started = [(j, minute(0), "started", 10 * 60_000, None) for j in (1, 2, 3)]
    feed(rocks, tmp_path / "in", [*started, (1, minute(2), "report", None, False)], JOBS)

    def run():
        stream = journal.read_journal(rocks, str(tmp_path / "in"), rocks.createDataFrame([], JOBS).schema)
        found = processors.finished(processors.watched_jobs(stream), str(tmp_path)).collect()
        return {(r.job, r.outcome) for r in found}

    assert run() == {(1, "invalid")}
    feed(rocks, tmp_path / "in", [(1, minute(9), "report", None, True), (4, minute(9), "report", None, True)], JOBS)
    feed(rocks, tmp_path / "in", [(3, minute(11), "report", None, True), (9, minute(30), "started", 60_000, None)], JOBS)
    assert run() == {(1, "invalid"), (1, "published"), (4, "unknown"), (2, "late"), (3, "late")}
    feed(rocks, tmp_path / "in", [(1, minute(31), "report", None, True)], JOBS)
    assert run() >= {(1, "ignored"), (2, "late")}


def test_a_late_actual_frees_budget_and_ids_are_forgotten(rocks, tmp_path):
    schema = "account string, at timestamp, id long, ceiling double, actual double"

    def run(*rows):
        feed(rocks, tmp_path / "in", [("a", minute(m), i, c, x) for m, i, c, x in rows], schema)
        stream = journal.read_journal(rocks, str(tmp_path / "in"), rocks.createDataFrame([], schema).schema)
        done = processors.finished(processors.admit_within_budget(stream, 10.0, remember_ms=60 * 60_000), str(tmp_path))
        return [(r.id, r.admitted) for r in done.orderBy("id").collect()]

    assert run((1, 1, 6.0, None), (2, 2, 6.0, None), (3, 1, 6.0, None)) == [(1, True), (2, False)]  # a repeat is passed over
    assert run((4, 1, None, 2.0), (5, 3, 8.0, None), (6, 4, 1.0, None)) == [(1, True), (2, False), (3, True), (4, False)]
    assert run((7, 3, None, 0.0), (8, 3, None, 5.0), (9, 5, 8.0, None))[-1] == (5, True)  # a second actual counts nothing
    run((200, 6, 99.0, None))  # the time in which ids are remembered is over
    assert Counter(i for i, _ in run((201, 1, 0.0, None)))[1] == 2


def test_a_watch_ends_when_all_jobs_are_terminal(rocks, tmp_path):
    schema = "job long, at long, status string"
    feed(rocks, tmp_path / "in", [(1, 1, "running"), (1, 2, "failed"), (1, 3, "done"), (2, 1, "running")], schema)
    watch = lambda seconds: processors.watch_until_terminal(
        journal.read_journal(rocks, str(tmp_path / "in"), rocks.createDataFrame([], schema).schema), 2, str(tmp_path), ("done", "failed"), timeout_s=seconds
    )
    assert not watch(8.0)  # job 2 still runs
    feed(rocks, tmp_path / "in", [(2, 2, "done")], schema)
    assert watch(60.0)
    found = rocks.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.job, r.status, r.updates) for r in found) == [(1, "failed", 2), (2, "done", 2)]


def test_failures_are_counted_by_part(spark, tmp_path):
    tries = [(1, p, False) for p in (0, 0, 1, 1)] + [(1, 0, True), (1, 1, True)] + [(2, 0, False)] * 4 + [(2, 0, True)]
    rows = spark.createDataFrame([(*t, n) for n, t in enumerate(tries)], "episode long, part long, valid boolean, at long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = journal.read_journal(spark, str(tmp_path / "in"), rows.schema)
    found = processors.finished(journal.chained_parts(stream, order="at"), str(tmp_path)).collect()
    assert [r.part for r in found if r.episode == 1 and r.state == "released"] == [0, 1]
    assert Counter(r.state for r in found if r.episode == 2) == {"repair": 2, "stopped": 1}


def test_repeated_and_unknown_ids_are_told(spark, tmp_path):
    rows = [[(1, "x"), (2, "a")], [(1, "y"), (2, "a"), (7, "z"), (None, "n")]]
    for part in rows:
        feed(spark, tmp_path / "in", part, "id long, body string")
    expected = spark.createDataFrame([(1,), (2,)], "id long")
    stream = lambda: journal.read_journal(spark, str(tmp_path / "in"), spark.createDataFrame([], "id long, body string").schema)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        journal.ingest_once(stream(), expected, "id", out, str(tmp_path / "checkpoint")).awaitTermination()
        taken = sorted((r.id, r.body) for r in spark.read.parquet(out).collect())
        left = Counter((r.id, r.reason) for r in spark.read.parquet(f"{out}-rejected").collect())
        assert taken == [(1, "x"), (2, "a")]
        assert left == {(1, "repeated"): 1, (2, "repeated"): 1, (7, "unknown"): 1, (None, "unknown"): 1}


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["intent", "send", "settle", None])
@pytest.mark.parametrize("resend", [True, False])
def test_each_effect_happens_once_whatever_crashes(spark, tmp_path, step, resend):
    box = tmp_path / "box"  # the receiver: a file for each thing that it got
    box.mkdir()
    where = str(box)

    def send(pdf):
        for i, token in zip(pdf["id"], pdf["token"], strict=True):
            with open(f"{where}/{i}-{token}", "x") as file:
                file.write("got")
        return [f"remote-{i}" for i in pdf["id"]]

    def look_up(spark):
        names = [p.name.split("-") for p in Path(where).iterdir()]
        return spark.createDataFrame([(int(i), t, f"remote-{i}") for i, t in names], "id long, token string, remote string")

    def crash(at):
        if at == step:
            raise Crash

    batches = [spark.createDataFrame([(i,) for i in ids], "id long") for ids in ((1, 2, 2), (2, 3, None))]
    folder = str(tmp_path / "journal")
    for n, batch in enumerate(batches):
        try:
            effects.settle(batch, n, "id", send, look_up, folder, resend, crash)
        except Crash:
            effects.settle(batch, n, "id", send, look_up, folder, resend)  # Spark runs the batch again
        effects.settle(batch, n, "id", send, look_up, folder, resend)  # and once more
    got = Counter(int(p.name.split("-")[0]) for p in box.iterdir())
    states = {r.id: (r.state, r.remote) for r in spark.read.parquet(f"{folder}/settled").collect()}
    if step == "send" and not resend:  # it can't be known whether they were sent
        assert got == {}
        assert states == dict.fromkeys((1, 2, 3), ("unknown", None))
        return
    assert got == {1: 1, 2: 1, 3: 1}
    assert states == {i: ("resent" if step == "send" else "sent", f"remote-{i}") for i in (1, 2, 3)}


def test_what_was_sent_before_a_crash_is_reconciled(spark, tmp_path):
    """The outcome was never written, though the receiver has it."""
    batch = spark.createDataFrame([(1,), (2,)], "id long")
    sent = []

    def look_up(spark):
        tokens = spark.read.parquet(f"{tmp_path}/intent").where("id = 1")
        return tokens.select("id", "token", F.lit("remote-1").alias("remote"))

    def crash(at):
        if at == "send":
            raise Crash

    with pytest.raises(Crash):
        effects.settle(batch, 0, "id", lambda pdf: sent.append(1), look_up, str(tmp_path), at=crash)
    effects.settle(batch, 0, "id", lambda pdf: sent.append(1), look_up, str(tmp_path))
    states = {r.id: r.state for r in spark.read.parquet(f"{tmp_path}/settled").collect()}
    assert states == {1: "reconciled", 2: "unknown"}
    assert sent == []


class Kept:
    """A value state that counts its accesses."""

    def __init__(self):
        self.value, self.gets, self.updates = None, 0, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.gets += 1
        return self.value

    def update(self, value):
        self.updates += 1
        self.value = value


class Handle:
    def __init__(self):
        self.states, self.timers = [], set()

    def getValueState(self, name, schema):
        self.states.append(Kept())
        return self.states[-1]

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_a_key_reads_and_writes_its_state_once_a_batch():
    asks = [Row(id=i, micros=i, ceiling=1.0, actual=None) for i in range(100)]
    reports = [Row(micros=0, kind="started", allowed_ms=10, valid=None)] + [Row(micros=i, kind="report", allowed_ms=10, valid=False) for i in range(1, 100)]
    updates = [Row(at=i, status="running") for i in range(100)]
    for processor, rows, told in ((processors._Budget(10.0, 60), asks, 100), (processors._Watch(), reports, 99), (processors._Terminal(("done",)), updates, 0)):
        handle = Handle()
        processor.init(handle)
        for batch in (1, 2):
            found = list(processor.handleInputRows((1,), iter(rows), None))
            assert batch == 2 or len(found) == told
            assert sum(s.gets + s.updates for s in handle.states) <= 2 * batch
        assert len(handle.timers) <= 1


def test_rows_in_order_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def tell(x):
        made.add(1)
        return x

    rows = spark.range(100).select(F.udf(tell, "long")("id").alias("at"))
    processors.in_order(rows, "at", str(tmp_path / "in"), 5)
    assert made.value == 100
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    parts = [sorted(r.at for r in spark.read.parquet(str(f)).collect()) for f in files]
    assert len(parts) == 5 and sum(parts, []) == list(range(100))


def test_a_queue_takes_rows_in_order_and_tells_in_parts(spark, tmp_path):
    events = [("q", i, e, i * 3 + n) for i in range(50) for n, e in enumerate(("submit", "full", "done"))]
    rows = spark.createDataFrame(events[::-1], "queue string, id long, event string, at long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = journal.read_journal(spark, str(tmp_path / "in"), rows.schema)
    found = processors.finished(journal.sequential_queue(stream, order="at", chunk=7), str(tmp_path)).collect()
    assert Counter(r.event for r in found) == {"started": 100, "requeued": 50, "finished": 50}
