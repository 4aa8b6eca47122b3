"""Streams with keyed map state, timers and state that expires.

Each processor holds, for a key, only what is still open: a job until it is settled, a
reservation until its actual cost is known.  Rows of a key are taken in order of their time within a
micro-batch, and micro-batches in the order in which they come.  A key's state is read and written once a
micro-batch, as each access is a message to the JVM, and rows come as rows, as most keys have few.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources.tables import saved, shared_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_map_state(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB state store."""
    spark.conf.set(STORE, ROCKS)


def _rows(rows: Iterator[Row], order: str) -> list[Row]:
    """A key's rows of a micro-batch, null last."""
    return sorted(rows, key=lambda r: (r[order] is None, r[order] or 0))


WATCHED = "job long, outcome string, micros long"


class _Watch(StatefulProcessor):
    """One job: open with a deadline until a valid report or the deadline's timer."""

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "due_ms long, settled boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.job.get() if self.job.exists() else (None, False)
        due, settled = before
        for row in _rows(rows, "micros"):
            ms = row.micros // 1000
            if settled:
                outcome = "ignored"
            elif row.kind == "started":
                if due is None:  # a job starts once
                    due = ms + int(row.allowed_ms)
                    self.handle.registerTimer(due)
                continue
            elif due is None:
                outcome = "unknown"
            elif ms > due:
                continue  # the timer tells
            elif row.valid:
                self.handle.deleteTimer(due)
                settled = True
                outcome = "published"
            else:
                outcome = "invalid"
            yield Row(job=key[0], outcome=outcome, micros=row.micros)
        if (due, settled) != tuple(before):
            self.job.update((due, settled))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.job.update((due, True))
        yield Row(job=key[0], outcome="late", micros=due * 1000)

    def close(self) -> None:
        pass


def watched_jobs(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """What becomes of remote jobs: rows (job, ts, kind, allowed_ms, valid), kind ``started`` or ``report``.

    A valid report up to the deadline publishes its job; an invalid one is told, and the job stays
    open.  A job whose deadline the watermark (the latest time less ``delay``) passes is late, by its
    timer, though no row of it comes.  Reports of settled jobs are ignored, those of jobs that
    never started unknown.
    """
    timed = stream.withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    found = timed.groupBy("job").transformWithState(_Watch(), outputStructType=WATCHED, outputMode="Append", timeMode="EventTime")
    return found.select("job", "outcome", F.timestamp_micros("micros").alias("at"))


ADMITTED = "account string, id long, reserved double, admitted boolean"


class _Budget(StatefulProcessor):
    """One account: the sum of what is reserved or spent, the reservations still open, and until when
    ids are remembered.  One timer is set, for the first id to be forgotten."""

    def __init__(self, budget: float, remember_ms: int):
        self.budget, self.remember_ms = budget, remember_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.account = handle.getValueState(
            "account", "total double, ids array<long>, amounts array<double>, seen array<long>, until array<long>, timer long"
        )

    def _read(self) -> tuple:
        if not self.account.exists():
            return 0.0, {}, {}, None
        total, ids, amounts, seen, until, timer = self.account.get()
        return total, dict(zip(ids, amounts, strict=True)), dict(zip(seen, until, strict=True)), timer

    def _write(self, total: float, reserved: dict, seen: dict, timer: int | None) -> None:
        self.account.update((total, list(reserved), list(reserved.values()), list(seen), list(seen.values()), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, reserved, seen, timer = self._read()
        first = timer
        for row in _rows(rows, "micros"):
            one = int(row.id)
            if row.actual is not None:
                if one in reserved:  # the actual cost takes the place of the ceiling
                    total += float(row.actual) - reserved.pop(one)
            elif one not in seen:
                fits = total + float(row.ceiling) <= self.budget
                if fits:
                    total += float(row.ceiling)
                    reserved[one] = float(row.ceiling)
                seen[one] = row.micros // 1000 + self.remember_ms
                first = seen[one] if first is None else min(first, seen[one])
                yield Row(account=key[0], id=one, reserved=total, admitted=fits)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self._write(total, reserved, seen, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        total, reserved, seen, _ = self._read()
        seen = {one: until for one, until in seen.items() if until > now or one in reserved}
        following = min((until for until in seen.values() if until > now), default=None)
        if following is not None:
            self.handle.registerTimer(following)
        self._write(total, reserved, seen, following)
        yield from ()

    def close(self) -> None:
        pass


def admit_within_budget(stream: DataFrame, budget: float, remember_ms: int = 7 * 86_400_000, delay: str = "0 seconds") -> DataFrame:
    """Admit requests (account, at, id, ceiling, actual) while what is spent and reserved fits the budget.

    A row with an actual cost settles the request: the cost takes the ceiling's place, frees the rest
    for the requests after it, and the reservation leaves the state.  An id that is asked for again is
    passed over; settled ids are forgotten by a timer ``remember_ms`` after they were asked for, in the stream's time.
    """
    timed = stream.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    return timed.groupBy("account").transformWithState(
        _Budget(budget, remember_ms), outputStructType=ADMITTED, outputMode="Append", timeMode="EventTime"
    )


TERMINAL = "job long, status string, updates long"


class _Terminal(StatefulProcessor):
    """One job: its updates are counted until a terminal one, which is told once."""

    def __init__(self, terminal: tuple[str, ...]):
        self.terminal = terminal

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "updates long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        updates, done = self.seen.get() if self.seen.exists() else (0, False)
        if done:
            return
        for row in _rows(rows, "at"):
            updates += 1
            if row.status in self.terminal:
                done = True
                yield Row(job=key[0], status=row.status, updates=updates)
                break
        self.seen.update((updates, done))

    def close(self) -> None:
        pass


def watch_until_terminal(stream: DataFrame, jobs: int, folder: str, terminal: tuple[str, ...], every: str = "0 seconds", timeout_s: float | None = None) -> bool:
    """Poll updates (job, at, status) and write each job's terminal one to ``<folder>/out``; the stream ends
    when ``jobs`` jobs are terminal.  False if the timeout came first: run it again to go on.

    A batch writes a folder of its own, so that one that runs again after a failure adds nothing.
    """
    spark, all_done = stream.sparkSession, threading.Event()
    found = stream.groupBy("job").transformWithState(_Terminal(terminal), outputStructType=TERMINAL, outputMode="Append", timeMode="None")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        if spark.read.parquet(f"{folder}/out").count() >= jobs:
            all_done.set()

    query = found.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
    try:
        waited = 0.0
        while not all_done.wait(0.2) and query.isActive and (timeout_s is None or waited < timeout_s):
            waited += 0.2
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return all_done.is_set()


def finished(df: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now, to its last timer, and read its table."""
    sink = df.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def in_order(rows: DataFrame, order: str, folder: str, files: int, cuts: list[float] | None = None) -> None:
    """Write rows as files of rising ranges of ``order``, one after the other, so that a stream that takes some
    files at a time reads them in order; the ranges start at ``cuts`` or are about equal.

    All tasks make the rows, once, as a table that is cut into the ranges; then a task copies a range to its file."""
    x = F.col(order).cast("timestamp") if rows.schema[order].dataType.typeName().startswith("timestamp") else F.col(order)
    rows = saved(rows.withColumn("_x", x.cast("double")), "unordered")
    if cuts is None:
        # as many numbers as files; a tenth of a range may be amiss
        first, *found = rows.approxQuantile("_x", [i / files for i in range(files)], min(0.001, 0.1 / files)) or [0.0]
        cuts = sorted({c for c in found if c > first})
    spark, ranges = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/ranges-{uuid.uuid4().hex}"
    place = sum((F.when(F.col("_x") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    if cuts:
        rows = rows.where(F.col("_x").isNotNull())
    plain = rows.drop("_x")
    rows.withColumn("_range", place).drop("_x").write.partitionBy("_range").parquet(ranges)
    for i in range(len(cuts) + 1):
        try:
            part = spark.read.schema(plain.schema).parquet(f"{ranges}/_range={i}")
        except AnalysisException as error:  # no row is in this range
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            part = plain.limit(0)
        part.coalesce(1).write.mode("append").parquet(folder)
