"""Incremental ingestion with Structured Streaming.

The journal is an append-only set of files.  Results are accepted in any order,
once per id; an id that isn't expected, or comes again, is reported.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.tables import saved


def hourly(events: DataFrame, *, watermark: str | None = None) -> DataFrame:
    """Counts and sums by hour and type; for a stream, rows later than the watermark are late."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    by_hour = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return by_hour.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def read_journal(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_once(stream: DataFrame, expected: DataFrame, key: str, table_path: str, checkpoint: str):
    """Add each expected id once to the table; all other rows go to ``<table>-rejected`` with a reason.

    ``unknown``: the id isn't expected, or is null; ``repeated``: the id came in an earlier batch, or with a row
    that comes first in the order of all columns; equal rows are repeats as well.  A batch writes its own
    folder (batch=n) of either table, so that one that runs again after a failure adds nothing.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        ids = expected.select(F.col(key).alias("_id")).where("_id is not null").distinct().withColumn("_known", F.lit(True))
        rows = batch.join(ids, F.col(key) == F.col("_id"), "left")
        try:
            before = spark.read.parquet(table_path).where(F.col("batch") != batch_id).select(F.col(key).alias("_old")).distinct()
            rows = rows.join(before, F.col(key) == F.col("_old"), "left")
        except AnalysisException as error:  # the first batch has no table yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = rows.withColumn("_old", F.lit(None).cast(batch.schema[key].dataType))
        once = Window.partitionBy(key).orderBy(*columns)  # the repeats of an id in one batch
        reason = F.when(F.col("_known").isNull(), "unknown").when(F.col("_old").isNotNull() | (F.row_number().over(once) > 1), "repeated")
        rows = rows.withColumn("reason", reason).select(*columns, "reason").persist()
        try:
            rows.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
            rows.where("reason is not null").write.mode("overwrite").parquet(f"{table_path}-rejected/batch={batch_id}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(stream: DataFrame, status: str = "status") -> DataFrame:
    """Live roll-up by status, for output mode complete."""
    return stream.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


CHAIN = "episode long, part long, state string"


def chained_parts(stream: DataFrame, repairs: int = 2, order: str | None = None) -> DataFrame:
    """Release parts of an episode in order: part k only after k - 1 was valid.

    Input (episode, part, valid), in a micro-batch taken by the column ``order``.  A part may fail ``repairs`` times and come again; one failure more
    stops its episode, which says so once and releases nothing any more.  Parts that come early wait
    in the state; failures of a part that turned out valid are forgotten.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        following, stopped, waiting, failed, counts = state.get if state.exists else (0, False, [], [], [])
        waiting, failures, out = set(waiting), dict(zip(failed, counts, strict=True)), []
        rows = pd.concat(list(pdfs))
        for pdf in [rows.sort_values(order, kind="stable") if order else rows]:
            for part, valid in zip(pdf["part"], pdf["valid"], strict=True):
                part = int(part)
                if stopped or part < following:  # nothing more, or released before
                    continue
                if valid:
                    waiting.add(part)
                    failures.pop(part, None)
                elif part not in waiting:
                    failures[part] = failures.get(part, 0) + 1
                    stopped = failures[part] > repairs
                    out.append((key[0], part, "stopped" if stopped else "repair"))
                while following in waiting and not stopped:
                    out.append((key[0], following, "released"))
                    waiting.remove(following)
                    following += 1
        if stopped:
            waiting, failures = set(), {}
        state.update((following, stopped, sorted(waiting), list(failures), list(failures.values())))
        yield pd.DataFrame(out, columns=["episode", "part", "state"])

    return stream.groupBy("episode").applyInPandasWithState(
        step, CHAIN, "following long, stopped boolean, waiting array<long>, failed array<long>, counts array<long>", "append", GroupStateTimeout.NoTimeout
    )


QUEUED = "queue string, id long, event string"


def sequential_queue(stream: DataFrame, order: str | None = None, chunk: int = 10_000) -> DataFrame:
    """One active job a queue.  Input (queue, id, event) with event submit, done or full: a job
    that is refused for capacity goes to the end of its queue, and the next one starts.

    With ``order``, a queue's rows of a micro-batch are taken by that column; without it, as they come, which
    is any order once a batch is several tasks' work.  Results leave in parts of ``chunk`` rows.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = deque(state.get[0]) if state.exists else deque()
        known, out = set(waiting), []
        if order:
            pdfs = [pd.concat(list(pdfs)).sort_values(order, kind="stable")]
        for pdf in pdfs:
            for i, event in zip(pdf["id"], pdf["event"], strict=True):
                i = int(i)
                if event == "submit" and i not in known:
                    waiting.append(i)
                    known.add(i)
                    if len(waiting) == 1:
                        out.append((key[0], i, "started"))
                elif waiting and i == waiting[0] and event in ("done", "full"):
                    waiting.popleft()
                    if event == "full":
                        waiting.append(i)
                    else:
                        known.remove(i)
                    out.append((key[0], i, "finished" if event == "done" else "requeued"))
                    if waiting:
                        out.append((key[0], waiting[0], "started"))
                if len(out) >= chunk:
                    yield pd.DataFrame(out, columns=["queue", "id", "event"])
                    out = []
        state.update((list(waiting),))
        yield pd.DataFrame(out, columns=["queue", "id", "event"])

    return stream.groupBy("queue").applyInPandasWithState(
        step, QUEUED, "waiting array<long>", "append", GroupStateTimeout.NoTimeout
    )


REQUESTED = "episode long, frame long, granted boolean"


def frame_requests(stream: DataFrame, most: int = 8, rounds: int = 2) -> DataFrame:
    """Grant requests (episode, round, frame) of up to ``rounds`` rounds with ``most`` frames each,
    and only frames that weren't seen."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, counts = (list(x) for x in state.get) if state.exists else ([], [0] * rounds)
        seen, out = set(seen), []
        for pdf in pdfs:
            for r, f in sorted(zip(pdf["round"], pdf["frame"], strict=True)):
                granted = r < rounds and counts[int(r)] < most and f not in seen
                if granted:
                    counts[int(r)] += 1
                    seen.add(int(f))
                out.append((key[0], int(f), granted))
        state.update((sorted(seen), counts))
        yield pd.DataFrame(out, columns=["episode", "frame", "granted"])

    return stream.groupBy("episode").applyInPandasWithState(
        step, REQUESTED, "seen array<long>, counts array<long>", "append", GroupStateTimeout.NoTimeout
    )


def prepared_and_checked(items: DataFrame, prepare, folder: str) -> DataFrame:
    """Two streams at once: one writes prepared items, the other releases an episode's parts in
    order as they come.  Returns the released parts (episode, part, state).

    ``prepare`` maps the items to (episode, part, valid).  Both streams keep their own checkpoint,
    so that either goes on from its last batch after a failure.
    """
    spark, ready, out = items.sparkSession, f"{folder}/ready", f"{folder}/out"
    prepared = prepare(items)
    spark.createDataFrame([], prepared.schema).write.mode("ignore").parquet(ready)  # the consumer needs the folder
    sink = lambda df, path, name: df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{folder}/{name}")
    producer = sink(prepared, ready, "producer").trigger(availableNow=True).start()
    checked = chained_parts(spark.readStream.schema(prepared.schema).parquet(ready))
    consumer = sink(checked, out, "consumer").start()
    try:
        producer.awaitTermination()
        consumer.processAllAvailable()
    finally:
        consumer.stop()
    return spark.read.schema(checked.schema).parquet(out)


def publish_gate(reports: DataFrame, valid: Column, in_time: Column, folder: str):
    """Publish a job's report if it is valid and in time; others are kept with the reason.

    A batch overwrites its own folder, so that one run again after a failure adds nothing; the
    checkpoint lets a restarted watcher go on with the reports that came since.
    """
    outcome = F.when(~F.coalesce(in_time, F.lit(False)), "late").when(~F.coalesce(valid, F.lit(False)), "invalid").otherwise("published")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("outcome", outcome).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return reports.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def phase_states(log: DataFrame, queue: str, order: str, failed: Column) -> DataFrame:
    """Adds ``state`` to the phases of a queue that stops on failure: done before the first failed
    one, failed, and waiting behind it.  A hot queue is one partial aggregate, not a window."""
    first = log.groupBy(F.col(queue).alias("_queue")).agg(F.min(F.when(failed, F.col(order))).alias("_first"))
    state = F.when(F.col("_first").isNull() | (F.col(order) < F.col("_first")), "done").when(F.col(order) == F.col("_first"), "failed")
    joined = log.join(first, F.col(queue).eqNullSafe(F.col("_queue")))
    return joined.withColumn("state", state.otherwise("waiting")).drop("_queue", "_first")


class TornLine(ValueError):
    """A line that can't be read stands before the last one of its log."""


def log_entries(lines: DataFrame, log: str, line: str, text: str) -> DataFrame:
    """(log, line, text, seq, status) of JSON log lines.  The last line of a log may be torn (a write
    that was cut off) and is left out; a torn line before it raises TornLine."""
    entry = F.from_json(text, "seq long, status string", {"mode": "PERMISSIVE"})
    read = lines.select(log, line, text, entry.alias("_e")).select(log, line, text, F.col("_e.seq").alias("seq"), F.col("_e.status").alias("status"))
    read = saved(read, "entries")  # read for the check and by the caller
    torn = F.col("seq").isNull() | F.col("status").isNull()
    last = read.groupBy(F.col(log).alias("_log")).agg(F.max(line).alias("_last"), F.max(F.when(~torn, F.col(line))).alias("_read"), F.min(F.when(torn, F.col(line))).alias("_torn"))
    if not last.where("_torn < _last or _torn = _read").isEmpty():
        raise TornLine("a line before the last one can't be read")
    return read.where(~torn)


def verified_prefix(entries: DataFrame, log: str) -> DataFrame:
    """(log, verified): the number of entries 0, 1, 2, ... that are verified without a gap.  The first
    gap is the least successor that isn't there; logs without entry 0 have 0.  An entry tells its own number and
    the one after it, so a log of any length is grouped by number first."""
    mark = lambda seq, here: F.struct(seq.cast("long").alias("seq"), here.alias("here"))
    own = F.array(mark(F.col("seq"), F.col(log).isNotNull()), mark(F.col("seq") + 1, F.lit(False)))  # null is no log's number
    marks = F.when(F.col("status") == "verified", own).otherwise(F.array().cast("array<struct<seq:bigint,here:boolean>>"))
    marks = F.concat(marks, F.array(mark(F.lit(0), F.lit(False))))
    told = entries.select(log, F.explode(marks).alias("_m")).groupBy(log, "_m.seq")
    told = told.agg(F.bool_or("_m.here").alias("here"), F.bool_or(~F.col("_m.here")).alias("wanted"))
    return told.where("wanted and not here").groupBy(log).agg(F.min("seq").alias("verified"))


def rejections(entries: DataFrame, log: str, line: str, text: str) -> DataFrame:
    """The lines of explicit rejections, verbatim, for the archive."""
    return entries.where("status = 'rejected'").select(log, line, text)


def never_sent(expected: DataFrame, entries: DataFrame, log: str) -> DataFrame:
    """Expected (log, seq) that no entry of any status names: the only work to resume."""
    return expected.join(entries.select(log, "seq"), [log, "seq"], "left_anti")
