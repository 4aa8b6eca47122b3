"""Streams over the events table, run to the end so that batch SQL can check them.

The journal is the events table cut into files; each query reads it as a stream, a
few files a batch, and returns what the sink holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_dir
from ..streaming import effects, journal, processors
from .binding import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


def stream(spark: SparkSession, d: str, rows: DataFrame) -> tuple[DataFrame, str]:
    """(the rows as a stream of several files, a folder for this query's sink)."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(4).write.parquet(f"{folder}/in")
    return journal.read_journal(spark, f"{folder}/in", rows.schema, files_per_batch=2), folder


def finished(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a Parquet table and read that."""
    spark, out = df.sparkSession, f"{folder}/out"
    if mode == "append":
        sink = df.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        sink = df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).outputMode(mode)
    sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def timed(spark: SparkSession, rows: DataFrame, order: str, files: int = 4, cuts: list[float] | None = None) -> tuple[DataFrame, str]:
    """(rows as a stream of files in order of time, a folder for this query's sink)."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    processors.in_order(rows, order, f"{folder}/in", files, cuts)
    processors.use_map_state(spark)
    return journal.read_journal(spark, f"{folder}/in", rows.schema), folder


@query("st01_st07_live_rollup", "select event_type as status, count(*) as n from events group by 1")
def st01(spark, d):
    rows, folder = stream(spark, d, table(spark, d, "events").select("event_id", F.col("event_type").alias("status")))
    return finished(journal.status_counts(rows), folder, "complete")


@query("st01_until_terminal", """select user_id as job, event_type as status, n as updates from (
    select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n,
        sum((event_type in ('purchase', 'error'))::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as ends from events)
    where event_type in ('purchase', 'error') and ends = 1""")
def st01_terminal(spark, d):
    """A user is a job, done with the first purchase or error; the stream ends when all that have one are done."""
    events, ends = table(spark, d, "events"), ("purchase", "error")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    updates = events.select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), "ts", F.row_number().over(order).cast("long").alias("at"))
    jobs = events.where(F.col("event_type").isin(*ends)).agg(F.count_distinct("user_id")).first()[0]
    rows, folder = timed(spark, updates, "ts")
    processors.watch_until_terminal(rows.drop("ts"), jobs, folder, ends)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("st02_st03_ingest_once", """select event_id as custom_id, event_type as body, case when event_id % 3 <> 0 then 'accepted' else 'unknown' end as outcome from events
    union all select event_id, event_type || '!', case when event_id % 3 <> 0 then 'repeated' else 'unknown' end from events where event_id % 10 = 0""")
def st02(spark, d):
    """Ids divisible by three aren't expected; every tenth id comes again, with another body."""
    events = table(spark, d, "events").select(F.col("event_id").alias("custom_id"), F.col("event_type").alias("body"))
    again = events.where("custom_id % 10 = 0").withColumn("body", F.concat("body", F.lit("!")))
    rows, folder = stream(spark, d, events.union(again))
    journal.ingest_once(rows, events.where("custom_id % 3 <> 0"), "custom_id", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    taken = spark.read.parquet(f"{folder}/out").withColumn("reason", F.lit("accepted")).unionByName(spark.read.parquet(f"{folder}/out-rejected"))
    # which of two bodies comes first depends on the batches, so the first of an id counts as the accepted one
    first = F.min("body").over(Window.partitionBy("custom_id"))
    outcome = F.when(F.col("reason") == "unknown", "unknown").when(F.col("body") == first, "accepted").otherwise("repeated")
    return taken.select("custom_id", "body", outcome.alias("outcome"))


def _receipt(pdf):
    return [f"r-{token[:16]}" for token in pdf["token"]]


@query("st03_effect_journal", """select custom_id, 'r-' || substr(sha256(batch || ':' || custom_id), 1, 16) as remote, 'sent' as state, batch from (
    select event_id as custom_id, (event_id % 4)::int as batch from events)""")
def st03(spark, d):
    """Each id is sent once, though every fifth comes in a later batch as well."""
    events = table(spark, d, "events").select(F.col("event_id").alias("custom_id"))
    files = events.withColumn("part", F.col("custom_id") % 4).union(events.where("custom_id % 5 = 0").withColumn("part", F.col("custom_id") % 4 + 1))
    rows, folder = timed(spark, files, "part", cuts=[1.0, 2.0, 3.0, 4.0])
    nothing = lambda spark: spark.createDataFrame([], "custom_id long, token string, remote string")
    effects.journalled(rows.drop("part"), "custom_id", _receipt, nothing, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/settled").select("custom_id", "remote", "state", F.col("batch").cast("int").alias("batch"))


PARTS = """numbered as (select user_id as episode, row_number() over (partition by user_id order by ts, event_id) - 1 as part, event_type, event_id from events)"""


@query("st05_chained_parts", f"""with {PARTS}, fails as (select episode, part, case when event_type = 'error' then 1 + event_id % 3 else 0 end as n from numbered),
    stops as (select episode, min(part) as stop from fails where n > 2 group by episode)
    select episode, count(*) filter (stop is null or part < stop) as released, coalesce(sum(least(n, 2)) filter (stop is null or part <= stop), 0)::bigint as repairs, any_value(stop) as stopped_at
    from fails left join stops using (episode) group by episode""")
def st05(spark, d):
    """A part whose event is an error fails once to three times before it is valid; three failures stop the episode."""
    parts = numbered(spark, d)
    fails = F.when(F.col("event_type") == "error", 1 + F.col("event_id") % 3).otherwise(0)
    tries = parts.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), fails.cast("long")))).withColumn("valid", F.col("attempt") == fails)
    rows, folder = timed(spark, tries.select("episode", "part", "valid", (F.col("part") * 10 + F.col("attempt")).alias("at")), "at")
    done = finished(journal.chained_parts(rows, order="at"), folder)
    state = lambda name: F.col("state") == name
    return done.groupBy("episode").agg(
        F.count_if(state("released")).alias("released"), F.count_if(state("repair")).alias("repairs"), F.min(F.when(state("stopped"), F.col("part"))).alias("stopped_at")
    )


def numbered(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("episode"), (F.row_number().over(w) - 1).cast("long").alias("part"), "event_type", "event_id")


@query("st08_deadlines", """with jobs as (select user_id, min(ts) as start from events group by user_id), mark as (select max(ts) as m from events),
    reports as (select user_id, ts, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events),
    done as (select user_id, min(ts) as done_at from reports join jobs using (user_id) where n > 1 and event_type = 'purchase' and ts <= start + interval 4 hour group by user_id)
    select user_id as job, 'published' as outcome, count(*) as n from done group by 1
    union all select user_id, 'late', 1 from jobs anti join done using (user_id) where start + interval 4 hour <= (select m from mark)
    union all select user_id, 'invalid', count(*) from reports join jobs using (user_id) left join done using (user_id)
        where n > 1 and event_type = 'error' and ts <= start + interval 4 hour and (done_at is null or ts < done_at) group by user_id""")
def st08(spark, d):
    """A user's first event starts a job of four hours, purchases are valid reports and errors invalid ones."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1 or event_type in ('purchase', 'error')")
    kind = F.when(F.col("n") == 1, "started").otherwise("report")
    rows = rows.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.lit(4 * 3_600_000).cast("long").alias("allowed_ms"), (F.col("event_type") == "purchase").alias("valid"))
    reports, folder = timed(spark, rows, "ts", files=6)
    found = processors.finished(processors.watched_jobs(reports), folder)
    return found.where("outcome <> 'ignored'").groupBy("job", "outcome").agg(F.count(F.lit(1)).alias("n"))


BUDGET = 75.0


@query("st10_budget_admission", f"""with recursive asks as (
        select user_id, event_id as id, row_number() over (partition by user_id order by ts, event_id) as n, 5 + event_id % 11 as ceiling, 1 + event_id % 5 as actual from events
    ), steps as (
        select user_id, id, n * 2 as k, ceiling::double as ceiling, null::double as actual from asks
        union all select user_id, id, (n + 3) * 2 + 1, null, actual::double from asks
    ), ordered as (select *, row_number() over (partition by user_id order by k) as s from steps), run(user_id, s, total, open, id, admitted) as (
        select distinct user_id, 0::bigint, 0::double, map([]::bigint[], []::double[]), null::bigint, null::boolean from asks
        union all
        select r.user_id, r.s + 1, case when o.actual is not null and len(r.open[o.id]) > 0 then total + o.actual - r.open[o.id][1] when o.actual is null and total + ceiling <= {BUDGET} then total + ceiling else total end,
            case when o.actual is null and total + ceiling <= {BUDGET} then map_concat(r.open, map([o.id], [ceiling::double])) else r.open end,
            case when o.actual is null then o.id end, case when o.actual is null then total + ceiling <= {BUDGET} end
        from run r join ordered o on o.user_id = r.user_id and o.s = r.s + 1
    ) select user_id::varchar as account, id, total as reserved, admitted from run where id is not null""".replace("r.open[o.id][1]", "r.open[o.id]").replace("len(r.open[o.id]) > 0", "r.open[o.id] is not null"))
def st10(spark, d):
    """Each request's actual cost comes three requests after it, and is lower than its ceiling or not."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    asks = table(spark, d, "events").select(F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("id"), F.row_number().over(w).cast("long").alias("n"))
    nothing = F.lit(None).cast("double")
    rows = asks.select("account", "id", (F.col("n") * 2).alias("at"), (5 + F.col("id") % 11).cast("double").alias("ceiling"), nothing.alias("actual"))
    rows = rows.union(asks.select("account", "id", ((F.col("n") + 3) * 2 + 1).alias("at"), nothing, (1 + F.col("id") % 5).cast("double")))
    rows = rows.withColumn("at", F.timestamp_seconds(F.col("at") * 60))
    requests, folder = timed(spark, rows, "at")
    return processors.finished(processors.admit_within_budget(requests, BUDGET), folder)


@query("st12_verified_prefix", """select user_id as episode, count(*) as verified from (
    select user_id, event_id, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id) as broken from events) where broken = 0 group by user_id""")
def st12(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    broken = F.sum((F.col("event_type") == "signup").cast("int")).over(w)
    rows = table(spark, d, "events").withColumn("broken", broken).where("broken = 0")
    return rows.groupBy(F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("verified"))


@query("stream_hourly_watermark", """select date_trunc('hour', ts) as "start", event_type, count(*) as n from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 2 hour group by 1, 2""")
def hourly(spark, d):
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events = events.orderBy("ts").coalesce(1)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")  # one file in time order: nothing is late
    rows = journal.read_journal(spark, f"{folder}/in", events.schema)
    return finished(journal.hourly(rows, watermark="2 hours"), folder).select(
        F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"
    )


#: Rows of a file and micro-batch of the queues, as a task may hold all of them.
QUEUE_ROWS = 2_000_000


@query("st04_sequential_queue", "select event_type as queue, count(*) as finished from events group by 1")
def st04(spark, d):
    # every job is submitted, refused once and then done, job by job
    events = table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("id"))
    steps = F.posexplode(F.array(F.lit("submit"), F.lit("full"), F.lit("done"))).alias("step", "event")
    rows = events.select("queue", "id", steps).withColumn("at", F.col("id") * 3 + F.col("step"))
    rows, folder = timed(spark, rows, "at", files=max(4, -(-rows.count() // QUEUE_ROWS)))
    done = finished(journal.sequential_queue(rows, order="at"), folder)
    return done.where("event = 'finished'").groupBy("queue").agg(F.count_distinct("id").alias("finished"))


@query("st11_frame_requests", """select user_id as episode, sum(least(n, 8))::bigint as granted from (select user_id, event_id % 3 as r, count(*) as n from events where event_id % 3 < 2 group by 1, 2) group by user_id""")
def st11(spark, d):
    asks = table(spark, d, "events").select(F.col("user_id").alias("episode"), (F.col("event_id") % 3).alias("round"), F.col("event_id").alias("frame"))
    rows, folder = stream(spark, d, asks)
    done = finished(journal.frame_requests(rows), folder)
    return done.groupBy("episode").agg(F.count_if("granted").alias("granted")).where("granted > 0")


@query("st06_producer_consumer", "select user_id as episode, row_number() over (partition by user_id order by ts, event_id) - 1 as part from events")
def st06(spark, d):
    rows, folder = stream(spark, d, numbered(spark, d))
    done = journal.prepared_and_checked(rows, lambda items: items.withColumn("valid", F.col("part") >= 0), folder)
    return done.where("state = 'released'").select("episode", "part")


@query("st08_publish_gate", """select o_orderkey as job, case when o_orderdate >= date '1998-01-01' then 'late'
    when o_orderstatus <> 'F' then 'invalid' else 'published' end as outcome from orders""")
def st08(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").cast("date").alias("at"), F.col("o_orderstatus").alias("status"))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # the watcher is started twice; the second time it finds only the reports that came since
    for reports in (orders.where("at < date'1995-01-01'"), orders.where("not at < date'1995-01-01' or at is null")):
        reports.write.mode("append").parquet(f"{folder}/in")
        found = journal.read_journal(spark, f"{folder}/in", orders.schema, files_per_batch=4)
        journal.publish_gate(found, F.col("status") == "F", F.col("at") < F.lit("1998-01-01").cast("date"), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("job", "outcome")


@query("st09_phase_queue", """with firsts as (select user_id, min(case when event_type = 'error' then event_id end) as f from events group by 1)
    select user_id as queue, event_id as phase, case when f is null or event_id < f then 'done' when event_id = f then 'failed' else 'waiting' end as state
    from events join firsts using (user_id)""")
def st09(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("phase"), "event_type")
    return journal.phase_states(log, "queue", "phase", F.col("event_type") == "error").select("queue", "phase", "state")


LINES = """with items as (select l_orderkey, l_linenumber, max(l_returnflag) as l_returnflag, max(l_linestatus) as l_linestatus from lineitem group by 1, 2),
    last as (select l_orderkey, max(l_linenumber) as m from items group by 1), lines as (
    select l_orderkey as log, l_linenumber as line, l_linenumber - 1 as seq, case when l_returnflag = 'R' then 'rejected' else 'verified' end as status,
        l_linenumber = m and l_linestatus = 'O' as torn from items join last using (l_orderkey)), entries as (select * from lines where not torn)"""


def log_lines(spark, d):
    """A log for each order; where the last line is still open, its write was cut off."""
    lines = table(spark, d, "lineitem").where("l_orderkey is not null").repartition("l_orderkey")  # all steps below are within an order
    items = lines.groupBy("l_orderkey", "l_linenumber")  # numbers repeat in an order, a log's lines don't
    items = items.agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    status = F.when(F.col("l_returnflag") == "R", "rejected").otherwise("verified")
    text = F.concat(F.lit('{"seq":'), F.col("l_linenumber") - 1, F.lit(',"status":"'), status, F.lit('"}'))
    torn = (F.col("l_linenumber") == F.col("m")) & (F.col("l_linestatus") == "O")
    whole = items.withColumn("m", F.max("l_linenumber").over(Window.partitionBy("l_orderkey")))
    return whole.select(F.col("l_orderkey").alias("log"), F.col("l_linenumber").cast("long").alias("line"), F.when(torn, F.substring(text, 1, 9)).otherwise(text).alias("text"))


@query("st12_recovered_prefix", LINES + """, firsts as (select log, seq from entries where status = 'verified' union select log, -1 from entries)
    select f.log, min(f.seq + 1) as verified from firsts f left join (select distinct log, seq from entries where status = 'verified') g
    on f.log = g.log and f.seq + 1 = g.seq where g.log is null group by f.log""")
def st12_prefix(spark, d):
    return journal.verified_prefix(journal.log_entries(log_lines(spark, d), "log", "line", "text"), "log")


@query("st12_rejections", LINES + """ select log, line, '{"seq":' || seq || ',"status":"rejected"}' as text from entries where status = 'rejected'""")
def st12_rejected(spark, d):
    return journal.rejections(journal.log_entries(log_lines(spark, d), "log", "line", "text"), "log", "line", "text")


@query("st12_never_sent", LINES + """ select distinct l.log, l.seq from lines l where not exists (select 1 from entries e where e.log = l.log and e.seq = l.seq)""")
def st12_unsent(spark, d):
    lines = log_lines(spark, d)
    expected = lines.select("log", (F.col("line") - 1).alias("seq")).distinct()
    return journal.never_sent(expected, journal.log_entries(lines, "log", "line", "text"), "log")
