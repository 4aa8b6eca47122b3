"""Timeline and window queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import timeline as tl
from .binding import episodes, frames, positives, runs, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


@query("tl01_dense_timeline", sql('select episode, frame, state, 1::bigint as covered from (select r.episode, f.frame, r.state from runs_a r join frames f on f.episode = r.episode and f.frame >= r."start" and f.frame < r."end")', "a"))
def tl01(spark, d):
    return tl.to_frames(runs(spark, d, "a")).select("episode", "frame", "state", "covered")


@query("tl02_runs_with_unknowns", sql('select episode, "start", "end", state from runs_p', "p"))
def tl02(spark, d):
    return runs(spark, d, "p")


@query("tl03_coalesce", sql('''select episode, min("start") as "start", max("end") as "end", state, count(*) as parts from (
    select *, sum(new) over (partition by episode order by "start") as island from (
        select *, case when lag("end") over w = "start" and lag(state) over w = state then 0 else 1 end as new
        from (select episode, frame as "start", frame + 1 as "end", p as state from frames where p is not null) window w as (partition by episode order by "start")))
    group by episode, island, state'''))
def tl03(spark, d):
    # every frame with a state; the gaps are the track's unknowns
    rows = frames(spark, d).where("p is not null")
    rows = rows.select("episode", F.col("frame").alias("start"), (F.col("frame") + 1).alias("end"), F.col("p").alias("state"))
    return tl.coalesce_segments(rows).select("episode", "start", "end", "state", "parts")


@query("tl04_bouts", sql('''select episode, min(frame) as "start", max(frame) + 1 as "end" from (
    select episode, frame, frame - row_number() over (partition by episode order by frame) as g from frames where c <> 3) group by episode, g'''))
def tl04(spark, d):
    touching = runs(spark, d, "c").where("state <> 3")
    return tl.coalesce_segments(touching, any_state=True).select("episode", "start", "end")


@query("prj11_binary_projection", sql('''select track, episode, min("start") as "start", max("end") as "end", state from (
    select *, sum(new) over (partition by track, episode order by "start") as island from (
        select *, case when lag(state) over (partition by track, episode order by "start") = state then 0 else 1 end as new
        from (select 'c' as track, episode, "start", "end", state = 1 as state from runs_c union all select 'p', episode, "start", "end", state from runs_p)))
    group by track, episode, island, state''', "c", "p"))
def prj11(spark, d):
    # every run of the 3-class score, and of a track whose unknowns are the gaps to be bridged
    c = runs(spark, d, "c").select(F.lit("c").alias("track"), "episode", "start", "end", (F.col("state") == 1).alias("state"))
    p = runs(spark, d, "p").select(F.lit("p").alias("track"), "episode", "start", "end", "state")
    found = tl.coalesce_segments(c.union(p), ["track", "episode"], contiguous=False)
    return found.select("track", "episode", "start", "end", "state")


@query("tl05_clip_to_cores", sql('''select w.episode, w.core // 32 as "window", greatest("start", w.core) as "start", least("end", w.core + 32, w.n_frames) as "end", state
    from (select episode, n_frames, unnest(generate_series(0, n_frames - 1, 32)) as core from episodes) w
    join runs_a r on r.episode = w.episode and r."start" < least(w.core + 32, w.n_frames) and r."end" > w.core''', "a"))
def tl05(spark, d):
    windows = tl.core_windows(episodes(spark, d), 32, 8).select("episode", "window", "core_start", "core_end")
    return tl.clip(runs(spark, d, "a"), windows)


@query("tl06_shift", sql('''select * from (select episode, greatest("start" - 3, 0) as "start", greatest("end" - 3, 0) as "end", state from runs_a) where "end" > "start"''', "a"))
def tl06(spark, d):
    rows = runs(spark, d, "a").join(episodes(spark, d).select("episode", "n_frames"), "episode")
    return tl.shift(rows, -3).select("episode", "start", "end", "state")


@query("tl06_split", sql('''select episode, "start", case when "end" - "start" > 1 then ("start" + "end") // 2 else "end" end as "end" from runs_a
    union all select episode, ("start" + "end") // 2, "end" from runs_a where "end" - "start" > 1''', "a"))
def tl06_split(spark, d):
    return tl.split_in_half(runs(spark, d, "a")).select("episode", "start", "end")


@query("tl07_jitter_cells", sql('''select episode, "start", low, high from (
    select r.episode, "start", coalesce((lag("start") over w + "start") // 2, 0) as low, ("start" + coalesce(lead("start") over w, n_frames)) // 2 as high
    from runs_a r join episodes using (episode) window w as (partition by r.episode order by "start")) where "start" > 0''', "a"))
def tl07(spark, d):
    rows = runs(spark, d, "a").join(episodes(spark, d).select("episode", "n_frames"), "episode")
    return tl.jitter_cells(rows).select("episode", "start", "low", "high")


OVERLAPS = '''select x.episode, x."start" as left_start, x."end" as left_end, y."start" as right_start, y."end" as right_end,
    least(x."end", y."end") - greatest(x."start", y."start") as overlap,
    round((least(x."end", y."end") - greatest(x."start", y."start")) / (greatest(x."end", y."end") - least(x."start", y."start")), 6) as iou
    from runs_a x join runs_b y on x.episode = y.episode and x."start" < y."end" and y."start" < x."end" where x.state and y.state'''


@query("tl08_jn04_overlap_join", sql(OVERLAPS, "a", "b"))
def tl08(spark, d):
    pairs = tl.overlaps(positives(spark, d, "a"), positives(spark, d, "b"))
    return pairs.select("episode", "left_start", "left_end", "right_start", "right_end", "overlap", F.round("iou", 6).alias("iou"))


@query("tl09_frame_set_algebra", sql("""select episode, count(*) filter (a and b) as both, count(*) filter (a or b) as either,
    count(*) filter (a <> b) as differing, count(*) filter (a and not b) as only_a from frames group by episode"""))
def tl09(spark, d):
    # interval arithmetic: no frame is made
    a, b = positives(spark, d, "a"), positives(spark, d, "b")
    length = F.sum(F.col("end") - F.col("start"))
    both = tl.overlaps(a, b).groupBy("episode").agg(F.sum("overlap").alias("both"))
    sizes = a.groupBy("episode").agg(length.alias("na")).join(b.groupBy("episode").agg(length.alias("nb")), "episode", "full_outer")
    every = episodes(spark, d).select("episode").join(sizes, "episode", "left").join(both, "episode", "left").na.fill(0)
    return every.select(
        "episode", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either"),
        (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("differing"), (F.col("na") - F.col("both")).alias("only_a"),
    )


@query("tl10_boundaries", sql("""select episode, frame, direction from (select episode, frame, cast(a as int) - cast(lag(a) over (partition by episode order by frame) as int) as direction from frames) where direction <> 0"""))
def tl10(spark, d):
    return tl.boundaries(frames(spark, d), "a")


@query("tl11_wn10_step_labels", sql('''select episode, step, exists (select 1 from runs_a r where r.episode = s.episode and r.state and r."start" < (s.step + 1) * s.fps and r."end" > s.step * s.fps) as positive
    from (select episode, fps, unnest(generate_series(0, cast(ceil(n_frames / fps) as bigint) - 1)) as step from episodes) s''', "a"))
def tl11(spark, d):
    return tl.step_labels(positives(spark, d, "a"), episodes(spark, d))


@query("tl20_uncertain_masked_scores", sql('''select episode, count(*) as scored, count(*) filter (a = b) as agreed from frames f
    where not exists (select 1 from runs_c u where u.episode = f.episode and u.state = 2 and f.frame >= u."start" and f.frame < u."end") group by episode''', "c"))
def tl20(spark, d):
    unsure = tl.to_frames(runs(spark, d, "c").where("state = 2")).select("episode", "frame")
    left = frames(spark, d).join(unsure, ["episode", "frame"], "left_anti")
    return left.groupBy("episode").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))


@query("tl21_disagreement_intervals", sql('''select episode, min(frame) as "start", max(frame) + 1 as "end" from (
    select episode, frame, frame - row_number() over (partition by episode order by frame) as g from frames where not (a = b and b = (c = 1))) group by episode, g'''))
def tl21(spark, d):
    rows = frames(spark, d).withColumn("c1", F.col("c") == 1)
    return tl.disagreements(rows, ["a", "b", "c1"])


@query("tl22_stitched_parts", sql('''select w.episode, w.s // 50 as part, greatest(r."start", w.s) as "start", least(r."end", w.s + 50, w.n_frames) as "end"
    from (select episode, n_frames, unnest(generate_series(0, n_frames - 1, 50)) as s from episodes) w
    join runs_b r on r.episode = w.episode and r.state and r."start" < least(w.s + 50, w.n_frames) and r."end" > w.s''', "b"))
def tl22(spark, d):
    parts = tl.core_windows(episodes(spark, d), 50, 0).select("episode", "window", "core_start", "core_end")
    return tl.clip(positives(spark, d, "b"), parts).select("episode", F.col("window").alias("part"), "start", "end")


@query("tl23_close_runs", sql('''select r.episode, r."start", r."end", round(min(f.value), 6) as low, round(max(f.value), 6) as high, round(any_value(n.value) - min(f.value), 6) as rise
    from runs_b r join frames f on f.episode = r.episode and f.frame >= r."start" and f.frame < r."end"
    left join frames n on n.episode = r.episode and n.frame = r."end" where r.state group by all''', "b"))
def tl23(spark, d):
    order = Window.partitionBy("episode").orderBy("frame")
    rows = frames(spark, d).withColumn("following", F.lead("value").over(order))
    island = F.col("frame") - F.row_number().over(Window.partitionBy("episode", "b").orderBy("frame"))
    groups = rows.withColumn("g", island).where("b").groupBy("episode", "g")
    return groups.agg(
        F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"),
        F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"),
        F.round(F.max_by("following", "frame") - F.min("value"), 6).alias("rise"),
    ).drop("g")


@query("tl24_structured_differences", sql('''select x.episode, x."start" as left_start, y."start" as right_start, x.state as left_state, y.state as right_state,
    least(x."end", y."end") - greatest(x."start", y."start") as frames
    from runs_a x join runs_b y on x.episode = y.episode and x."start" < y."end" and y."start" < x."end" and x.state <> y.state''', "a", "b"))
def tl24(spark, d):
    pairs = tl.overlaps(runs(spark, d, "a"), runs(spark, d, "b")).where("left_state <> right_state")
    return pairs.select("episode", "left_start", "right_start", "left_state", "right_state", F.col("overlap").alias("frames"))


@query("tl25_wn09_busiest_excerpt", sql('''select episode, frame as "start", round(activity, 4) as activity from (
    select *, row_number() over (partition by episode order by activity desc, frame desc) as r from (
        select episode, frame, n_frames, sum(cast(c as double)) over (partition by episode order by frame rows between current row and 19 following) as activity from frames)
    where frame % 5 = 0 and (frame + 20 <= n_frames or frame = 0)) where r = 1'''))
def tl25(spark, d):
    rows = frames(spark, d).withColumn("activity_value", F.col("c").cast("double"))
    return tl.busiest_excerpt(rows, "activity_value", 20, 5).withColumn("activity", F.round("activity", 4))


@query("tl26_majority_vote_runs", sql('''select episode, min(step) as "start", max(step) + 1 as "end", c as state from (
    select episode, step, c, step - row_number() over (partition by episode, c order by step) as g from (
        select episode, frame // 3 as step, c, row_number() over (partition by episode, frame // 3 order by count(*) desc, c) as r from frames group by episode, frame // 3, c)
    where r = 1) group by episode, c, g'''))
def tl26(spark, d):
    rows = frames(spark, d).withColumn("step", F.floor(F.col("frame") / 3))
    voted = tl.majority(rows, ["episode", "step"], "c").withColumnRenamed("step", "frame")
    return tl.to_runs(voted, "c")


@query("wn01_core_windows", sql('''select episode, core_start, least(core_start + 32, n_frames) as core_end, greatest(core_start - 8, 0) as context_start, least(core_start + 40, n_frames) as context_end
    from (select episode, n_frames, unnest(generate_series(0, n_frames - 1, 32)) as core_start from episodes)'''))
def wn01(spark, d):
    return tl.core_windows(episodes(spark, d), 32, 8).select(
        "episode", "core_start", "core_end", "context_start", "context_end"
    )


@query("wn02_sliding_windows", sql('''select episode, i as "window", i * step as "start", least(i * step + size, n_frames) as "end" from (
    select episode, n_frames, size, step, unnest(generate_series(0, greatest(0, cast(ceil((n_frames - size) / step) as bigint)))) as i from (
        select *, cast(floor(fps * 2) as bigint) as size, cast(floor(fps * 1.5) as bigint) as step from episodes))'''))
def wn02(spark, d):
    return tl.sliding_windows(episodes(spark, d), 2.0, 0.5).select("episode", "window", "start", "end")


@query("wn03_chained_parts", sql('''select episode, s // 35 as part, s as "start", least(s + 35, n_frames) as "end", greatest(0, s - 2) as context_start, case when s > 0 then s // 35 - 1 end as previous_part
    from (select episode, n_frames, unnest(generate_series(0, n_frames - 1, 35)) as s from episodes)'''))
def wn03(spark, d):
    return tl.chained_parts(episodes(spark, d), 35, 2).select("episode", "part", "start", "end", "context_start", "previous_part")


@query("wn04_centred_windows", sql('''select s.episode, w as window_start, least(w + 16, n_frames) as window_end from (
    select episode, n_frames, greatest(0, least(("start" + "end") // 2 - 8, greatest(n_frames - 16, 0))) as w from (
        select *, row_number() over (partition by episode order by "end" - "start", "start") as r from runs_a where state) join episodes using (episode) where r = 1) s''', "a"))
def wn04(spark, d):
    return tl.centred_windows(runs(spark, d, "a"), episodes(spark, d), 16)


@query("wn05_switches", sql("""select episode, count(*) filter (was <> a) as switches, count(*) filter (was <> a and wasc <> c) as with_class_switch from (
    select episode, a, c, lag(a) over w as was, lag(c) over w as wasc from frames window w as (partition by episode order by frame)) group by episode"""))
def wn05(spark, d):
    w = Window.partitionBy("episode").orderBy("frame")
    rows = frames(spark, d).withColumns({"was": F.lag("a").over(w), "wasc": F.lag("c").over(w)})
    switched = F.col("was") != F.col("a")
    return rows.groupBy("episode").agg(
        F.count_if(switched).alias("switches"), F.count_if(switched & (F.col("wasc") != F.col("c"))).alias("with_class_switch")
    )


@query("wn06_prj01_partition_check", sql('''select 'gap' as rule, episode, "start" as place from (
    select *, lag("end", 1, 0) over (partition by episode order by "start") as cursor from runs_p) where cursor <> "start"
    union all select 'not_at_end', episode, max("end") from runs_p join episodes using (episode) group by episode, n_frames having max("end") <> n_frames''', "p"))
def wn06(spark, d):
    from ..operators.validate import partition_violations

    return partition_violations(runs(spark, d, "p"), episodes(spark, d))


@query("wn07_average_ranks", sql("""select doc_id, round(rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0, 1)::double as avg_rank from documents"""))
def wn07(spark, d):
    from ..operators.stats import average_rank

    docs = spark.read.parquet(f"{d}/documents.parquet")
    return average_rank(docs.select("doc_id", "n_chars"), "n_chars").select("doc_id", "avg_rank")


@query("wn08_forward_fill", sql("""select episode, frame, last_value(case when a then c end ignore nulls) over (partition by episode order by frame rows unbounded preceding) as filled from frames"""))
def wn08(spark, d):
    rows = frames(spark, d).select("episode", "frame", F.when(F.col("a"), F.col("c")).cast("int").alias("filled"))
    return tl.forward_fill(rows, "filled", ["episode"], "frame")


@query("wn11_median_period", sql("""select episode, round(quantile_cont(gap, 0.5), 3) as median_gap from (
    select episode, (epoch_us(lead(ts) over (partition by episode order by frame)) - epoch_us(ts)) / 1000000.0 as gap from frames) where gap is not null group by episode"""))
def wn11(spark, d):
    from ..operators.quantiles import quantiles

    w = Window.partitionBy("episode").orderBy("frame")
    gap = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    rows = frames(spark, d).withColumn("gap", gap).where("gap is not null")
    return quantiles(rows, "gap", [0.5], ["episode"]).select("episode", F.round(F.col("q")[0], 3).alias("median_gap"))


@query("wn12_scored_once", sql("""select episode, count(*) as frames, max(n) as most from (
    select f.episode, f.frame, count(*) as n from frames f join (select episode, unnest(generate_series(0, n_frames - 1, 32)) as s, n_frames from episodes) w
    on f.episode = w.episode and f.frame >= w.s and f.frame < w.s + 32 group by 1, 2) group by episode"""))
def wn12(spark, d):
    cores = tl.core_windows(episodes(spark, d), 32, 8).select("episode", F.col("core_start").alias("start"), F.col("core_end").alias("end"))
    once = tl.to_frames(cores).groupBy("episode", "frame").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("episode").agg(F.count(F.lit(1)).alias("frames"), F.max("n").alias("most"))


@query("event_time_tumbling", """select date_trunc('hour', ts) as "start", event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2""")
def tumbling(spark, d):
    from ..streaming.journal import hourly

    return hourly(spark.read.parquet(f"{d}/events.parquet"))


@query("session_windows", """select user_id, count(*) as n, min(ts) as first_ts from (
    select *, sum(new) over (partition by user_id order by ts, event_id) as s from (
        select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events))
    group by user_id, s""")
def sessions(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    by_session = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return by_session.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts")).drop("w")
