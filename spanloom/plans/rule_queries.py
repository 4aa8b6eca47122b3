"""Queries for annotation rules, calibration of thresholds, soft boundary scores and small expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layout
from ..operators import agreement as ag
from ..operators import atomic, kernels, matching, stats
from ..operators import sampling as sp
from ..operators import timeline as tl
from ..operators import validate as va
from .binding import FRAMES, episodes, frames, positives, runs, runs_sql, sql, table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


CATEGORIES = ["slip", "drop"]
CAMERAS = ["agent", "wrist"]

#: Annotations made of events, a segment each, that break every rule somewhere.
ANNOTATIONS = f"""{FRAMES}, numbered as (
        select *, event_id as e, cast(json_extract_string(props, '$.k') as bigint) as k,
            sum(fresh) over (partition by episode order by frame) as nth
        from (select f.*, e.props, case when lag(f.event_type) over (partition by f.episode order by frame) = f.event_type then 0 else 1 end as fresh from frames f join events e using (event_id))
    ), segments as (
        select episode, frame as "start", frame + 1 as "end", 'a' || (nth + case when e % 97 = 0 then 1 else 0 end)::bigint as action_id,
            case when e % 31 = 0 then 'Reach' when e % 43 = 0 then 'unknown' else event_type end as action,
            case when e % 3 = 0 then null when e % 53 = 0 then 'o2' else 'o1' end as object_id, case when e % 41 = 0 then ' ' end as destination_id,
            case when e % 101 <> 0 then event_type = 'error' end as failure,
            case when event_type <> 'error' or k % 7 = 0 then []::varchar[] when k % 7 = 1 then ['slip', 'slip'] when k % 7 = 2 then ['odd'] else ['slip'] end as categories,
            case when event_type = 'error' and k >= 3 then 'none' end as recovery,
            case when event_type = 'error' and k >= 5 or event_type <> 'error' and k >= 95 then 'low' end as severity,
            case when event_type = 'error' then 'immediate' end as resetability,
            k % 11 = 0 as review_required, case when k % 11 = 0 and k <> 55 then 'dim' else '' end as uncertainty,
            case when e % 89 = 0 then '' else 'done' end as observed_result, frame - frame % 2 + case when e % 61 = 0 then 1 else 0 end as cited,
            case when e % 71 = 0 then 'rear' else 'agent' end as camera, e % 67 <> 0 as has_evidence
        from numbered where e % 83 <> 0
    )"""


@query("prj04_atomic_annotations", f"""with {ANNOTATIONS}, linked as (
        select *, lag(action_id) over w as was, lag(action) over w as action_was, lag(failure) over w as failure_was, lag(list_sort(list_distinct(categories))) over w as categories_was, lag("end") over w as cursor
        from segments window w as (partition by episode order by "start")
    ), counted as (select *, sum(case when was is null or was <> action_id then 1 else 0 end) over (partition by episode order by "start") as ordinal from linked
    ), known as (
        select *, last_value(object_id ignore nulls) over u as object_was, last_value(destination_id ignore nulls) over u as destination_was
        from counted window u as (partition by episode, ordinal order by "start" rows between unbounded preceding and 1 preceding)
    ), listed as (select k.*, n_frames from known k left join (select * from episodes where episode % 50 <> 7) using (episode)
    ), broken as (select episode, "start" as place, unnest([
        case when n_frames is null then 'unknown_episode' end,
        case when "start" <> coalesce(cursor, 0) then 'boundary' end,
        case when observed_result = '' then 'text' end,
        case when action = 'Reach' then 'operation' end,
        case when destination_id is not null then 'referent' end,
        case when failure is null then 'label' end,
        case when list_contains(categories, 'odd') or len(categories) > 1 then 'categories' end,
        case when failure and (recovery is null or severity is null or resetability is null or len(categories) = 0)
            or failure is not true and (len(categories) > 0 or recovery is not null or severity is not null or resetability is not null) then 'consequence' end,
        case when not has_evidence or cited % 2 = 1 or camera = 'rear' or n_frames is null then 'evidence' end,
        case when review_required and uncertainty = '' then 'review' end,
        case when action = 'unknown' and not review_required then 'unknown_operation' end,
        case when was is distinct from action_id and action_id <> 'a' || ordinal::bigint then 'chronology' end,
        case when was = action_id and action <> action_was then 'operation_changed' end,
        case when was = action_id and failure is not distinct from failure_was and list_sort(list_distinct(categories)) = categories_was then 'split_action' end,
        case when object_id <> object_was or destination_id <> destination_was then 'referent_changed' end]) as rule from listed)
    select rule, episode, place from broken where rule is not null
    union all select case when place is null then 'no_segments' else 'not_at_end' end, episode, coalesce(place, 0) from (
        select e.episode, n_frames, max("end") as place from episodes e left join segments s on s.episode = e.episode where e.episode % 50 <> 7 group by all) where place is null or place <> n_frames""")
def prj04_atomic(spark, d):
    """Every rule of an atomic-action annotation: chronological ids, pieces of an action, participants with nulls between."""
    w = Window.partitionBy("episode").orderBy("frame")
    k = F.get_json_object("props", "$.k").cast("long")
    e, error = F.col("event_id"), F.col("event_type") == "error"
    rows = frames(spark, d, k.alias("k")).where("event_id is not null")  # the SQL's join of an event with itself
    fresh = F.coalesce((F.lag("event_type").over(w) != F.col("event_type")).cast("long"), F.lit(1))
    rows = rows.withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(w)).where(e % 83 != 0)
    k = F.col("k")
    cited = F.col("frame") - F.col("frame") % 2 + (e % 61 == 0).cast("long")
    proof = F.struct(cited.alias("frame"), F.when(e % 71 == 0, "rear").otherwise("agent").alias("camera"), F.lit("seen").alias("observation"))
    lists = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    segments = rows.select(
        "episode", F.col("frame").alias("start"), (F.col("frame") + 1).alias("end"),
        F.concat(F.lit("a"), (F.col("nth") + (e % 97 == 0).cast("long")).cast("string")).alias("action_id"),
        F.when(e % 31 == 0, "Reach").when(e % 43 == 0, "unknown").otherwise(F.col("event_type")).alias("action"),
        F.when(e % 3 == 0, None).when(e % 53 == 0, "o2").otherwise("o1").alias("object_id"), F.when(e % 41 == 0, " ").alias("destination_id"),
        F.when(e % 101 != 0, error).alias("failure"),
        F.when(~error | (k % 7 == 0), lists()).when(k % 7 == 1, lists("slip", "slip")).when(k % 7 == 2, lists("odd")).otherwise(lists("slip")).alias("categories"),
        F.when(error & (k >= 3), "none").alias("recovery"), F.when((error & (k >= 5)) | (~error & (k >= 95)), "low").alias("severity"), F.when(error, "immediate").alias("resetability"),
        (k % 11 == 0).alias("review_required"), F.when((k % 11 == 0) & (k != 55), "dim").otherwise("").alias("uncertainty"),
        F.when(e % 89 == 0, "").otherwise("done").alias("observed_result"), F.lit("contact").alias("boundary_reason"), F.lit("as seen").alias("what_happened"),
        F.when(e % 67 != 0, F.array(proof)).otherwise(F.array().cast("array<struct<frame:bigint,camera:string,observation:string>>")).alias("evidence"),
    )
    known = episodes(spark, d).where("episode % 50 <> 7").withColumn("sampled", F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1, F.lit(2).cast("long")))
    return atomic.atomic_violations(segments, known, CATEGORIES, CAMERAS)


@query("ag05_axes_and_states", sql("""select lab, frames, round(axis, 6) as axis_accuracy, round(joint, 6) as joint_accuracy, round((joint - chance) / (1 - chance), 6) as joint_kappa, round(d0, 6) as dice_0, round(d1, 6) as dice_1 from (
    select lab, count(*) as frames, avg(((l // 2 = r // 2)::int + (l % 2 = r % 2)::int) / 2.0) as axis, avg((l = r)::int) as joint,
        avg((l = 0)::int) * avg((r = 0)::int) + avg((l = 1)::int) * avg((r = 1)::int) + avg((l = 2)::int) * avg((r = 2)::int) + avg((l = 3)::int) * avg((r = 3)::int) as chance,
        2 * count(*) filter (l >= 2 and r >= 2) / (count(*) filter (l >= 2) + count(*) filter (r >= 2))::double as d0,
        2 * count(*) filter (l % 2 = 1 and r % 2 = 1) / (count(*) filter (l % 2 = 1) + count(*) filter (r % 2 = 1))::double as d1
    from (select lab, (value > 100)::int * 2 + a::int as l, (c = 1)::int * 2 + p::int as r from frames where p is not null) group by lab)"""))
def ag05_states(spark, d):
    rows = frames(spark, d).withColumns({"l0": F.col("value") > 100, "r0": F.col("c") == 1})
    return rounded(ag.state_agreement(rows, ["l0", "a"], ["r0", "p"], ["lab"]), "axis_accuracy", "joint_accuracy", "joint_kappa", "dice_0", "dice_1")


@query("ag05_type_agreement", sql("""select s.*, round(macro, 6) as macro_dice, eligible from (
    select lab, count(*) as frames, round(avg(case when u > 0 then i / u::double end), 6) as jaccard, round(avg((u > 0)::int), 6) as nonempty, round(avg((x = y)::int), 6) as exact, round(2 * sum(i) / sum(i + u)::double, 6) as micro_dice
    from (select lab, x, y, len(list_intersect(x, y)) as i, len(list_distinct(list_concat(x, y))) as u from (
        select lab, list_filter([case when a then 0 end, case when value > 20 then 1 end, case when frame % 2 = 0 then 2 end], lambda t: t is not null) as x, list_filter([case when p then 0 end, case when c = 1 then 1 end, case when c = 2 then 2 end], lambda t: t is not null) as y from frames)) group by lab) s
    join (select lab, avg(dice) as macro, count(dice) as eligible from (
        select lab, t, 2 * count(*) filter (x and y) / nullif(count(*) filter (x) + count(*) filter (y), 0)::double as dice from (
            select lab, 0 as t, a as x, p as y from frames union all select lab, 1, value > 20, c = 1 from frames union all select lab, 2, frame % 2 = 0, c = 2 from frames) group by lab, t) group by lab) m using (lab)"""))
def ag05_types(spark, d):
    rows = frames(spark, d).withColumns({"x1": F.col("value") > 20, "x2": F.col("frame") % 2 == 0, "y1": F.col("c") == 1, "y2": F.col("c") == 2})
    return rounded(ag.type_agreement(rows, ["a", "x1", "x2"], ["p", "y1", "y2"], ["lab"]), "jaccard", "nonempty", "exact", "macro_dice", "micro_dice")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("ag22_pairwise_auroc", """with counts as (select event_type as g, value as s, count(*) as n from events where value is not null group by 1, 2),
    ranked as (select x.g as left_group, y.g as right_group, x.n as n, (select coalesce(sum(n), 0) from counts z where z.g = y.g and z.s < x.s) + (select coalesce(sum(n), 0) from counts z where z.g = y.g and z.s = x.s) / 2 as wins
        from counts x join (select distinct g from counts) y on x.g < y.g)
    select left_group, right_group, round(sum(n * wins) / (sum(n) * any_value(m)), 6) as auroc from ranked join (select g as right_group, sum(n) as m from counts group by 1) using (right_group) group by 1, 2""")
def ag22_pairwise(spark, d):
    return rounded(stats.pairwise_auroc(table(spark, d, "events"), "value", "event_type", KINDS), "auroc")


@query("ag23_fitted_thresholds", """with scored as (select n_chars / 4000.0::double as s, toxic = 1 as y from labels join documents using (doc_id) where n_chars is not null),
    totals as (select count(*) filter (y) as p, count(*) filter (not y) as q from scored), u as (select distinct s from scored),
    cuts as (select (s + coalesce(lag(s) over (order by s), s - 2e-6)) / 2 as threshold from u union all select max(s) + 1e-6 from u),
    f as (select threshold, coalesce(2 * tp / nullif(tp + fp + p, 0)::double, 0) as value from (
        select threshold, count(*) filter (s > threshold and y) as tp, count(*) filter (s > threshold and not y) as fp from cuts, scored group by threshold), totals),
    b as (select threshold, 0.5 * (tp / nullif(p, 0)::double + tn / nullif(q, 0)::double) as value from (
        select threshold, count(*) filter (s >= threshold and y) as tp, count(*) filter (s < threshold and not y) as tn from (select s as threshold from u union select 0::double union select 1::double), scored group by threshold), totals)
    select * from (select 'midpoint_f1' as rule, round(threshold, 6) as threshold, round(value, 6) as value from f where value >= (select max(value) from f) - 1e-12 order by abs(f.threshold - 0.5), f.threshold limit 1)
    union all select * from (select 'balanced', round(threshold, 6), round(value, 6) from b where value is not null order by b.value desc, b.threshold limit 1)""")
def ag23_fitted(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(stats.fitted_thresholds(rows.withColumn("s", F.col("n_chars") / 4000.0), "s", F.col("toxic") == 1), "threshold", "value")


def held_out_sql(fold: str) -> str:
    return f"""with {FRAMES}, scored as (select {fold} as fold, round(least(greatest(value / 200, 0), 1) * 100)::int as s, a as y from frames where value is not null),
    own as (select fold, s, count(*) filter (y) as p, count(*) filter (not y) as q from scored group by all), folds as (select distinct fold from own),
    every as (select s, sum(p) as p, sum(q) as q, sum(p + q) as n from own group by s),
    swept as (select fold, t, (select sum(p) from every) - coalesce((select sum(p) from own o where o.fold = f.fold), 0) as np, (select sum(q) from every) - coalesce((select sum(q) from own o where o.fold = f.fold), 0) as nq,
            coalesce((select sum(p) from every where s >= t), 0) - coalesce((select sum(p) from own o where o.fold = f.fold and s >= t), 0) as tp, coalesce((select sum(q) from every where s < t), 0) - coalesce((select sum(q) from own o where o.fold = f.fold and s < t), 0) as tq,
            (select sum(p) from own o where o.fold = f.fold) as hp, (select sum(q) from own o where o.fold = f.fold) as hq, coalesce((select sum(p) from own o where o.fold = f.fold and s >= t), 0) as htp, coalesce((select sum(q) from own o where o.fold = f.fold and s < t), 0) as htq
        from folds f, (select unnest(range(101)) as t) where t in (0, 100) or coalesce((select n from every where s = t), 0) > coalesce((select sum(p + q) from own o where o.fold = f.fold and o.s = t), 0)),
    best as (select *, 0.5 * (tp / nullif(np, 0)::double + tq / nullif(nq, 0)::double) as fitted, 0.5 * (htp / nullif(hp, 0)::double + htq / nullif(hq, 0)::double) as held_out from swept)
    select fold, case when fitted is not null then t / 100::double end as threshold, round(fitted, 6) as fitted, round(case when fitted is not null then held_out end, 6) as held_out, (hp + hq)::bigint as n from best
    qualify row_number() over (partition by fold order by coalesce(fitted, -1) desc, t) = 1"""


@query("ag24_leave_one_episode_out", held_out_sql("episode"))
def ag24_episodes(spark, d):
    rows = frames(spark, d).withColumn("s", F.col("value") / 200)
    return rounded(stats.held_out_thresholds(rows, "episode", "s", F.col("a")), "fitted", "held_out")


@query("ag24_hash_split", held_out_sql("list_sum(list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(sha256(episode::varchar), i, 1)) - 1))::bigint % 3 = 0"))
def ag24_hash(spark, d):
    """Fitted on the episodes of one side of a hash split, measured on the other, both ways."""
    rows = frames(spark, d).withColumns({"s": F.col("value") / 200, "test": sp.hash_mod3("episode") == 0})
    return rounded(stats.held_out_thresholds(rows, "test", "s", F.col("a")), "fitted", "held_out")


MEASURES = [("hard", "absolute", 0.25), ("linear", "absolute", 0.5), ("exp", "absolute", 0.5), ("hard", "relative", 0.5), ("linear", "hybrid", 0.2), ("exp", "hybrid", 0.2)]


def touching_sql(track: str) -> str:
    return f"""select episode, row_number() over (partition by episode order by f) as i, f / fps as t, least(f - s, e - f) / fps as d from (
        select episode, "start" as s, "end" as f, lead("start") over w as n, lead("end") over w as e from runs_{track} window w as (partition by episode order by "start")) join episodes using (episode) where n = f"""


KERNELS = f"""with recursive {FRAMES}{"".join(map(runs_sql, "ab"))}, l as ({touching_sql("a")}), r as ({touching_sql("b")}),
    m(id, kernel, kind, scale) as (values {", ".join(f"({i}, '{a}', '{b}', {c}::double)" for i, (a, b, c) in enumerate(MEASURES))}),
    w as (select k, i, j, case kernel when 'hard' then (q <= 1 + 1e-9)::int::double when 'linear' then greatest(0, 1 - q) else exp(-q) end as gain from (
        select x.episode * 10 + id as k, x.i, y.i as j, kernel, abs(x.t - y.t) / greatest(1e-9, case kind when 'absolute' then scale when 'relative' then scale * least(x.d, y.d) else greatest(0.25, scale * least(x.d, y.d)) end) as q
        from l x join r y using (episode), m)),
    sizes as (select k, max(i) as n from w group by k), dp(k, i, j, v) as (
        select distinct k, 0::bigint, j, 0::double from w
        union all
        select k, i + 1, j, max(c) over (partition by k order by j rows unbounded preceding) from (
            select d.k, d.i, d.j, greatest(d.v, coalesce(lag(d.v, 1, 0::double) over (partition by d.k order by d.j) + w.gain, 0)) as c
            from dp d join sizes on sizes.k = d.k and d.i < sizes.n left join w on w.k = d.k and w.i = d.i + 1 and w.j = d.j))
    select e.episode, kernel, kind, scale, coalesce(nl, 0) as n_left, coalesce(nr, 0) as n_right, round(coalesce(v, 0), 6) as total,
        round(case when coalesce(nl, 0) + coalesce(nr, 0) = 0 then 1 else 2 * coalesce(v, 0) / (coalesce(nl, 0) + coalesce(nr, 0)) end, 6) as score
    from episodes e cross join m left join (select episode, count(*) as nl from l group by 1) using (episode) left join (select episode, count(*) as nr from r group by 1) using (episode)
    left join (select k, max(v) as v from dp group by k) o on o.k = e.episode * 10 + m.id"""


@query("fn_boundary_kernels", KERNELS)
def boundary_kernels(spark, d):
    """Soft boundary agreement of two tracks by kernels of the distance, matched in order with the largest total weight."""
    found = kernels.kernel_scores(runs(spark, d, "a"), runs(spark, d, "b"), episodes(spark, d), MEASURES)
    return rounded(found, "total", "score")


ARMS = [2, 4]
BOUTS = """select episode * 100 + arm * 10 + category as k, row_number() over (partition by episode, arm, category order by min(frame)) as i, min(frame) as s, max(frame) + 1 as e
    from (select *, frame - row_number() over (partition by episode, arm, category order by frame) as island from {rows} where {on}) group by episode, arm, category, island"""


@query("ag41_matched_bouts", f"""with recursive {FRAMES}, arms as (select unnest({ARMS}) as arm), held as (
        select f.*, arm, h.a as pa, h.b as pb, h.c as pc, f.frame % arm = 0 or f.frame = f.n_frames - 1 as sampled from frames f cross join arms
        join frames h on h.episode = f.episode and h.frame = case when f.frame = f.n_frames - 1 then f.frame else f.frame - f.frame % arm end
    ), tracks as (select episode, arm, frame, 0 as category, a as x, pa as y from held union all select episode, arm, frame, 1, b, pb from held union all select episode, arm, frame, 2, c = 1, pc = 1 from held
    ), l as ({BOUTS.format(rows="tracks", on="x")}), r as ({BOUTS.format(rows="tracks", on="y")}), w as (
        select * from (select x.k, x.i, y.i as j, greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s))::double as iou from l x join r y on x.k = y.k) where iou >= 0.5
    ), sizes as (select k, max(i) as n from w group by k), dp(k, i, j, v) as (
        select distinct r.k, 0::bigint, r.i, 0 from r join sizes using (k)
        union all
        select k, i + 1, j, max(c) over (partition by k order by j rows unbounded preceding) from (
            select d.k, d.i, d.j, greatest(d.v, coalesce(lag(d.v, 1, 0) over (partition by d.k order by d.j) + case when w.iou is not null then 1 end, 0)) as c
            from dp d join sizes on sizes.k = d.k and d.i < sizes.n left join w on w.k = d.k and w.i = d.i + 1 and w.j = d.j))
    select arm, pairs, state_agreement, category_agreement, cost, cost_ratio, baseline, predicted, coalesce(matched, 0)::bigint as matched from (
        select arm, count(*) filter (sampled) as pairs, round(avg((a = pa and b = pb)::int), 6) as state_agreement, round(avg((a = pa and b = pb and (c = 1) = (pc = 1))::int), 6) as category_agreement,
            round(sum(value) filter (sampled) / 100, 4) as cost, round(sum(value) filter (sampled) / sum(value), 6) as cost_ratio from held group by arm)
    left join (select k // 10 % 10 as arm, count(*) as baseline from l group by 1) using (arm) left join (select k // 10 % 10 as arm, count(*) as predicted from r group by 1) using (arm)
    left join (select k // 10 % 10 as arm, sum(v) as matched from (select k, max(v) as v from dp group by k) group by 1) using (arm)""")
def ag41_bouts(spark, d):
    """Arms that see every second or fourth frame, against all frames: agreement, bouts of equal category matched at an
    IoU of 0.5 (most pairs), and what the sampled frames cost."""
    arm = F.explode(F.array(*map(F.lit, ARMS)))
    last = F.col("frame") == F.col("n_frames") - 1
    rows = frames(spark, d).withColumn("c1", F.col("c") == 1).withColumn("arm", arm)
    rows = rows.withColumn("seen", F.when(last, F.col("frame")).otherwise(F.col("frame") - F.col("frame") % F.col("arm")))
    chunk = Window.partitionBy("arm", "episode", "seen").orderBy("frame")  # at most an arm's stride of frames
    rows = rows.withColumns({f"p{t}": F.first(t).over(chunk) for t in ("a", "b", "c1")}).withColumn("sampled", F.col("frame") == F.col("seen"))
    same = {t: F.col(t) == F.col(f"p{t}") for t in ("a", "b", "c1")}
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    spent = F.sum(F.when(F.col("sampled"), F.col("value")))
    per = rows.groupBy("arm").agg(
        F.count_if("sampled").alias("pairs"), share(same["a"] & same["b"]).alias("state_agreement"), share(same["a"] & same["b"] & same["c1"]).alias("category_agreement"),
        F.round(spent / 100, 4).alias("cost"), F.round(spent / F.sum("value"), 6).alias("cost_ratio"),
    )
    tracks = F.explode(F.array(*(F.struct(F.lit(i).alias("category"), F.col(t).alias("x"), F.col(f"p{t}").alias("y")) for i, t in enumerate(("a", "b", "c1")))))
    long = rows.select("arm", "episode", "frame", tracks.alias("t")).select("arm", "episode", "frame", "t.*")
    keys = ("arm", "category", "episode")
    left, right = (tl.to_runs(long.where(side), side, keys) for side in ("x", "y"))
    matched = matching.match_segments(left, right, 0.5, "most", keys)
    counts = [rows_.groupBy("arm").agg(F.count(F.lit(1)).alias(name)) for rows_, name in ((left, "baseline"), (right, "predicted"), (matched, "matched"))]
    for c in counts:
        per = per.join(c, "arm", "left")
    return per.fillna(0, ["matched"])


def categories_sql(track: str) -> str:
    return f"""select r.*, (select list_sort(list(distinct f.c)) from frames f where f.episode = r.episode and f.frame >= r."start" and f.frame < r."end") as cats from runs_{track} r where state"""


@query("tl19_hits_by_category", f"""with {FRAMES}{"".join(map(runs_sql, "ab"))}, x as ({categories_sql("a")}), y as ({categories_sql("b")}),
    near as (select x.episode, x."start" as xs, y."start" as ys, len(list_intersect(x.cats, y.cats)) > 0 as same from x join y on x.episode = y.episode and x."start" <= y."end" + 10 and y."start" <= x."end" + 10),
    sides as (select 'reference' as side, cats, (select bool_or(same) from near where near.episode = x.episode and xs = x."start") as same from x
        union all select 'predicted', [], (select bool_or(same) from near where near.episode = y.episode and ys = y."start") from y)
    select side, category, count(*) as segments, count(same) as hit, count(*) filter (same) as same_category from (
        select side, same, 'all' as category from sides union all select side, same, unnest(cats)::varchar from sides) group by 1, 2""")
def tl19_categories(spark, d):
    """Segments with one of the other track within ten frames, both ways and by category (the scores inside a segment)."""
    points = frames(spark, d).select("episode", "frame", "c")

    def labelled(track):
        held = tl.containing(points, positives(spark, d, track)).groupBy("episode", "start", "end")
        return held.agg(F.collect_set("c").alias("categories"))

    return ag.tolerant_hits(labelled("a"), labelled("b"), 10)


@query("prj18_cited_details", sql('''select episode, "window", "start", "end" from (
    select w.episode, w.s // 32 as "window", r."start", r."end", least(w.s + 40, n_frames) as until, greatest(w.s - 8, 0) as since from (select episode, n_frames, unnest(generate_series(0, n_frames - 1, 32)) as s from episodes) w
    join runs_a r on r.episode = w.episode and r.state and r."start" < least(w.s + 32, n_frames) and r."end" > w.s)
    where "start" >= since and "end" <= until and "start" - "start" % 5 between since and until - 1 and "end" - 1 + "start" % 3 between since and until - 1''', "a"))
def prj18_cited(spark, d):
    """Details cite a sampled frame before their start and one after their end: both have to be in the context."""
    windows = tl.core_windows(episodes(spark, d), 32, 8).drop("lab", "fps", "n_frames")
    cites = F.array(F.col("start") - F.col("start") % 5, F.col("end") - 1 + F.col("start") % 3)
    return tl.supported_details(positives(spark, d, "a").withColumn("citations", cites), windows)


@query("wn04_nearest_clean", sql('''select episode, window_start, window_start + 4 as window_end, abs(window_start + 2 - centre)::bigint as away from (
    select c.episode, centre, least(greatest(centre - 2, r."start"), r."end" - 4) as window_start from (
        select episode, ("start" + "end") // 2 as centre from runs_a where state qualify row_number() over (partition by episode order by "end" - "start", "start") = 1) c
    join runs_a r on r.episode = c.episode and not r.state and r."end" - r."start" >= 4)
    qualify row_number() over (partition by episode order by abs(window_start + 2 - centre), window_start) = 1''', "a"))
def wn04_clean(spark, d):
    """Around each episode's shortest event: the closest four frames without one."""
    own = runs(spark, d, "a")
    size = F.col("end") - F.col("start")
    shortest = own.where("state").groupBy("episode").agg(F.min(F.struct(size.alias("size"), "start", "end")).alias("s"))
    centres = shortest.select("episode", F.floor((F.col("s.start") + F.col("s.end")) / 2).alias("centre"))
    return tl.nearest_clean(own.where("not state"), centres, 4)


@query("wn12_coverage_faults", sql("""select episode, min(frame) as "start", max(frame) + 1 as "end", times from (
    select *, frame - row_number() over (partition by episode, times order by frame) as island from (
        select f.episode, f.frame, count(s) as times from frames f left join (select episode, unnest(range(4)) * 32 as s from episodes) w
            on w.episode = f.episode and f.frame >= w.s - case when w.s = 32 then 3 else 0 end and f.frame < w.s + 32 and not (w.episode % 3 = 0 and w.s = 64) group by 1, 2) where times <> 1)
    group by episode, times, island"""))
def wn12_faults(spark, d):
    """Frames that windows score twice (the second one starts three frames early) or not at all (a third one is missing)."""
    windows = tl.core_windows(episodes(spark, d), 32, 0).where("not (episode % 3 = 0 and window = 2)")
    early = F.when(F.col("window") == 1, 3).otherwise(0)
    scored = windows.select("episode", (F.col("core_start") - early).alias("start"), F.col("core_end").alias("end"))
    return tl.coverage_faults(scored, episodes(spark, d))


@query("sl09_capped_and_pooled", sql("""select episode, array_to_string(list_sort(list_distinct(list_append(range(0, n_frames, stride), n_frames - 1))), ',') as capped,
    array_to_string(case when k = 1 then pool[1:1] else list_transform(range(k), lambda i: pool[((i * (len(pool) - 1) * 2 + (k - 1)) // (2 * (k - 1)))::bigint + 1]) end, ',') as pooled
    from (select *, greatest(1, ceil(fps / 2), ceil((n_frames - 1) / 11))::bigint as stride, range(0, n_frames, 2) as pool, least(len(range(0, n_frames, 2)), len(range(0, n_frames, 8)) + 5)::bigint as k from episodes)"""))
def sl09_capped(spark, d):
    """Two frames a second, at most twelve; and a budget drawn evenly from every second frame."""
    n, long = F.col("n_frames"), lambda x: F.lit(x).cast("long")
    pool = F.sequence(long(0), n - 1, long(2))
    budget = F.size(F.sequence(long(0), n - 1, long(8))) + 5
    listed = lambda c: F.concat_ws(",", c.cast("array<string>"))
    return episodes(spark, d).select("episode", listed(F.array_sort(sp.capped_frames(n, F.col("fps"), 2.0, 12))).alias("capped"), listed(sp.evenly_from(pool, budget)).alias("pooled"))


@query("jn02_zipped_turns", """with t as (select conv_id, role, turn, row_number() over (partition by conv_id, role order by turn) - 1 as position from conversations)
    select conv_id, position, x.turn as asked, y.turn as answered, case when y.turn is null then 'left_longer' when x.turn is null then 'right_longer' end as problem
    from (select * from t where role = 'user') x full outer join (select * from t where role = 'assistant') y using (conv_id, position)""")
def jn02_zipped(spark, d):
    """The n-th turn of either role; what one role has more of is told."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    pairs = va.zipped(turns.where("role = 'user'"), turns.where("role = 'assistant'"), ["conv_id"], "turn")
    return pairs.select("conv_id", "position", F.col("left.turn").alias("asked"), F.col("right.turn").alias("answered"), "problem")


@query("fn_sheet_layout", """with sized as (select conv_id, turn, coalesce(length(text), 0) % 50 + 1 as w, (turn * 7 + conv_id) % 40 + 1 as h from conversations),
    p as (select conv_id, w, h, row_number() over (partition by conv_id order by turn, w, h) - 1 as i, count(*) over (partition by conv_id) as n from sized),
    options as (select conv_id, i, w, h, unnest(range((2 ** (n - 1))::bigint)) as breaks from p),
    columns_ as (select conv_id, breaks, bit_count(breaks & ((1::bigint << i) - 1)) as col, max(w) as w, sum(h) as h from options group by 1, 2, 3)
    select conv_id, area, width, height, breaks from (select *, width * height as area from (select conv_id, breaks, sum(w)::bigint as width, max(h)::bigint as height from columns_ group by 1, 2))
    qualify row_number() over (partition by conv_id order by area, width, height, breaks) = 1""")
def sheet_layout(spark, d):
    """The turns of a conversation as panels, in columns of the smallest area."""
    width = F.coalesce(F.length("text"), F.lit(0)) % 50 + 1
    panel = F.struct("turn", width.cast("long").alias("width"), ((F.col("turn") * 7 + F.col("conv_id")) % 40 + 1).alias("height"))
    sheets = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(panel)).alias("panels"))
    return sheets.select("conv_id", layout.sheet_layout(F.col("panels")).alias("b")).select("conv_id", "b.area", "b.width", "b.height", "b.breaks")


@query("fn_merged_counters", """select user_id, event_type, count(*) as n from events group by 1, 2""")
def merged_counters(spark, d):
    """Counters of even and odd events by user, merged."""
    counts = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("half"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id", "half").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counter"))
    halves = [maps.where(F.col("half") == h).select("user_id", F.col("counter").alias(f"c{h}")) for h in (0, 1)]
    both = halves[0].join(halves[1], "user_id", "full_outer")
    return both.select("user_id", F.explode(layout.merged_counts(F.col("c0"), F.col("c1"))).alias("event_type", "n"))


PIECES = ["..", "a", ".", "b", "..", ""]


@query("fn_contained_paths", f"""with paths as (select doc_id, array_to_string([p[doc_id % 6 + 1], p[doc_id // 6 % 6 + 1], p[doc_id // 36 % 6 + 1]], '/') as path from documents, (select {PIECES} as p)),
    steps as (select doc_id, path, unnest(range(len(string_split(path, '/')))) as i, unnest(string_split(path, '/')) as s from paths),
    walked as (select doc_id, path, sum(case when s in ('', '.') then 0 when s = '..' then -1 else 1 end) over (partition by doc_id order by i) as depth from steps)
    select doc_id, path, min(depth) >= 0 and left(path, 1) <> '/' as inside from walked group by 1, 2""")
def contained_paths(spark, d):
    pieces, doc = F.array(*map(F.lit, PIECES)), F.col("doc_id")
    piece = lambda n: F.get(pieces, (F.floor(doc / n) % 6).cast("int"))
    paths = table(spark, d, "documents").select("doc_id", F.concat_ws("/", piece(1), piece(6), piece(36)).alias("path"))
    return paths.withColumn("inside", layout.inside_root(F.col("path")))
