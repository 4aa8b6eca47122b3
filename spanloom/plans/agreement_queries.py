"""Agreement, aggregation and statistics queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import matching, stats
from ..operators import timeline as tl
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


CELLS = """count(*) filter (p and a) as tp, count(*) filter (p and not a) as fp, count(*) filter (not p and a) as fn,
    count(*) filter (not p and not a) as tn, count(*) filter (p is null and a) as unknown_pos, count(*) filter (p is null and not a) as unknown_neg"""


@query("ag01_cells_with_unknowns", sql(f"select episode, lab, {CELLS} from frames group by episode, lab"))
def ag01(spark, d):
    return ag.cells(frames(spark, d), "p", "a", ["episode", "lab"])


@query("ag02_unknown_aware_ratios", sql(f"""select lab, round((tp + fp + fn + tn) / n, 6) as coverage, round((tp + tn) / n, 6) as agreement,
    round(tp / nullif(tp + fp, 0), 6) as "precision", round(tp / nullif(tp + fn + unknown_pos, 0), 6) as recall,
    round(2 * tp / nullif(2 * tp + fp + fn + unknown_pos, 0), 6) as f1, round(tp / nullif(tp + fp + fn + unknown_pos, 0), 6) as iou,
    round(tn / nullif(tn + fp + unknown_neg, 0), 6) as specificity
    from (select lab, {CELLS}, count(*)::double as n from frames group by lab)"""))
def ag02(spark, d):
    out = ag.unknown_aware(ag.cells(frames(spark, d), "p", "a", ["lab"]))
    names = ["coverage", "agreement", "precision", "recall", "f1", "iou", "specificity"]
    return rounded(out, *names).select("lab", *names)


SUITE = """round((tp + tn) / n, 6) as agreement, round(2 * tp / (2 * tp + fp + fn), 6) as f1,
    round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) as macro_f1, round(tp / (tp + fp + fn), 6) as iou,
    round((tp / (tp + fp + fn) + tn / (tn + fp + fn)) / 2, 6) as mean_iou,
    round(((tp + tn) / n - e) / (1 - e), 6) as kappa,
    round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc,
    round(tp / (tp + fp), 6) as "precision", round(tp / (tp + fn), 6) as recall, round(tn / (tn + fp), 6) as specificity,
    round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy,
    round(((tp + tn) / n - 2 * q * (1 - q)) / (1 - 2 * q * (1 - q)), 6) as ac1, round((tp + fn) / n, 6) as prevalence"""
SUITE_NAMES = [
    "agreement", "f1", "macro_f1", "iou", "mean_iou", "kappa", "mcc", "precision", "recall", "specificity",
    "balanced_accuracy", "ac1", "prevalence",
]
SUITE_SQL = f"""select weighting, {SUITE} from (
    select *, tp + fp + fn + tn as n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) as e,
        (2 * tp + fp + fn) / (2 * (tp + fp + fn + tn)) as q from (
        select weighting, sum(case when b and a then w else 0 end)::double as tp, sum(case when b and not a then w else 0 end)::double as fp,
            sum(case when not b and a then w else 0 end)::double as fn, sum(case when not b and not a then w else 0 end)::double as tn
        from (select 'frames' as weighting, a, b, 1.0::double as w from frames union all select 'seconds', a, b, 1 / fps from frames
            union all select 'episodes', a, b, 1.0::double / n_frames from frames) group by weighting))"""


@query("pairwise_agreement", sql(SUITE_SQL))
def pairwise(spark, d):
    out = ag.suite(ag.weightings(frames(spark, d), "b", "a"))
    return rounded(out, *SUITE_NAMES).select("weighting", *SUITE_NAMES)


@query("ag05_multi_label_agreement", """select round(avg(case when u > 0 then i / u end), 6) as jaccard, round(avg(case when i = u then 1.0 else 0.0 end), 6) as exact,
    round(2 * sum(i) / (sum(i) + sum(u)), 6) as micro_dice from (
    select o_orderkey, len(list_intersect(x, y))::double as i, len(list_distinct(list_concat(x, y)))::double as u from (
        select l_orderkey as o_orderkey, coalesce(list(distinct l_returnflag) filter (l_linenumber % 2 = 0), []) as x, coalesce(list(distinct l_returnflag) filter (l_linenumber % 2 = 1), []) as y
        from lineitem group by l_orderkey))""")
def ag05(spark, d):
    odd, flag = F.col("l_linenumber") % 2 == 1, F.col("l_returnflag")
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(~odd, flag)).alias("x"), F.collect_set(F.when(odd, flag)).alias("y")
    )
    both, either = F.size(F.array_intersect("x", "y")).cast("double"), F.size(F.array_union("x", "y")).cast("double")
    sizes = sets.select(both.alias("i"), either.alias("u"))
    return sizes.agg(
        F.round(F.avg(F.when(F.col("u") > 0, F.col("i") / F.col("u"))), 6).alias("jaccard"),
        F.round(F.avg((F.col("i") == F.col("u")).cast("double")), 6).alias("exact"),
        F.round(2 * F.sum("i") / (F.sum("i") + F.sum("u")), 6).alias("micro_dice"),
    )


@query("ag06_confusion_with_missing", sql("""select c as ref, count(*) filter (p) as pred_true, count(*) filter (not p) as pred_false, count(*) filter (p is null) as pred_missing from frames group by c"""))
def ag06(spark, d):
    rows = frames(spark, d).select(F.col("c").alias("ref"), F.col("p").cast("string").alias("pred"))
    return ag.confusion(rows, "ref", "pred", ["true", "false"])


@query("ag07_vote_patterns", sql("select a::int * 4 + b::int * 2 + (c = 1)::int as pattern, count(*) as n from frames group by 1"))
def ag07(spark, d):
    rows = frames(spark, d).withColumn("c1", F.col("c") == 1)
    return ag.vote_patterns(rows, ["a", "b", "c1"]).select("pattern", "n")


@query("ag07_fleiss_kappa", sql("""select frames, round(unan / frames, 6) as unanimity, round(alls / anys, 6) as jaccard, round((agr / (frames * 6.0) - e) / (1 - e), 6) as fleiss_kappa from (
    select *, (yes / (frames * 3.0)) ** 2 + (1 - yes / (frames * 3.0)) ** 2 as e from (
    select count(*) as frames, sum(v)::double as yes, sum(v * (v - 1) + (3 - v) * (2 - v))::double as agr, count(*) filter (v in (0, 3))::double as unan,
        count(*) filter (v = 3)::double as alls, count(*) filter (v > 0)::double as anys
    from (select a::int + b::int + (c = 1)::int as v from frames)))"""))
def fleiss(spark, d):
    rows = frames(spark, d).withColumn("c1", F.col("c") == 1)
    out = ag.fleiss_kappa(ag.vote_patterns(rows, ["a", "b", "c1"]), 3)
    return rounded(out, "unanimity", "jaccard", "fleiss_kappa")


def program_sql(left: str, right: str, candidate: str, gain: str, tracks: str = "ab") -> str:
    """Best value of an ordered matching for each key k, by a row-wise dynamic program.

    left, right: selects of (k, i, s, e) with i from 1 in order; candidate, gain: expressions of
    a pair (x, y) with its iou.
    """
    return f"""with recursive {FRAMES}{''.join(map(runs_sql, tracks))}, l as ({left}), r as ({right}), w as (
        select * from (select x.k, x.i, y.i as j, x.s as xs, y.s as ys,
            greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s))::double as iou
        from l x join r y on x.k = y.k) where {candidate}
    ), sizes as (select k, max(i) as n from l group by k), dp(k, i, j, v) as (
        select k, 0::bigint, i, 0::double from r
        union all
        select k, i + 1, j, max(c) over (partition by k order by j rows unbounded preceding) from (
            select d.k, d.i, d.j, greatest(d.v, coalesce(lag(d.v, 1, 0::double) over (partition by d.k order by d.j) + w.gain, 0)) as c
            from dp d join sizes on sizes.k = d.k and d.i < sizes.n
            left join (select k, i, j, {gain} as gain from w) w on w.k = d.k and w.i = d.i + 1 and w.j = d.j)
    ), optimum as (select k, max(v) as v from dp group by k)"""


def segments_of(track: str) -> str:
    return f"""select episode as k, row_number() over (partition by episode order by "start") as i, "start" as s, "end" as e from runs_{track} where not state"""


def quiet(spark, d, track):
    """Stretches in which a track is off: long enough for several of one to meet several of another."""
    return runs(spark, d, track).where("not state")


def events_sql(least: float, gain: str) -> str:
    return program_sql(segments_of("a"), segments_of("b"), f"iou >= {least} and iou > 0", gain)


#: Value of a pair: 1,000 for the pair and its IoU, so that pairs count first.
COUNT_FIRST = "1000 + iou"
LEAST = 0.1


def event_pairs(spark, d, method, least=LEAST):
    return matching.match_segments(quiet(spark, d, "a"), quiet(spark, d, "b"), least, method)


def per_episode(pairs):
    return pairs.groupBy("episode").agg(F.count(F.lit(1)).alias("matched"), F.round(F.sum("iou"), 6).alias("total"))


ORDERED = events_sql(LEAST, COUNT_FIRST) + """ select k as episode, floor(v / 1000)::bigint as matched, round(v - 1000 * floor(v / 1000), 6) as total from optimum where v > 0"""


@query("tl12_ordered_event_matches", ORDERED)
def tl12(spark, d):
    return per_episode(event_pairs(spark, d, "ordered"))


@query("tl13_total_matching", events_sql(LEAST, "iou") + " select k as episode, round(v, 6) as total from optimum where v > 0")
def tl13(spark, d):
    return per_episode(event_pairs(spark, d, "alignment")).select("episode", "total")


@query("tl14_total_then_count", events_sql(LEAST, "round(iou * 1000000) * 1000 + 1") + " select k as episode, (v % 1000)::bigint as matched, floor(v / 1000) / 1000000 as total from optimum where v > 0")
def tl14(spark, d):
    """The largest total IoU (in millionths) first, then the most pairs: three weak pairs may give
    way to one good one."""
    pairs = tl.overlaps(quiet(spark, d, "a"), quiet(spark, d, "b")).where(F.col("iou") >= LEAST).withColumn("millionths", F.round(F.col("iou") * 1000000))
    found = matching.settled_segments(pairs, "millionths", "alignment", ["episode"]).groupBy("episode")
    return found.agg(F.count(F.lit(1)).alias("matched"), (F.sum("millionths") / 1000000).alias("total"))


#: A set of pairs for each set of left elements that are used, by the right elements in order: all assignments, crossing ones too.
ASSIGNMENTS = f"""with recursive {FRAMES}{"".join(map(runs_sql, "ab"))}, l as ({segments_of("a")}), r as ({segments_of("b")}), w as (
        select * from (select x.k, x.i, y.i as j, greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s))::double as iou
        from l x join r y on x.k = y.k) where iou >= {LEAST}
    ), rights as (select k, j, row_number() over (partition by k order by j) as n from (select distinct k, j from w)), sets(k, n, used, v) as (
        select distinct k, 0::bigint, []::bigint[], 0::double from w
        union all
        select k, n, used, max(v) over (partition by k, n, used) from (
            select k, n, used, v, row_number() over (partition by k, n, used order by v desc) as q from (
                select s.k, s.n + 1 as n, list_sort(list_append(s.used, w.i)) as used, s.v + 1000 + w.iou as v
                from sets s join rights t on t.k = s.k and t.n = s.n + 1 join w on w.k = s.k and w.j = t.j where not list_contains(s.used, w.i)
                union all select s.k, s.n + 1, s.used, s.v from sets s join rights t on t.k = s.k and t.n = s.n + 1)) where q = 1
    ) select k as episode, floor(max(v) / 1000)::bigint as matched, round(max(v) - 1000 * floor(max(v) / 1000), 6) as total from sets group by k"""


@query("tl15_assignment", ASSIGNMENTS)
def tl15(spark, d):
    """Most pairs, then the largest total, over all assignments.  Segments of a track don't overlap, so two pairs
    that overlap can't cross, and the ordered program finds the best assignment; its SQL tries all."""
    return per_episode(event_pairs(spark, d, "ordered"))


@query("tl16_most_matches", events_sql(LEAST, COUNT_FIRST) + " select k as episode, floor(v / 1000)::bigint as matched from optimum where v > 0")
def tl16(spark, d):
    return per_episode(event_pairs(spark, d, "most")).select("episode", "matched")


#: Pairs by descending IoU, each side once, with the larger starts first of equal ones.
GREEDY = program_sql(segments_of("a"), segments_of("b"), "iou >= 0.1 and iou > 0", "iou") + """, ranked as (
        select *, row_number() over (partition by k order by iou desc, i desc, j desc) as n from w
    ), taken(k, n, ls, rs, pairs) as (
        select k, 0::bigint, []::bigint[], []::bigint[], []::bigint[] from sizes
        union all
        select t.k, t.n + 1, case when free then list_append(ls, i) else ls end, case when free then list_append(rs, j) else rs end,
            case when free then list_append(pairs, t.n + 1) else pairs end
        from (select t.*, q.i, q.j, not list_contains(ls, q.i) and not list_contains(rs, q.j) as free from taken t join ranked q on q.k = t.k and q.n = t.n + 1) t
    ), chosen as (
        select r.* from ranked r join (select k, unnest(arg_max(pairs, n)) as n from taken group by k) t on t.k = r.k and t.n = r.n
    )"""


@query("tl17_greedy_iou", GREEDY + """ select k as episode, xs as left_start, ys as right_start, round(iou, 6) as iou from chosen where iou >= 0.3""")
def tl17(spark, d):
    pairs = event_pairs(spark, d, "greedy", 0.3)
    return pairs.select("episode", "left_start", "right_start", F.round("iou", 6).alias("iou"))


def pairs_sql(left: str, right: str, levels: str, candidate: str, gain: str, tracks: str = "ab", more: str = "") -> str:
    """The pairs (k, i, j, level) of a best ordered matching for each key k and level, with their lists carried along.

    left, right: selects of (k, i, s, e) with i from 1 in order; candidate, gain: expressions of a pair
    (xs, ys, i, j, iou, level).
    """
    return f"""with recursive {FRAMES}{''.join(map(runs_sql, tracks))}{more}, l as ({left}), r as ({right}), levels(level) as (values {levels}), w as (
        select *, {gain} as gain from (select x.k, level, x.i, y.i as j, x.s as xs, y.s as ys,
            greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s))::double as iou
        from l x join r y on x.k = y.k cross join levels) where {candidate}
    ), sizes as (select k, max(i) as n from l group by k), ends as (select k, max(i) as m from r group by k), dp(k, level, i, j, v, pairs) as (
        select k, level, 0::bigint, i, 0::double, []::bigint[] from r cross join levels
        union all
        select k, level, i + 1, j, max(c) over u, arg_max(cp, c) over u from (
            select k, level, i, j, greatest(v, with_) as c, case when with_ > v then list_append(old, (i + 1) * 10000 + j) else pairs end as cp from (
                select d.*, lag(d.v, 1, 0::double) over o + w.gain as with_, lag(d.pairs, 1, []::bigint[]) over o as old
                from dp d join sizes on sizes.k = d.k and d.i < sizes.n
                left join w on w.k = d.k and w.level = d.level and w.i = d.i + 1 and w.j = d.j window o as (partition by d.k, d.level order by d.j)))
        window u as (partition by k, level order by j rows unbounded preceding)
    ), chosen as (
        select k, level, p // 10000 as i, p % 10000 as j from (select dp.k, level, unnest(pairs) as p from dp join sizes on sizes.k = dp.k and n = i join ends on ends.k = dp.k and m = j)
    ), pairs as (select c.k, c.level, l.s as ls, l.e as le, r.s as rs, r.e as re from chosen c join l on l.k = c.k and l.i = c.i join r on r.k = c.k and r.i = c.j)"""


LEVELS = (0.1, 0.3, 0.5)


@query("ag09_event_metrics", pairs_sql(segments_of("a"), segments_of("b"), "(0.1::double), (0.3), (0.5)", "iou >= level", "1000 + iou - 1e-6 * abs(xs - ys) - 1e-9 * ys") + """,
    off as (select level, (rs - ls) / fps as onset, (re - le) / fps as offset_ from pairs join episodes on episode = k),
    best as (select x.k, 'a' as track, any_value(x.e - x.s) as n, max(coalesce(greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s))::double, 0)) as iou
        from l x left join r y on x.k = y.k group by x.k, x.i
        union all select x.k, 'b', any_value(x.e - x.s), max(coalesce(greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s))::double, 0))
        from r x left join l y on x.k = y.k group by x.k, x.i),
    cover as (select count(*) filter (track = 'a') as na, count(*) filter (track = 'b') as nb, avg(iou) filter (track = 'a') as ca, avg(iou) filter (track = 'b') as cb,
        sum(iou * n / fps) filter (track = 'a') / sum(n / fps) filter (track = 'a') as wa, sum(iou * n / fps) filter (track = 'b') / sum(n / fps) filter (track = 'b') as wb
        from best join episodes on episode = k)
    select o.level as least, count(*) as matched, any_value(na) as left_events, any_value(nb) as right_events, round(2 * count(*) / (any_value(na) + any_value(nb))::double, 6) as f1,
        round(count(*) / any_value(nb)::double, 6) as "precision", round(count(*) / any_value(na)::double, 6) as recall,
        round(avg((abs(onset) + abs(offset_)) / 2), 6) as mae, any_value(med) as median_error, round(avg(onset), 6) as onset_signed, round(avg(offset_), 6) as offset_signed,
        round(any_value(ca), 6) as left_best_iou, round(any_value(cb), 6) as right_best_iou, round(any_value(wa), 6) as left_best_iou_by_time, round(any_value(wb), 6) as right_best_iou_by_time
    from off o cross join cover join (select level, round(quantile_cont(x, 0.5), 6) as med from (
        select level, unnest([abs(onset), abs(offset_)]) as x from off) group by level) m on m.level = o.level group by o.level""")
def ag09(spark, d):
    """Matched anew at each threshold: most pairs, then the largest IoU (of equal ones the closer and the earlier onset).

    Precision and recall are of track b against track a; errors are b less a, in seconds; the best IoU of each
    segment, matched or not, is averaged over segments and over their time.
    """
    a, b, eps = quiet(spark, d, "a"), quiet(spark, d, "b"), episodes(spark, d).select("episode", "fps")
    every = tl.overlaps(a, b)
    levels = F.explode(F.array(*map(F.lit, LEVELS))).alias("least")
    hair = F.abs(F.col("left_start") - F.col("right_start")) * 1e-6 + F.col("right_start") * 1e-9
    pairs = matching.settled_segments(every.select("*", levels).where("iou >= least"), F.col("iou") - hair, "ordered", ["episode", "least"])
    onset, offset = ((F.col(f"right_{x}") - F.col(f"left_{x}")) / F.col("fps") for x in ("start", "end"))
    off = pairs.join(eps, "episode").select("least", onset.alias("onset"), offset.alias("offset"))
    sizes = off.groupBy("least").agg(F.count(F.lit(1)).alias("matched"), F.avg("onset").alias("onset_signed"), F.avg("offset").alias("offset_signed"))
    errors = off.select("least", F.explode(F.array(F.abs("onset"), F.abs("offset"))).alias("e")).groupBy("least")
    errors = errors.agg(F.avg("e").alias("mae"), F.percentile("e", F.lit(0.5)).alias("median_error"))  # few distinct errors: whole frames
    cover = None
    for side, track in (("left", a), ("right", b)):
        found = every.groupBy("episode", F.col(f"{side}_start").alias("start")).agg(F.max("iou").alias("iou"))
        rows = track.join(found, ["episode", "start"], "left").join(eps, "episode").na.fill(0.0, ["iou"])
        seconds = (F.col("end") - F.col("start")) / F.col("fps")
        one = rows.agg(F.count(F.lit(1)).alias(f"{side}_events"), F.avg("iou").alias(f"{side}_best_iou"), (F.sum(F.col("iou") * seconds) / F.sum(seconds)).alias(f"{side}_best_iou_by_time"))
        cover = one if cover is None else cover.crossJoin(one)  # single rows
    found = sizes.join(errors, "least").crossJoin(F.broadcast(cover))  # one row
    n, left, right = F.col("matched"), F.col("left_events"), F.col("right_events")
    found = found.withColumns({"f1": ag.ratio(2 * n, left + right), "precision": ag.ratio(n, right), "recall": ag.ratio(n, left)})
    return rounded(found, *(c for c in found.columns if c not in ("least", "matched", "left_events", "right_events")))


def boundary_frames(spark, d, track):
    return tl.boundaries(frames(spark, d), track)


BOUNDARIES = """boundaries_{t} as (select episode, frame, d from (
        select episode, frame, {t}::int - lag({t}::int) over (partition by episode order by frame) as d from frames) where d <> 0)"""
BOTH = f"{BOUNDARIES.format(t='a')}, {BOUNDARIES.format(t='b')}"


@query("tl18_greedy_nearest_boundaries", f"""with recursive {FRAMES}, {BOTH}, l as (
        select episode, d, frame, row_number() over (partition by episode, d order by frame) as i from boundaries_a
    ), r as (select episode, d, list(frame) as fs from boundaries_b group by 1, 2), taken(episode, d, i, used, left_frame, right_frame) as (
        select episode, d, 0::bigint, []::bigint[], null::bigint, null::bigint from r
        union all
        select episode, d, i, case when best is null then used else list_append(used, best % 1000000) end, frame, best % 1000000 from (
            select t.episode, t.d, t.i + 1 as i, used, l.frame,
                list_min(list_transform(list_filter(fs, lambda x: abs(x - l.frame) <= 5 and not list_contains(used, x)), lambda x: abs(x - l.frame) * 1000000 + x)) as best
            from taken t join l on l.episode = t.episode and l.d = t.d and l.i = t.i + 1 join r on r.episode = t.episode and r.d = t.d))
    select episode, d as direction, left_frame, right_frame, abs(left_frame - right_frame)::double as distance from taken where right_frame is not null""")
def tl18(spark, d):
    return matching.match_points(boundary_frames(spark, d, "a"), boundary_frames(spark, d, "b"), 5, "nearest")


SECONDS = (0.1, 0.25, 0.5, 1.0)
POINTS = "select episode * 2 + (d > 0)::int as k, row_number() over (partition by episode, d order by frame) as i, frame as s, frame + 1 as e from boundaries_{t}"
#: Most boundaries of one direction within the tolerance, then the smallest total distance, then the earlier ones of b.
BOUNDARY_PAIRS = pairs_sql(
    POINTS.format(t="a"), POINTS.format(t="b"), "(0.1::double), (0.25), (0.5), (1.0)", "abs(xs - ys) <= (10 + 5 * ((k // 2) % 3)) * level + 1e-9",
    "1000000 - abs(xs - ys) - 1e-4 * j", "", f", {BOTH}",
)


def boundary_pairs(spark, d):
    """(keys, pairs, left and right boundaries) at each tolerance."""
    eps = episodes(spark, d).select("episode", "fps")
    seconds = F.explode(F.array(*map(F.lit, SECONDS))).alias("seconds")
    a, b = (boundary_frames(spark, d, t).join(eps, "episode").select("episode", "direction", "frame", "fps", seconds) for t in "ab")
    keys = ["episode", "direction", "seconds"]
    return keys, matching.match_points(a, b, F.col("seconds") * F.col("fps"), keys=keys).join(eps, "episode"), a, b


@query("ag08_ag10_boundary_f1", BOUNDARY_PAIRS + """
    select d as direction, n.level as seconds, left_n, right_n, coalesce(matched, 0) as matched, round(coalesce(matched, 0) / right_n::double, 6) as "precision",
        round(coalesce(matched, 0) / left_n::double, 6) as recall, round(2 * coalesce(matched, 0) / (left_n + right_n)::double, 6) as f1, mae, signed
    from (select level, (k % 2) * 2 - 1 as d, count(*) as left_n from l cross join levels group by 1, 2) n
    join (select level, (k % 2) * 2 - 1 as d, count(*) as right_n from r cross join levels group by 1, 2) m using (level, d)
    left join (select level, (k % 2) * 2 - 1 as d, count(*) as matched, round(avg(abs(ls - rs) / fps), 6) as mae, round(avg((rs - ls) / fps), 6) as signed
        from pairs join episodes on episode = k // 2 group by 1, 2) p using (level, d)""")
def ag08(spark, d):
    """Onsets (direction 1) and offsets (-1) matched in order within four tolerances, pooled over episodes;
    signed errors are b less a."""
    _, pairs, a, b = boundary_pairs(spark, d)
    off = (F.col("right_frame") - F.col("left_frame")) / F.col("fps")
    by = ["direction", "seconds"]
    found = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("matched"), F.avg(F.abs(off)).alias("mae"), F.avg(off).alias("signed"))
    sizes = [x.groupBy(*by).agg(F.count(F.lit(1)).alias(name)) for x, name in ((a, "left_n"), (b, "right_n"))]
    out = sizes[0].join(sizes[1], by).join(found, by, "left").na.fill(0, ["matched"])
    n = F.col("matched")
    out = out.withColumns({"precision": ag.ratio(n, F.col("right_n")), "recall": ag.ratio(n, F.col("left_n")), "f1": ag.ratio(2 * n, F.col("left_n") + F.col("right_n"))})
    return rounded(out, "precision", "recall", "f1", "mae", "signed")


@query("ag08_unmatched_boundaries", BOUNDARY_PAIRS + """
    select x.k // 2 as episode, (x.k % 2) * 2 - 1 as direction, x.level as seconds, side, x.s as frame from (
        select l.*, level, 'left' as side from l cross join levels union all select r.*, level, 'right' from r cross join levels) x
    anti join (select k, level, 'left' as side, ls as s from pairs union all select k, level, 'right', rs from pairs) p on p.k = x.k and p.level = x.level and p.side = x.side and p.s = x.s""")
def ag08_unmatched(spark, d):
    """The boundaries of either track without a partner, a row each."""
    keys, pairs, *sides = boundary_pairs(spark, d)
    rows = [
        x.select(*keys, "frame").join(pairs.select(*keys, F.col(f"{side}_frame").alias("frame")), [*keys, "frame"], "left_anti").withColumn("side", F.lit(side))
        for x, side in zip(sides, ("left", "right"), strict=True)
    ]
    return rows[0].unionByName(rows[1])


@query("ag08_exact_boundaries", sql("""select count(*) filter (da = db) as matched, count(*) filter (da <> 0) as n_left, count(*) filter (db <> 0) as n_right from (
    select episode, frame, a::int - lag(a::int) over w as da, b::int - lag(b::int) over w as db from frames window w as (partition by episode order by frame)) where da <> 0 or db <> 0"""))
def ag08_exact(spark, d):
    a, b = boundary_frames(spark, d, "a"), boundary_frames(spark, d, "b")
    matched = matching.match_points(a, b, 0).agg(F.count(F.lit(1)).alias("matched"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return matched.crossJoin(count(a, "n_left")).crossJoin(count(b, "n_right"))  # three single rows


@query("tl19_tolerant_hits", sql('''select x.lab, count(*) as segments, count(*) filter (exists (select 1 from runs_b y where y.episode = x.episode and y.state and y."start" <= x."end" + 9 and x."start" <= y."end" + 9)) as hit
    from (select r.*, lab from runs_a r join episodes using (episode) where state) x group by x.lab''', "a", "b"))
def tl19(spark, d):
    a = positives(spark, d, "a").join(episodes(spark, d).select("episode", "lab"), "episode")
    pairs = tl.within(a, positives(spark, d, "b"), 9)
    near = pairs.select("episode", F.col("left_start").alias("start")).distinct()
    hits = a.join(near.withColumn("near", F.lit(True)), ["episode", "start"], "left")
    return hits.groupBy("lab").agg(F.count(F.lit(1)).alias("segments"), F.count_if("near").alias("hit"))


@query("ag11_dense_step_f1", sql('''select count(*) as steps, count(*) filter (x and y) as tp, count(*) filter (x and not y) as fp, count(*) filter (not x and y) as fn from (
    select s.*, exists (select 1 from runs_a r where r.episode = s.episode and r.state and r."start" < (step + 1) * fps and r."end" > step * fps) as x,
        exists (select 1 from runs_b r where r.episode = s.episode and r.state and r."start" < (step + 1) * fps and r."end" > step * fps) as y
    from (select episode, fps, unnest(generate_series(0, cast(ceil(n_frames / fps) as bigint) - 1)) as step from episodes) s)''', "a", "b"))
def ag11(spark, d):
    eps = episodes(spark, d)
    x = tl.step_labels(positives(spark, d, "a"), eps).withColumnRenamed("positive", "x")
    y = tl.step_labels(positives(spark, d, "b"), eps).withColumnRenamed("positive", "y")
    both = x.join(y, ["episode", "step"])
    X, Y = F.col("x"), F.col("y")
    return both.agg(F.count(F.lit(1)).alias("steps"), F.count_if(X & Y).alias("tp"), F.count_if(X & ~Y).alias("fp"), F.count_if(~X & Y).alias("fn"))


@query("ag11_segment_f1_per_episode", events_sql(0.5, COUNT_FIRST) + """ select round(avg(2 * coalesce(floor(v / 1000), 0) / (coalesce(nl, 0) + coalesce(nr, 0))), 6) as segment_f1, count(*) as episodes
    from (select k, count(*) as nl from l group by k) x full join (select k, count(*) as nr from r group by k) y using (k) left join optimum using (k)""")
def ag11_segments(spark, d):
    """F1 of segments matched at 0.5, averaged over the episodes that have any."""
    sizes = [quiet(spark, d, t).groupBy("episode").agg(F.count(F.lit(1)).alias(n)) for t, n in (("a", "nl"), ("b", "nr"))]
    hits = per_episode(event_pairs(spark, d, "ordered", 0.5)).select("episode", "matched")
    each = sizes[0].join(sizes[1], "episode", "full_outer").join(hits, "episode", "left").na.fill(0)
    return each.agg(F.round(F.avg(2 * F.col("matched") / (F.col("nl") + F.col("nr"))), 6).alias("segment_f1"), F.count(F.lit(1)).alias("episodes"))


def window_segments(track: str) -> str:
    return f"""select k, row_number() over (partition by k order by s) as i, s, e from (select episode * 100000 + w as k, greatest("start", w * 32) as s, least("end", w * 32 + 32) as e
        from (select *, unnest(generate_series("start" // 32, ("end" - 1) // 32)) as w from runs_{track} where state))"""


def window_program(least: float) -> str:
    return program_sql(window_segments("a"), window_segments("b"), f"iou >= {least}", COUNT_FIRST) + f""" select {least}::double as least, sum(floor(v / 1000))::bigint as matched,
        round(2 * sum(floor(v / 1000)) / ((select count(*) from l) + (select count(*) from r)), 6) as event_f1 from optimum"""


@query("ag12_window_event_f1", " union all ".join(f"({window_program(t)})" for t in (0.3, 0.5, 0.7)))
def ag12_events(spark, d):
    """Events clipped to windows of 32 frames and matched inside them, at three thresholds."""
    eps = tl.core_windows(episodes(spark, d), 32, 0)
    a, b = (tl.clip(positives(spark, d, t), eps) for t in "ab")
    least = F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7)))).alias("least")
    pairs = tl.overlaps(a.drop("state"), b.drop("state"), ["episode", "window"]).select("*", least).where("iou >= least")
    sizes = a.agg(F.count(F.lit(1)).alias("nl")).crossJoin(b.agg(F.count(F.lit(1)).alias("nr")))  # single rows
    hits = matching.settled_segments(pairs, "iou", "ordered", ["episode", "window", "least"]).groupBy("least").agg(F.count(F.lit(1)).alias("matched"))
    out = hits.crossJoin(F.broadcast(sizes))  # one row
    return out.select("least", "matched", F.round(2 * F.col("matched") / (F.col("nl") + F.col("nr")), 6).alias("event_f1"))


@query("ag12_window_scores", sql("""select arm, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) as frame_f1, count(*) filter (fp > 0 and tp + fn = 0) as false_alarms, count(*) filter (tp + fn = 0) as clean from (
    select episode, frame // 32 as w, arm, count(*) filter (g and a)::double as tp, count(*) filter (g and not a)::double as fp, count(*) filter (not g and a)::double as fn from (
        select episode, frame, a, 'b' as arm, b as g from frames union all select episode, frame, a, 'always', true from frames union all select episode, frame, a, 'never', false from frames)
    group by all) group by arm"""))
def ag12(spark, d):
    arms = F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), c.alias("g")) for n, c in (("b", F.col("b")), ("always", F.lit(True)), ("never", F.lit(False))))))
    rows = frames(spark, d).withColumn("x", arms).select("episode", F.floor(F.col("frame") / 32).alias("w"), "a", "x.arm", "x.g")
    per = ag.cells(rows, "g", "a", ["episode", "w", "arm"])
    clean = F.col("tp") + F.col("fn") == 0
    return per.groupBy("arm").agg(
        F.round(2 * F.sum("tp") / F.sum(2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("frame_f1"),
        F.count_if(clean & (F.col("fp") > 0)).alias("false_alarms"), F.count_if(clean).alias("clean"),
    )


@query("ag13_promotion_rule", sql("""select lab, fb >= fc and ab >= ac and (fb > fc or ab > ac) as promoted from (
    select lab, avg((a = b)::int) as ab, avg((a = (c = 1))::int) as ac, count(*) filter (a and b) as fb, count(*) filter (a and c = 1) as fc from frames group by lab)"""))
def ag13(spark, d):
    c1 = F.col("c") == 1
    s = frames(spark, d).groupBy("lab").agg(
        F.avg((F.col("a") == F.col("b")).cast("int")).alias("ab"), F.avg((F.col("a") == c1).cast("int")).alias("ac"),
        F.count_if(F.col("a") & F.col("b")).alias("fb"), F.count_if(F.col("a") & c1).alias("fc"),
    )
    return s.select("lab", F.expr("fb >= fc and ab >= ac and (fb > fc or ab > ac)").alias("promoted"))


@query("ag14_macro_and_micro", sql("""select round(avg(agr), 6) as macro, round(sum(same) / sum(n), 6) as micro, round(sum(same / fps) / sum(n / fps), 6) as by_seconds from (
    select episode, fps, count(*) filter (a = b)::double as same, count(*)::double as n, count(*) filter (a = b)::double / count(*) as agr from frames group by episode, fps)"""))
def ag14(spark, d):
    e = frames(spark, d).groupBy("episode", "fps").agg(F.count_if(F.col("a") == F.col("b")).alias("same"), F.count(F.lit(1)).alias("n"))
    return e.agg(
        F.round(F.avg(F.col("same") / F.col("n")), 6).alias("macro"), F.round(F.sum("same") / F.sum("n"), 6).alias("micro"),
        F.round(F.sum(F.col("same") / F.col("fps")) / F.sum(F.col("n") / F.col("fps")), 6).alias("by_seconds"),
    )


@query("ag15_strata", sql("""select coalesce(cast(lab as varchar), 'all') as stratum, count(*) as frames, count(*) filter (a = b) as agreed from frames group by grouping sets ((), (lab))
    union all select 'long', count(*), count(*) filter (a = b) from frames where n_frames >= 70
    union all select 'with_positive', count(*), count(*) filter (a = b) from frames where episode in (select episode from frames where b)"""))
def ag15(spark, d):
    rows = frames(spark, d).withColumn("any_b", F.max("b").over(Window.partitionBy("episode")))
    strata = F.array_compact(
        F.array(
            F.lit("all"), F.col("lab").cast("string"), F.when(F.col("n_frames") >= 70, F.lit("long")), F.when(F.col("any_b"), F.lit("with_positive")),
        )
    )
    per = rows.groupBy("episode", strata.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    return per.withColumn("stratum", F.explode("s")).groupBy("stratum").agg(F.sum("n").alias("frames"), F.sum("same").alias("agreed"))


@query("ag16_category_f1", sql("""select event_type as category, count(*) filter (b and c = 1) as tp, count(*) filter (b and c <> 1) as fp, count(*) filter (not b and c = 1) as fn,
    round(2 * count(*) filter (b and c = 1) / nullif(2 * count(*) filter (b and c = 1) + count(*) filter (b and c <> 1) + count(*) filter (not b and c = 1), 0)::double, 6) as f1 from frames group by event_type"""))
def ag16(spark, d):
    rows = frames(spark, d).withColumn("c1", F.col("c") == 1)
    per = ag.cells(rows, "b", "c1", ["event_type"])
    f1 = F.round(ag.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)
    return per.select(F.col("event_type").alias("category"), "tp", "fp", "fn", f1.alias("f1"))


@query("ag17_mean_of_defined", sql(f"""select lab, round(avg(f1), 6) as mean_f1, count(f1) as n_f1 from (
    select episode, lab, 2 * tp / nullif(2 * tp + fp + fn + unknown_pos, 0)::double as f1 from (select episode, lab, {CELLS} from frames group by episode, lab)) group by lab"""))
def ag17(spark, d):
    per = ag.unknown_aware(ag.cells(frames(spark, d), "p", "a", ["episode", "lab"]))
    return rounded(ag.defined_mean(per, ["f1"], ["lab"]), "mean_f1")


@query("ag18_time_weighted_similarity", sql('''select episode, round(sum(ov * sim) / sum(ov), 4) as similarity, sum(ov)::bigint as covered,
        round(sum(ov * sim) filter (same) / sum(ov) filter (same), 4) as same_state_similarity from (
    select x.episode, x.state = y.state as same, least(x."end", y."end") - greatest(x."start", y."start") as ov,
        list_dot_product(u.e, v.e) / (sqrt(list_dot_product(u.e, u.e)) * sqrt(list_dot_product(v.e, v.e))) as sim
    from runs_a x join runs_b y on x.episode = y.episode and x."start" < y."end" and y."start" < x."end"
    join (select vec_id, list_transform(embedding, lambda z: z::double) as e from embeddings) u on u.vec_id = (x.episode + x."start") % (select count(*) from embeddings)
    join (select vec_id, list_transform(embedding, lambda z: z::double) as e from embeddings) v on v.vec_id = (y.episode + 2 * y."start") % (select count(*) from embeddings)) group by episode''', "a", "b"))
def ag18(spark, d):
    """Cosine of the vectors of overlapping segments, weighted by their common frames; a segment's
    vector is found by its place."""
    from ..functions import text as tx

    e = table(spark, d, "embeddings")
    n = e.count()
    pairs = tl.overlaps(runs(spark, d, "a"), runs(spark, d, "b")).withColumns(
        {"u": (F.col("episode") + F.col("left_start")) % n, "v": (F.col("episode") + 2 * F.col("right_start")) % n}
    )
    for side in ("u", "v"):
        pairs = pairs.join(e.select(F.col("vec_id").alias(side), F.col("embedding").alias(f"{side}_vector")), side)
    pairs = pairs.withColumn("weighted", F.col("overlap") * tx.cosine(F.col("u_vector"), F.col("v_vector")))
    same = lambda c: F.sum(F.when(F.col("left_state") == F.col("right_state"), F.col(c)))
    return pairs.groupBy("episode").agg(
        F.round(F.sum("weighted") / F.sum("overlap"), 4).alias("similarity"), F.sum("overlap").alias("covered"),
        F.round(same("weighted") / same("overlap"), 4).alias("same_state_similarity"),
    )


@query("ag19_bootstrap_interval", sql("""select count(*) as rounds, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.975), 6) as high from (
    select r, sum(same)::double / sum(n) as v from (
        select r, ('0x' || substr(md5('s|' || r || '|' || slot), 1, 12))::bigint % (select count(*) from episodes) as pick from range(200) t(r), (select row_number() over (order by episode) - 1 as slot from episodes) u) draws
    join (select row_number() over (order by episode) - 1 as slot, count(*) filter (a = b) as same, count(*) as n from frames group by episode) e on e.slot = pick group by r)"""))
def ag19(spark, d):
    each = frames(spark, d).groupBy("episode").agg(F.count_if(F.col("a") == F.col("b")).alias("same"), F.count(F.lit(1)).alias("n"))
    draws = stats.bootstrap_draws(each.select("episode"), "episode", 200, "s")
    return rounded(stats.bootstrap_interval(draws, each, "episode", "same", "n"), "low", "median", "high")


@query("ag20_win_tie_loss", sql("""select count(*) filter (x > y) as wins, count(*) filter (x = y) as ties, count(*) filter (x < y) as losses from (
    select episode, count(*) filter (a = b) as x, count(*) filter (a = (c = 1)) as y from frames group by episode)"""))
def ag20(spark, d):
    per = frames(spark, d).groupBy("episode").agg(
        F.count_if(F.col("a") == F.col("b")).alias("x"), F.count_if(F.col("a") == (F.col("c") == 1)).alias("y")
    )
    return per.agg(F.count_if(F.expr("x > y")).alias("wins"), F.count_if(F.expr("x = y")).alias("ties"), F.count_if(F.expr("x < y")).alias("losses"))


@query("ag21_jn16_shift_null", sql("""select s.episode, observed, round(na * nb / n_frames::double, 6) as null_mean,
    round(case when observed = 0 then 1 else coalesce(reached, 0) / n_frames::double end, 6) as share from (
    select episode, n_frames, count(*) filter (a) as na, count(*) filter (b) as nb, count(*) filter (a and b) as observed from frames group by 1, 2) s
    left join (select x.episode, count(*) filter (ov >= obs) as reached from (
        select x.episode, (x.frame - y.frame + x.n_frames) % x.n_frames as k, count(*) as ov from frames x join frames y on x.episode = y.episode and x.a and y.b group by 1, 2) x
        join (select episode, count(*) filter (a and b) as obs from frames group by 1) o on o.episode = x.episode group by 1) r on r.episode = s.episode"""))
def ag21(spark, d):
    return rounded(stats.shift_null(frames(spark, d), "a", "b"), "null_mean", "share")


@query("ag21_shift_null_bands", sql("""select e.episode, exclusion, count(*) as shifts, round(any_value(2 * obs / den), 6) as raw, round(avg(2 * coalesce(ov, 0) / den), 6) as null_mean,
    round(stddev_pop(2 * coalesce(ov, 0) / den), 6) as null_sd, round((count(*) filter (coalesce(ov, 0) < obs) + 0.5 * count(*) filter (coalesce(ov, 0) = obs)) / count(*)::double, 6) as percentile,
    round(any_value(2 * obs / den) - avg(2 * coalesce(ov, 0) / den), 6) as excess,
    round(case when stddev_pop(2 * coalesce(ov, 0) / den) >= 1e-8 then (any_value(2 * obs / den) - avg(2 * coalesce(ov, 0) / den)) / stddev_pop(2 * coalesce(ov, 0) / den) end, 6) as z,
    round(case when 1 - avg(2 * coalesce(ov, 0) / den) > 1e-10 then (any_value(2 * obs / den) - avg(2 * coalesce(ov, 0) / den)) / (1 - avg(2 * coalesce(ov, 0) / den)) end, 6) as anchor,
    round(quantile_cont(2 * coalesce(ov, 0) / den, 0.05), 6) as null_q05, round(quantile_cont(2 * coalesce(ov, 0) / den, 0.5), 6) as null_q50, round(quantile_cont(2 * coalesce(ov, 0) / den, 0.95), 6) as null_q95
    from (select episode, n_frames, (count(*) filter (a) + count(*) filter (b))::double as den, count(*) filter (a and b) as obs from frames group by 1, 2) e
    cross join (values (0::double), (0.05::double), (0.1::double), (0.25::double)) bands(exclusion), lateral (select unnest(range(n_frames)) as k) shifts
    left join (select x.episode, (x.frame - y.frame + x.n_frames) % x.n_frames as k, count(*) as ov from frames x join frames y on x.episode = y.episode and x.a and y.b group by 1, 2) o
        on o.episode = e.episode and o.k = shifts.k
    where den > 0 and shifts.k between ceil(exclusion * n_frames) and floor((1 - exclusion) * n_frames) group by e.episode, exclusion"""))
def ag21_bands(spark, d):
    found = stats.shift_null_bands(frames(spark, d), "a", "b", [0.0, 0.05, 0.1, 0.25])
    return rounded(found, "raw", "null_mean", "null_sd", "percentile", "excess", "z", "anchor", "null_q05", "null_q50", "null_q95")


@query("ag22_auroc", """select round((sum(case when toxic = 1 then r else 0 end) - np * (np + 1) / 2) / (np * nn), 6) as auroc, np::bigint as positives, nn::bigint as negatives from (
    select toxic, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as r, sum(toxic) over () as np, sum(1 - toxic) over () as nn
    from labels join documents using (doc_id)) group by np, nn""")
def ag22(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(stats.auroc(rows, "n_chars", F.col("toxic") == 1), "auroc")


@query("ag23_best_threshold", """select threshold, round(f1, 6) as f1 from (
    select t.n_chars as threshold, 2 * count(*) filter (d.n_chars >= t.n_chars and toxic = 1) / (count(*) filter (d.n_chars >= t.n_chars) + count(*) filter (toxic = 1))::double as f1
    from (select distinct n_chars from documents join labels using (doc_id)) t, (select n_chars, toxic from documents join labels using (doc_id)) d group by t.n_chars)
    order by f1 desc, threshold limit 1""")
def ag23(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(stats.best_threshold(rows, "n_chars", F.col("toxic") == 1), "f1")


@query("ag24_leave_one_out", sql("""select lab, round((t - own) / (tn - n)::double, 6) as without from (
    select lab, sum(own) over () as t, sum(n) over () as tn, own, n from (select lab, count(*) filter (a = b) as own, count(*) as n from frames group by lab))"""))
def ag24(spark, d):
    per = frames(spark, d).groupBy("lab").agg(F.count_if(F.col("a") == F.col("b")).alias("own"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    rest = (F.sum("own").over(every) - F.col("own")) / (F.sum("n").over(every) - F.col("n"))
    return per.select("lab", F.round(rest, 6).alias("without"))


@query("ag25_weight_sweep", sql("""select w1, w2, best, count(*) as n from (
    select w1, w2, arm_max as best from (
        select w1, w2, lab, case when w1 * ab + w2 * fb + (10 - w1 - w2) * rb >= w1 * ac + w2 * fc + (10 - w1 - w2) * rc then 'b' else 'c' end as arm_max from (
            select i as w1, j as w2 from range(11) x(i), range(11) y(j) where i + j <= 10) g,
            (select lab, count(*) filter (a = b) as ab, count(*) filter (a and b) as fb, count(*) filter (not a and not b) as rb,
                count(*) filter (a = (c = 1)) as ac, count(*) filter (a and c = 1) as fc, count(*) filter (not a and c <> 1) as rc from frames group by lab)))
    group by all"""))
def ag25(spark, d):
    a, b, c = F.col("a"), F.col("b"), F.col("c") == 1
    labs = frames(spark, d).groupBy("lab").agg(
        F.count_if(a == b).alias("ab"), F.count_if(a & b).alias("fb"), F.count_if(~a & ~b).alias("rb"),
        F.count_if(a == c).alias("ac"), F.count_if(a & c).alias("fc"), F.count_if(~a & ~c).alias("rc"),
    )
    steps = F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))
    grid = labs.withColumn("w1", F.explode(steps)).withColumn("w2", F.explode(F.sequence(F.lit(0).cast("long"), 10 - F.col("w1"))))
    better = F.expr("w1 * ab + w2 * fb + (10 - w1 - w2) * rb >= w1 * ac + w2 * fc + (10 - w1 - w2) * rc")
    return grid.groupBy("w1", "w2", F.when(better, "b").otherwise("c").alias("best")).agg(F.count(F.lit(1)).alias("n"))


@query("ag26_summary", """select source, count(*) as n, round(avg(n_chars), 4) as mean, round(stddev_pop(n_chars), 4) as sd, round(quantile_cont(n_chars, 0.05), 4) as q05,
    round(quantile_cont(n_chars, 0.5), 4) as median, round(quantile_cont(n_chars, 0.95), 4) as q95 from documents group by source""")
def ag26(spark, d):
    docs = table(spark, d, "documents").withColumn("v", F.col("n_chars").cast("double"))
    return rounded(stats.summary(docs, "v", ["source"]), "mean", "sd", "q05", "median", "q95", digits=4)


@query("ag27_fragmentation", sql('''select episode, count(*) as runs, round(quantile_cont(("end" - "start") / fps, 0.5), 6) as median_s, count(*) filter (("end" - "start") / fps < 0.2) as short_runs,
    round((count(*) - 1) / (n_frames / fps / 60), 4) as switches_per_minute from runs_a join episodes using (episode) group by episode, n_frames, fps''', "a"))
def ag27(spark, d):
    rows = runs(spark, d, "a").join(episodes(spark, d), "episode").withColumn("s", (F.col("end") - F.col("start")) / F.col("fps"))
    return rows.groupBy("episode").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.percentile("s", 0.5), 6).alias("median_s"), F.count_if(F.col("s") < 0.2).alias("short_runs"),
        F.round((F.count(F.lit(1)) - 1) / (F.first("n_frames") / F.first("fps") / 60), 4).alias("switches_per_minute"),
    )


OCCURRENCES = "(select conv_id, role, turn, row_number() over (partition by conv_id, role order by turn) as k, text from conversations)"


@query("ag28_category_dice", f"""with words as (select conv_id, k, role = 'user' as u, unnest(string_split(lower(text), ' ')) as w from {OCCURRENCES} where role in ('user', 'assistant')),
    counts as (select conv_id, k, w, count(*) filter (u) as nu, count(*) filter (not u) as nv from words group by 1, 2, 3)
    select conv_id, k as occurrence, round(2 * sum(least(nu, nv)) / sum(nu + nv)::double, 6) as dice from counts group by 1, 2 having sum(nu) > 0 and sum(nv) > 0""")
def ag28(spark, d):
    """Dice with multiplicity of the words of the n-th turns of both roles."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    rows = table(spark, d, "conversations").where("role in ('user', 'assistant')").withColumn("occurrence", F.row_number().over(w).cast("long"))
    user = F.col("role") == "user"
    words = rows.select("conv_id", "occurrence", user.alias("u"), F.explode(F.split(F.lower("text"), " ")).alias("w"))
    counts = words.groupBy("conv_id", "occurrence", "w").agg(F.count_if("u").alias("nu"), F.count_if(~F.col("u")).alias("nv"))
    each = counts.groupBy("conv_id", "occurrence").agg(F.sum(F.least("nu", "nv")).alias("both"), F.sum("nu").alias("nu"), F.sum("nv").alias("nv"))
    return each.where("nu > 0 and nv > 0").select("conv_id", "occurrence", F.round(2 * F.col("both") / (F.col("nu") + F.col("nv")), 6).alias("dice"))


@query("ag29_order_balanced_scores", """select k, round(avg(m), 6) as score, count(*) filter (abs(ab - ba) > 50) as order_disagreements from (
    select l_partkey % 20 as k, l_orderkey, avg(l_quantity) filter (l_linenumber % 2 = 0) as ab, avg(l_quantity) filter (l_linenumber % 2 = 1) as ba,
        (avg(l_quantity) filter (l_linenumber % 2 = 0) + avg(l_quantity) filter (l_linenumber % 2 = 1)) / 2 as m from lineitem group by 1, 2) group by k""")
def ag29(spark, d):
    side = F.when(F.col("l_linenumber") % 2 == 0, "ab").otherwise("ba")
    rows = (
        table(spark, d, "lineitem").withColumns({"k": F.col("l_partkey") % 20, "side": side})
        .groupBy("k", "l_orderkey").pivot("side", ["ab", "ba"]).agg(F.avg("l_quantity"))
    )
    return rows.groupBy("k").agg(
        F.round(F.avg((F.col("ab") + F.col("ba")) / 2), 6).alias("score"), F.count_if(F.abs(F.col("ab") - F.col("ba")) > 50).alias("order_disagreements")
    )


@query("ag30_tiered_cost", """select l_returnflag, round(sum(case when l_quantity > 40 then 2 * l_quantity else l_quantity end * 0.25 + l_extendedprice / 1000 * 1.25), 4) as spent,
    round(sum(case when l_linestatus = 'O' then l_extendedprice / 100 else 0 end), 4) as reserved from lineitem group by l_returnflag""")
def ag30(spark, d):
    from ..functions.cost import tiered_cost

    cost = tiered_cost(F.col("l_quantity"), F.col("l_extendedprice") / 1000, 40, 0.25, 1.25, 2.0)
    held = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") / 100).otherwise(0.0)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(cost), 4).alias("spent"), F.round(F.sum(held), 4).alias("reserved"))


@query("ag31_status_rollup", "select o_orderstatus as status, count(*) as n, round(sum(o_totalprice), 2) as size from orders group by 1")
def ag31(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("size")
    )


@query("ag32_segment_counts", sql("""select lab, state, count(*) as segments, count(*) filter ("end" - "start" > 1) as longer from runs_a join episodes using (episode) group by 1, 2""", "a"))
def ag32(spark, d):
    rows = runs(spark, d, "a").join(episodes(spark, d).select("episode", "lab"), "episode")
    return rows.groupBy("lab", "state").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("end") - F.col("start") > 1).alias("longer"))


@query("ag33_limit_classes", """select coalesce(source, 'all') as source, count(*) filter (hi <= 500) as under, count(*) filter (lo > 500) as over, count(*) filter (lo <= 500 and hi > 500) as uncertain from (
    select source, n_chars // 6 as lo, n_chars // 3 as hi from documents) group by grouping sets ((), (source))""")
def ag33(spark, d):
    docs = table(spark, d, "documents").select("source", F.floor(F.col("n_chars") / 6).alias("lo"), F.floor(F.col("n_chars") / 3).alias("hi"))
    return docs.rollup("source").agg(
        F.count_if(F.expr("hi <= 500")).alias("under"), F.count_if(F.expr("lo > 500")).alias("over"), F.count_if(F.expr("lo <= 500 and hi > 500")).alias("uncertain")
    ).withColumn("source", F.coalesce("source", F.lit("all")))


@query("ag36_null_safe_equality", sql("""select count(*) filter (p is not distinct from b) as same, count(*) filter (p is not null and b is not null) as covered, count(*) filter (p = b) as same_covered from frames"""))
def ag36(spark, d):
    rows = frames(spark, d)
    return rows.agg(
        F.count_if(F.col("p").eqNullSafe(F.col("b"))).alias("same"), F.count_if(F.col("p").isNotNull() & F.col("b").isNotNull()).alias("covered"),
        F.count_if(F.col("p") == F.col("b")).alias("same_covered"),
    )


@query("ag38_rater_pairs", sql("""select x.n as left_rater, y.n as right_rater, count(*) filter (x.v = y.v) as agreed, count(*) filter (x.v is null or y.v is null) as unavailable
    from (select episode, frame, 'a' as n, a as v from frames union all select episode, frame, 'b', b from frames union all select episode, frame, 'p', p from frames) x
    join (select episode, frame, 'a' as n, a as v from frames union all select episode, frame, 'b', b from frames union all select episode, frame, 'p', p from frames) y
    on x.episode = y.episode and x.frame = y.frame and x.n < y.n group by 1, 2"""))
def ag38(spark, d):
    # the pairs of three tracks are known: one pass, no self join
    rows = frames(spark, d)
    pair = lambda l, r: F.struct(F.lit(l).alias("left_rater"), F.lit(r).alias("right_rater"), F.col(l).alias("x"), F.col(r).alias("y"))
    pairs = rows.select(F.explode(F.array(pair("a", "b"), pair("a", "p"), pair("b", "p"))).alias("s")).select("s.*")
    return pairs.groupBy("left_rater", "right_rater").agg(
        F.count_if(F.col("x") == F.col("y")).alias("agreed"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unavailable")
    )


@query("ag39_cost_pivot", """select o_custkey, case when count(*) filter (o_orderstatus = 'O') = 0 then 'not run' when count(*) filter (o_orderstatus = 'O' and o_orderpriority = '4-NOT SPECIFIED') > 0 then 'unknown' else cast(cast(round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) as decimal(18, 2)) as varchar) end as "O", case when count(*) filter (o_orderstatus = 'F') = 0 then 'not run' when count(*) filter (o_orderstatus = 'F' and o_orderpriority = '4-NOT SPECIFIED') > 0 then 'unknown' else cast(cast(round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as decimal(18, 2)) as varchar) end as "F", case when count(*) filter (o_orderstatus = 'P') = 0 then 'not run' when count(*) filter (o_orderstatus = 'P' and o_orderpriority = '4-NOT SPECIFIED') > 0 then 'unknown' else cast(cast(round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2) as decimal(18, 2)) as varchar) end as "P" from orders group by o_custkey""")
def ag39(spark, d):
    """Cost by customer and status; a cell without orders was not run, one with an order of
    unspecified priority has no known cost."""
    known = F.count_if(F.col("o_orderpriority") == "4-NOT SPECIFIED") == 0
    cost = F.round(F.sum("o_totalprice"), 2).cast("decimal(18, 2)").cast("string")
    cells = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["O", "F", "P"]).agg(F.when(known, cost).otherwise("unknown"))
    return cells.na.fill("not run")


@query("ag39_running_ledger", """select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as spent from orders""")
def ag39_ledger(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("spent"))


@query("ag40_error_histogram", sql("""select case when p is null then 'missing' when p and not a then 'false_alarm' when not p and a then 'missed' else 'right' end as reason, count(*) as n from frames group by 1"""))
def ag40(spark, d):
    from ..operators.validate import first_reason

    p, a = F.col("p"), F.col("a")
    rows = first_reason(frames(spark, d), {"missing": p.isNull(), "false_alarm": p & ~a, "missed": ~p & a})
    return rows.groupBy(F.coalesce("reason", F.lit("right")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("ag40_paired_bootstrap", sql("""select count(*) as rounds, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.975), 6) as high from (
    select r, sum(xt)::double / nullif(sum(xn), 0) - sum(yt)::double / nullif(sum(yn), 0) as v from (
        select r, ('0x' || substr(md5('q|' || r || '|' || slot), 1, 12))::bigint % (select count(*) from episodes) as pick from range(100) t(r), (select row_number() over (order by episode) - 1 as slot from episodes) u) draws
    join (select row_number() over (order by episode) - 1 as slot, count(*) filter (a and b) as xt, count(*) filter (a or b) as xn, count(*) filter (a and p) as yt, count(*) filter (a or p) as yn
        from frames group by episode) e on e.slot = pick group by r) where v is not null"""))
def ag40_paired(spark, d):
    """Interval of the difference of two arms' IoU with track a, over the same draws of episodes;
    draws in which an arm is undefined are left out."""
    A, B, P = F.col("a"), F.col("b"), F.col("p")
    each = frames(spark, d).groupBy("episode").agg(
        F.count_if(A & B).alias("xt"), F.count_if(A | B).alias("xn"), F.count_if(A & P).alias("yt"), F.count_if(A | P).alias("yn")
    )
    draws = stats.bootstrap_draws(each.select("episode"), "episode", 100, "q")
    return rounded(stats.paired_bootstrap(draws, each, "episode", ("xt", "xn"), ("yt", "yn")), "low", "median", "high")


@query("ag41_frame_budget_arms", sql("""select arm, count(*) as frames, count(*) filter (a = b) as agreed, round(sum(value) / 100, 4) as cost from (
    select 1 as arm, * from frames union all select 2, * from frames where frame % 2 = 0 or frame = n_frames - 1 union all select 4, * from frames where frame % 4 = 0 or frame = n_frames - 1) group by arm"""))
def ag41(spark, d):
    arm = F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))
    rows = frames(spark, d).withColumn("arm", arm).where((F.col("frame") % F.col("arm") == 0) | (F.col("frame") == F.col("n_frames") - 1))
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("a") == F.col("b")).alias("agreed"), F.round(F.sum("value") / 100, 4).alias("cost"))


@query("ag42_bidirectional_scores", """select x.l_orderkey, x.l_linenumber, round((x.l_discount + y.l_discount) / 2, 6) as mean_score, least(x.l_discount, y.l_discount) as least_score
    from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1""")
def ag42(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return neighbour_scores(rows, rows)


def neighbour_scores(rows, following):
    back = following.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_discount").alias("back"))
    both = rows.join(back, ["l_orderkey", "l_linenumber"])
    return both.select("l_orderkey", "l_linenumber", F.round((F.col("l_discount") + F.col("back")) / 2, 6).alias("mean_score"), F.least("l_discount", "back").alias("least_score"))
