"""Join, set, sampling, projection, text and sink queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as tx
from ..operators import sampling as sp
from ..operators import timeline as tl
from ..operators import validate as va
from ..sources.tables import read_current, replace_table, saved, shared_dir, tar_archives, tar_faults, tar_members
from .binding import episodes, frames, positives, runs, sql, table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


@query("jn01_prj14_lookup_corrections", """select doc_id, n_chars, case when toxic = 1 then 'drop' when quality = 0 then 'relabel' else 'keep' end as decision from labels left join documents using (doc_id)""")
def jn01(spark, d):
    """Every label finds its document; a label without one is an error, not a lost row."""
    decision = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 0, "relabel").otherwise("keep")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.lit(True).alias("there"))
    unknown = F.raise_error(F.concat(F.lit("no document "), F.col("doc_id").cast("string"))).cast("long")
    rows = table(spark, d, "labels").join(docs, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("there"), F.col("n_chars")).otherwise(unknown).alias("n_chars"), decision.alias("decision"))


@query("jn02_positional_zip", """select conv_id, x.turn, x.role as left_role, y.role as right_role from conversations x join conversations y using (conv_id) where y.turn = x.turn + 1""")
def jn02(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"right_role": F.lead("role").over(w), "following": F.lead("turn").over(w)})
    return rows.where("following = turn + 1").select("conv_id", "turn", F.col("role").alias("left_role"), "right_role")


@query("jn03_multi_key_scores", """select l_orderkey, l_linenumber, round(s.score, 6) as score from lineitem l left join (
    select l_partkey, l_suppkey, avg(l_discount) as score from lineitem where l_returnflag = 'R' group by 1, 2) s using (l_partkey, l_suppkey)""")
def jn03(spark, d):
    li = table(spark, d, "lineitem")
    scores = li.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.avg("l_discount").alias("score"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(scores, ["l_partkey", "l_suppkey"], "left").select(
        "l_orderkey", "l_linenumber", F.round("score", 6).alias("score")
    )


@query("jn05_aligned_tracks", sql("select episode, frame, a, b, c = 1 as c1 from frames"))
def jn05(spark, d):
    """Three tracks, each a table of its own, aligned frame by frame; a frame that one lacks is kept."""
    rows = frames(spark, d).withColumn("c1", F.col("c") == 1)
    tracks = [rows.select("episode", "frame", t) for t in ("a", "b", "c1")]
    return tracks[0].join(tracks[1], ["episode", "frame"], "full_outer").join(tracks[2], ["episode", "frame"], "full_outer")


@query("jn06_point_in_interval", sql('''select f.episode, f.frame, r."start", r.state from frames f join runs_c r on r.episode = f.episode and f.frame >= r."start" and f.frame < r."end" where f.a''', "c"))
def jn06(spark, d):
    points = frames(spark, d).where("a").select("episode", "frame")
    return tl.containing(points, runs(spark, d, "c")).select("episode", "frame", "start", "state")


@query("jn07_nearest_frame", sql("""select episode, target, nearest from (
    select t.episode, target, f.frame as nearest, row_number() over (partition by t.episode, target order by abs(f.frame - target), f.frame) as r
    from (select episode, unnest(generate_series(0, n_frames - 1, 16)) as target from episodes) t join frames f on f.episode = t.episode and f.a) where r = 1"""))
def jn07(spark, d):
    targets = tl.core_windows(episodes(spark, d), 16, 0).select("episode", F.col("core_start").alias("target"))
    return tl.nearest(frames(spark, d).where("a"), targets)


@query("jn08_semi_join", sql("select episode, n_frames from episodes where episode in (select episode from frames where b)"))
def jn08(spark, d):
    return episodes(spark, d).select("episode", "n_frames").join(frames(spark, d).where("b"), "episode", "left_semi")


@query("jn09_exclude_with_reason", """select doc_id, case when doc_id in (select doc_id from labels where toxic = 1) then 'labelled_toxic' when dup then 'same_text' when n_chars > 5000 then 'too_long' end as reason from (
    select doc_id, n_chars, row_number() over (partition by text order by doc_id) > 1 as dup from documents)
    where doc_id in (select doc_id from labels where toxic = 1) or dup or n_chars > 5000""")
def jn09(spark, d):
    first = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("bad")).distinct()
    docs = table(spark, d, "documents").withColumn("dup", F.row_number().over(first) > 1).drop("text")
    rows = va.first_reason(
        docs.join(toxic, "doc_id", "left"), {"labelled_toxic": F.col("bad"), "same_text": F.col("dup"), "too_long": F.col("n_chars") > 5000}
    )
    return rows.where("reason is not null").select("doc_id", "reason")


@query("jn10_unordered_pairs", """select x.conv_id, x.turn as t1, y.turn as t2 from conversations x join conversations y on x.conv_id = y.conv_id and x.turn < y.turn and x.role = y.role""")
def jn10(spark, d):
    rows = table(spark, d, "conversations")
    x, y = rows.select("conv_id", "role", F.col("turn").alias("t1")), rows.select("conv_id", "role", F.col("turn").alias("t2"))
    return x.join(y, ["conv_id", "role"]).where("t1 < t2").select("conv_id", "t1", "t2")


@query("jn11_directed_pairs", """select x.conv_id, x.turn as t1, y.turn as t2 from conversations x join conversations y on x.conv_id = y.conv_id and x.turn <> y.turn and x.role <> y.role""")
def jn11(spark, d):
    rows = table(spark, d, "conversations")
    x = rows.select("conv_id", F.col("role").alias("r1"), F.col("turn").alias("t1"))
    y = rows.select("conv_id", F.col("role").alias("r2"), F.col("turn").alias("t2"))
    return x.join(y, "conv_id").where("t1 <> t2 and r1 <> r2").select("conv_id", "t1", "t2")


@query("jn12_condition_grid", sql("select lab, threshold, count(*) filter (value > threshold) as n from frames, (values (50), (100), (200)) t(threshold) group by 1, 2"))
def jn12(spark, d):
    grid = F.explode(F.array(*(F.lit(t) for t in (50, 100, 200))))
    return frames(spark, d).withColumn("threshold", grid).groupBy("lab", "threshold").agg(F.count_if(F.col("value") > F.col("threshold")).alias("n"))


@query("jn13_reconcile_ids", """select o_orderkey as id, 'missing' as problem from orders where o_orderkey not in (select l_orderkey from lineitem)
    union all select l_orderkey, 'unexpected' from lineitem where l_orderkey not in (select o_orderkey from orders) group by 1
    union all select l_orderkey, 'duplicate' from lineitem where l_orderkey in (select o_orderkey from orders) group by l_orderkey having count(*) > 1""")
def jn13(spark, d):
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return va.reconcile(expected, found, "id")


@query("jn14_matched_pairs")
def jn14(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("len", F.col("n_chars").cast("double"))
    return sp.matched_pairs(docs.where("quality = 0"), docs.where("quality = 1"), "source", "len", "doc_id")


@query("jn15_components", """with recursive hub as (select l_orderkey, min(l_suppkey) as h from lineitem group by 1), e as (select distinct l_suppkey as a, h as b from lineitem join hub using (l_orderkey)),
    both_ways as (select a, b from e union select b, a from e), r(node, seen) as (select a, b from both_ways union select r.node, w.b from r join both_ways w on w.a = r.seen) select node, min(seen) as root from r group by node""")
def jn15(spark, d):
    return suppliers_linked(table(spark, d, "lineitem"))


def suppliers_linked(li):
    from ..sources.tables import saved

    li = li.select("l_orderkey", "l_suppkey")
    # members of an order are linked with its least member: no pairs within a group
    hub = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("b"))
    edges = li.join(hub, "l_orderkey").select(F.col("l_suppkey").alias("a"), "b")
    found = sp.components(edges, saved)
    alone = li.select(F.col("l_suppkey").alias("node")).distinct().join(found, "node", "left")
    return alone.select("node", F.coalesce("root", "node").alias("root"))


@query("jn17_sidecar_fallback", """select conv_id, coalesce(max(text) filter (turn = 99), min_by(text, turn) filter (role = 'assistant'), 'none') as target from conversations group by conv_id""")
def jn17(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 99, F.col("text"))).alias("explicit"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("turns"),
    )
    return rows.select("conv_id", F.coalesce("explicit", F.get("turns", F.lit(0))["text"], F.lit("none")).alias("target"))


@query("jn18_canonical_alias", """select doc_id, min(doc_id) over (partition by text) as canonical from documents""")
def jn18(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("canonical"))  # pre-aggregated: a hot text is one row a task
    return docs.join(least, "h").select("doc_id", "canonical")


@query("jn19_as_of", """select event_id as id, (select max_by(value, ts) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts <= e.ts) as value from events e where event_type = 'click'""")
def jn19(spark, d):
    ev = table(spark, d, "events").withColumn("at", F.col("ts"))
    clicks = ev.where("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("id"))
    bought = ev.where("event_type = 'purchase'").select("user_id", "at", "value")
    return tl.as_of(clicks, bought, ["user_id"], F.to_date("at")).select("id", "value")


@query("prj10_reasons", """select case when n_chars < 200 then 'short' when lang <> 'en' then 'language' when source = 'src0' then 'source' else 'eligible' end as reason, count(*) as n from documents group by 1""")
def prj10(spark, d):
    rows = va.first_reason(table(spark, d, "documents"), {"short": F.col("n_chars") < 200, "language": F.col("lang") != "en", "source": F.col("source") == "src0"})
    return rows.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("prj02_evidence_rules", """select 'frame' as rule, conv_id, turn from conversations where turn > 3 union all select 'role', conv_id, turn from conversations where role not in ('user', 'assistant') union all select 'empty', conv_id, turn from conversations where text is null or text = ''""")
def prj02(spark, d):
    rules = {"frame": F.col("turn") <= 3, "role": F.col("role").isin("user", "assistant"), "empty": F.length("text") > 0}
    return va.violations(table(spark, d, "conversations"), rules, "conv_id", "turn")


@query("prj03_equal_neighbours", sql('''select 'equal_neighbours' as rule, episode, "start" as place from (
    select episode, "start", state = 1 as s, lag(state = 1) over w as was, lag("end") over w as until from runs_c window w as (partition by episode order by "start")) where s = was and until = "start"''', "c"))
def prj03(spark, d):
    return va.equal_neighbours(runs(spark, d, "c").withColumn("s", F.col("state") == 1), "s")


ACTIONS = """(select user_id as episode, event_type as action, ts, event_id, row_number() over w - 1 as start_frame, lead(event_type) over w as next_action,
        lead(cast(json_extract_string(props, '$.k') as bigint)) over w as next_k, cast(json_extract_string(props, '$.k') as bigint) as k,
        row_number() over (partition by user_id, event_type order by ts, event_id) as nth from events window w as (partition by user_id order by ts, event_id))"""


@query("prj04_atomic_actions", f"""select 'severity_without_failure' as rule, episode, start_frame as place from {ACTIONS} where action <> 'error' and k >= 95
    union all select 'failure_without_severity', episode, start_frame from {ACTIONS} where action = 'error' and k < 5
    union all select 'split_action', episode, start_frame from {ACTIONS} where action = next_action and k = next_k
    union all select 'category_count', episode, start_frame from {ACTIONS} where action = 'error' and k % 7 = 0""")
def prj04(spark, d):
    """Segments of one action each: failures have a severity and categories, others have none, and
    neighbours of equal action and state have to be one segment."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").withColumns({"k": k, "start_frame": (F.row_number().over(w) - 1).cast("long")})
    failure = F.col("event_type") == "error"
    seg = rows.select(
        F.col("user_id").alias("episode"), F.col("start_frame").alias("place"), F.col("event_type").alias("action"), failure.alias("failure"), "k",
        F.when(failure & (k >= 5), "set").when(~failure & (k >= 95), "set").alias("severity"),
        F.when(failure, F.array_repeat(F.lit("type"), (k % 7).cast("int"))).otherwise(F.array().cast("array<string>")).alias("categories"),
        F.struct(F.lead("event_type").over(w).alias("action"), F.lead(k).over(w).alias("k")).alias("following"),
    )
    rules = {
        "severity_without_failure": F.col("failure") | F.col("severity").isNull(),
        "failure_without_severity": ~F.col("failure") | F.col("severity").isNotNull(),
        "split_action": ~F.struct("action", "k").eqNullSafe(F.col("following")),
        "category_count": ~F.col("failure") | (F.size("categories") > 0),
    }
    return va.violations(seg, rules, "episode", "place")


@query("prj06_prj20_split_leaks", """select l_partkey, count(distinct l_orderkey % 3) as splits from lineitem group by 1 having count(distinct l_orderkey % 3) > 1""")
def prj06(spark, d):
    rows = table(spark, d, "lineitem").withColumn("split", F.col("l_orderkey") % 3)
    return va.leaks(rows, "l_partkey", "split")


@query("prj12_prj13_projections", sql("select c, count(*) filter (b and not a) as only_b, count(*) filter (c = 1) as strict, count(*) filter (c <= 2) as lenient from frames group by c"))
def prj12(spark, d):
    return frames(spark, d).groupBy("c").agg(
        F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count_if(F.col("c") == 1).alias("strict"), F.count_if(F.col("c") <= 2).alias("lenient")
    )


@query("prj08_dense_output_check", sql("""select episode, count(*) as n, min(c) >= 1 and max(c) <= 3 as in_domain, count(distinct frame) = n_frames as complete from frames group by episode, n_frames"""))
def prj08(spark, d):
    per = frames(spark, d).groupBy("episode", "n_frames").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("c").between(1, 3)).alias("in_domain"), F.count_distinct("frame").alias("k")
    )
    return per.select("episode", "n", "in_domain", (F.col("k") == F.col("n_frames")).alias("complete"))


#: Fields whose supervision an uncertain field takes away, itself among them.
DEPENDENTS = {"identity": ["identity", "object", "result"], "object": ["object", "result"], "boundary": ["boundary", "action"], "result": ["result"]}


@query("prj15_field_masks", """with f(doc_id, field) as (select doc_id, unnest(case when n_chars % 5 = 0 then ['identity'] when n_chars % 5 = 1 then ['object', 'boundary'] when n_chars % 5 = 2 then ['result'] else [] end) from documents),
    d(field, masked) as (values ('identity', 'identity'), ('identity', 'object'), ('identity', 'result'), ('object', 'object'), ('object', 'result'), ('boundary', 'boundary'), ('boundary', 'action'), ('result', 'result'))
    select doc_id, string_agg(distinct masked, ',' order by masked) as masked, count(distinct masked) as n from f join d using (field) group by doc_id""")
def prj15(spark, d):
    """The fields that a document's uncertain fields mask, by the dependency table."""
    n = F.col("n_chars") % 5
    uncertain = F.when(n == 0, F.array(F.lit("identity"))).when(n == 1, F.array(F.lit("object"), F.lit("boundary"))).when(n == 2, F.array(F.lit("result")))
    rules = spark.createDataFrame([(k, v) for k, many in DEPENDENTS.items() for v in many], "field string, masked string")
    rows = table(spark, d, "documents").select("doc_id", F.explode(uncertain).alias("field")).join(F.broadcast(rules), "field")  # eight rules
    fields = F.array_sort(F.collect_set("masked"))
    return rows.groupBy("doc_id").agg(F.concat_ws(",", fields).alias("masked"), F.size(fields).cast("long").alias("n"))


@query("prj16_excluded_spans", """select doc_id, s as "start", e as "end" from (
    select doc_id, 0 as s, 10 as e, n_chars from documents where n_chars > 10 union all select doc_id, 20, 40, n_chars from documents where n_chars > 20) where s < n_chars and e <= n_chars
    union all select doc_id, 20, n_chars::int from documents where n_chars > 20 and n_chars < 40 union all select doc_id, 60, n_chars::int from documents where n_chars > 60
    union all select doc_id, 0, n_chars::int from documents where n_chars <= 10 and n_chars > 0""")
def prj16(spark, d):
    n = F.col("n_chars").cast("int")
    span = lambda a, b: F.struct(F.least(F.lit(a), n).alias("start"), F.least(F.lit(b), n).alias("end"))
    spans = F.array(span(10, 20), span(40, 60))
    gaps = table(spark, d, "documents").select("doc_id", F.explode(tx.complement(spans, n)).alias("g"))
    return gaps.select("doc_id", "g.start", "g.end")


@query("prj17_token_masks", """with w as (select doc_id, unnest(list_transform(string_split(text, ' '), lambda t, i: {'t': t, 'i': i})) as x, text from documents where text is not null),
    t as (select doc_id, x.t as t, sum(length(x.t) + 1) over (partition by doc_id order by x.i rows unbounded preceding) - length(x.t) - 1 as s from w)
    select doc_id, count(*) as tokens, count(*) filter ((s < 20 and s + length(t) > 10) or (s < 60 and s + length(t) > 40)) as masked from t where t <> '' group by doc_id""")
def prj17(spark, d):
    """Tokens whose character offsets overlap an excluded span, [10, 20) or [40, 60)."""
    words = F.split("text", " ")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(words).alias("i", "t"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0))
    rows = rows.withColumn("start", start).where("t <> ''").withColumn("end", F.col("start") + F.length("t"))
    hit = lambda a, b: (F.col("start") < b) & (F.col("end") > a)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(hit(10, 20) | hit(40, 60)).alias("masked"))


@query("prj19_equality_modulo_fields", """select x.o_orderkey, x.o_orderstatus = y.o_orderstatus as same from orders x join orders y on y.o_orderkey = x.o_orderkey + 1""")
def prj19(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_totalprice", "o_orderdate").alias("r"))
    other = rows.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("r").alias("q"))
    strip = lambda c: F.col(c).dropFields("o_totalprice", "o_orderdate")
    return rows.join(other, "o_orderkey").select("o_orderkey", (strip("r") == strip("q")).alias("same"))


@query("prj22_dimension_contract", """select l_orderkey, count(*) = count(distinct l_linenumber) as one_to_one, bool_and(l_returnflag in ('A', 'N', 'R')) as in_enum from lineitem group by 1""")
def prj22(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (F.count(F.lit(1)) == F.count_distinct("l_linenumber")).alias("one_to_one"), F.every(F.col("l_returnflag").isin("A", "N", "R")).alias("in_enum")
    )


@query("prj23_trimmed_changes", """select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> text as changed from documents""")
def prj23(spark, d):
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, d, "documents").select("doc_id", (clean != F.col("text")).alias("changed"))


@query("prj21_mask_names", sql("""select episode, frame, array_to_string(list_filter(['a', 'b', 'c'], lambda x: (x = 'a' and a) or (x = 'b' and b) or (x = 'c' and c = 1)), ',') as names from frames"""))
def prj21(spark, d):
    pairs = F.arrays_zip(F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("name"), F.array("a", "b", F.col("c") == 1).alias("on"))
    names = F.transform(F.filter(pairs, lambda p: p["on"]), lambda p: p["name"])
    return frames(spark, d).select("episode", "frame", F.concat_ws(",", names).alias("names"))


@query("prj25_camera_selection", """select coalesce(x.s_nationkey, y.n_nationkey) as slot, x.s_nationkey is not null as included, y.n_nationkey is not null as listed from (select distinct s_nationkey from supplier) x full outer join nation y on x.s_nationkey = y.n_nationkey""")
def prj25(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_nationkey").alias("slot")).distinct().withColumn("inc", F.lit(True))
    y = table(spark, d, "nation").select(F.col("n_nationkey").alias("slot")).withColumn("lst", F.lit(True))
    return x.join(y, "slot", "full_outer").select("slot", F.col("inc").isNotNull().alias("included"), F.col("lst").isNotNull().alias("listed"))


@query("sl02_top_k_per_group", """select source, doc_id from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) where r <= 3""")
def sl02(spark, d):
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, d, "documents").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "doc_id")


@query("sl03_seeded_sample", "select doc_id from documents order by sha256('s:' || doc_id), doc_id limit 50")
def sl03(spark, d):
    return sp.sample(table(spark, d, "documents"), "s", "doc_id", 50).select("doc_id")


@query("sl04_balanced_order", "select doc_id, row_number() over (partition by source order by sha256('s:' || doc_id), doc_id) as turn from documents")
def sl04(spark, d):
    return sp.balanced_order(table(spark, d, "documents"), "s", "doc_id", ["source"]).select("doc_id", "turn")


@query("sl05_stratified_order", "select doc_id, row_number() over (partition by source, toxic order by sha256('s:' || doc_id), doc_id) as turn from documents join labels using (doc_id)")
def sl05(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return sp.balanced_order(rows, "s", "doc_id", ["source", "toxic"]).select("doc_id", "turn")


@query("sl06_quota_take", """select source, doc_id, quality from (select *, row_number() over (partition by source order by place, quality) as r from (
    select source, doc_id, quality, row_number() over (partition by source, quality order by doc_id) as place from documents join labels using (doc_id))) where r <= 6""")
def sl06(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", "doc_id", "quality")
    return sp.quota_take(rows, "source", "quality", ["doc_id"], 6)


@query("sl07_proportional_split", """select doc_id, case when row_number() over (partition by source order by sha256('s:' || doc_id), doc_id) <= round_even(count(*) over (partition by source) * 0.1, 0) then 'eval' else 'train' end as split from documents""")
def sl07(spark, d):
    return sp.proportional_split(table(spark, d, "documents"), "s", "doc_id", ["source"], 0.1).select("doc_id", "split")


@query("sl08_group_split")
def sl08(spark, d):
    docs = table(spark, d, "documents")
    sizes = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}  # a row for each source
    chosen = sp.closest_subset(sizes, sum(sizes.values()) // 5)
    split = F.when(F.col("source").isin(sorted(chosen)), "eval").otherwise("train")
    return docs.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("sl09_frame_samples", sql("""select episode, array_to_string(list_sort(list_distinct(list_append(generate_series(0, n_frames - 1, 7), n_frames - 1))), ',') as strided, array_to_string(list_sort(list_distinct(list_transform(range(5), lambda i: cast(floor(i * (n_frames - 1) / 4.0 + 0.5) as bigint)))), ',') as even from episodes"""))
def sl09(spark, d):
    n = F.col("n_frames")
    return episodes(spark, d).select("episode", F.concat_ws(",", F.array_sort(sp.stride_frames(n, 7)).cast("array<string>")).alias("strided"), F.concat_ws(",", F.array_sort(sp.evenly(n, 5)).cast("array<string>")).alias("even"))


@query("sl10_hash_split_mod3", """select doc_id, list_sum(list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(sha256(doc_id::varchar), i, 1)) - 1))::bigint % 3 as part from documents""")
def sl10(spark, d):
    return table(spark, d, "documents").select("doc_id", sp.hash_mod3("doc_id").cast("long").alias("part"))


@query("sl11_alternating_split", "select doc_id, row_number() over (partition by source order by doc_id) % 2 as part from documents")
def sl11(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", (F.row_number().over(w) % 2).cast("long").alias("part"))


@query("sl12_balanced_replay", "select doc_id, i::int as copy from labels, range(4) t(i) where toxic = 1 or i = 0")
def sl12(spark, d):
    return sp.replay(table(spark, d, "labels"), F.col("toxic") == 1, 4).select("doc_id", "copy")


@query("sl13_blind_ids", "select doc_id, substr(sha256('seed:' || doc_id), 1, 12) as blind from documents")
def sl13(spark, d):
    return table(spark, d, "documents").select("doc_id", sp.blind_id("seed", "doc_id").alias("blind"))


@query("sl14_budget_prefix", """select o_custkey, o_orderkey from (select *, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as running from orders) where running <= 500000""")
def sl14(spark, d):
    rows = sp.prefix_within_budget(table(spark, d, "orders"), "o_totalprice", 500000, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_custkey", "o_orderkey")


@query("snk06_next_fit_shards", """with recursive r as (select strftime(o_orderdate, '%Y-%m') as day, o_orderkey, o_totalprice, row_number() over (partition by strftime(o_orderdate, '%Y-%m') order by o_orderkey) as i from orders),
    w(day, i, used, n, shard) as (select day, i, o_totalprice::double, 1, 0::bigint from r where i = 1
        union all select r.day, r.i, case when full_ then o_totalprice else used + o_totalprice end, case when full_ then 1 else n + 1 end, case when full_ then shard + 1 else shard end
        from (select r.day, r.i, r.o_totalprice::double as o_totalprice, w.used, w.n, w.shard, w.used + r.o_totalprice::double > 1000000 or w.n + 1 > 5 as full_ from w join r on r.day = w.day and r.i = w.i + 1) r)
    select day, o_orderkey, o_totalprice, shard from w join r using (day, i)""")
def snk06(spark, d):
    rows = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM"))
    return sp.next_fit_shards(rows, "day", ["o_orderkey"], "o_totalprice", 1_000_000.0, 5, F.floor(F.col("o_orderkey") / 65_536))


@query("so01_union_with_duplicates", """select id, count(*) as times from (select o_orderkey as id from orders union all select l_orderkey from lineitem) group by id having count(*) > 1""")
def so01(spark, d):
    both = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).unionByName(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


@query("so02_difference", "select doc_id from documents except select doc_id from labels")
def so02(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@query("so03_symmetric_difference", sql("(select episode, frame from frames where a except select episode, frame from frames where b) union all (select episode, frame from frames where b except select episode, frame from frames where a)"))
def so03(spark, d):
    rows = frames(spark, d)
    x, y = (rows.where(t).select("episode", "frame") for t in "ab")
    return x.subtract(y).unionByName(y.subtract(x))


@query("so04_set_fingerprints", """select min(l_orderkey) as first_order, count(*) as orders from (select l_orderkey, list_sort(list(distinct l_returnflag || l_linestatus)) as fp from lineitem group by 1) group by fp""")
def so04(spark, d):
    fp = F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(fp.alias("fp")).groupBy("fp").agg(F.min("l_orderkey").alias("first_order"), F.count(F.lit(1)).alias("orders")).drop("fp")


@query("so05_distinct_pairs", "select count(*) as pairs from (select distinct l_partkey, l_suppkey from lineitem)")
def so05(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().agg(F.count(F.lit(1)).alias("pairs"))


@query("so06_first_of_duplicates", "select doc_id from (select doc_id, row_number() over (partition by source, text order by doc_id) as r from documents) where r = 1")
def so06(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return sp.first_of_each(rows, ["source", "h"], ["doc_id"]).select("doc_id")


@query("fn_cosine_within_label", """select x.label, round(avg(list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e)))), 4) as mean_cosine from
    (select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings) x join (select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings) y on y.vec_id = x.vec_id + 1 and x.label = y.label group by x.label""")
def fn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("other"))
    pairs = e.join(y, ["vec_id", "label"])
    return pairs.groupBy("label").agg(F.round(F.avg(tx.cosine(F.col("embedding"), F.col("other"))), 4).alias("mean_cosine"))


@query("fn_jaccard_of_turns", """select conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double, 6) as jaccard from (
    select conv_id, turn, list_distinct(string_split(lower(text), ' ')) as a, list_distinct(string_split(lower(lead(text) over (partition by conv_id order by turn)), ' ')) as b from conversations) where b is not null""")
def fn_jaccard(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    sets = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    rows = table(spark, d, "conversations").withColumn("other", F.lead("text").over(w)).where("other is not null")
    return rows.select("conv_id", "turn", F.round(tx.jaccard(sets(F.col("text")), sets(F.col("other"))), 6).alias("jaccard"))


@query("fn_token_f1")
def fn_token_f1(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("other", F.lead("text").over(w)).where("other is not null")
    return tx.token_f1(rows, ["conv_id", "turn"], "text", "other").withColumn("f1", F.round("f1", 6))


@query("fn_tf_idf_lengths", """select item_id, round(sum(w * w), 6) as squared from (select item_id, w / sqrt(sum(w * w) over (partition by item_id)) as w from (
    select item_id, tf * (ln(41.0 / (1 + count(*) over (partition by word))) + 1) as w from (
        select item_id, word, count(*) as tf from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as word from benchmark) group by 1, 2))) group by item_id""")
def fn_tf_idf(spark, d):
    weights = tx.tf_idf(table(spark, d, "benchmark"), "item_id", "text")
    return weights.groupBy("item_id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squared"))


@query("fn_label_edit_distance", sql("""select episode, levenshtein(string_agg(case when a then 'y' else 'n' end, '' order by frame), string_agg(case when p is null then 'u' when p then 'y' else 'n' end, '' order by frame))::int as distance from frames group by episode"""))
def fn_track_edit(spark, d):
    # two tracks of an episode over all of its frames
    label = lambda c: F.when(F.col(c).isNull(), "u").when(F.col(c), "y").otherwise("n")
    rows = frames(spark, d).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("frame", label("a").alias("a"), label("p").alias("p")))).alias("s"))
    return rows.select("episode", tx.edit_distance(F.col("s.a"), F.col("s.p")).alias("distance"))


def similar_sql(terms: str) -> str:
    return f"""with t as (select item_id, unnest({terms}) as word from benchmark), c as (select item_id, word, count(*) as tf from t group by 1, 2),
    w as (select item_id, word, tf * (ln((1 + (select count(*) from benchmark)) / (1 + count(*) over (partition by word))::double) + 1) as w from c),
    r as (select item_id, min(item_id) over (partition by bag) as rep from (select item_id, string_agg(word || chr(1) || tf, chr(2) order by word) as bag from c group by 1)),
    u as (select item_id, word, w / sqrt(sum(w * w) over (partition by item_id)) as w from w join r using (item_id) where item_id = rep)
    select x.item_id as "left", y.item_id as "right", round(sum(x.w * y.w), 6) as cosine from u x join u y on x.word = y.word and x.item_id < y.item_id group by 1, 2 having sum(x.w * y.w) >= 0.2
    union all select rep, item_id, 1.0::double from r where item_id > rep"""


@query("fn_similar_by_words", similar_sql("regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"))
def fn_similar_words(spark, d):
    return tx.similar_texts(table(spark, d, "benchmark"), "item_id", "text", 0.2).withColumn("cosine", F.round("cosine", 6))


@query("fn_similar_by_characters", similar_sql("""(select case when length(p) >= 4 then list_transform(range(1, length(p) - 2), lambda i: substring(p, i, 4)) when length(p) > 0 then [p] else [] end
    from (select trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as p))"""))
def fn_similar_characters(spark, d):
    return tx.similar_texts(table(spark, d, "benchmark"), "item_id", "text", 0.2, tx.char_grams).withColumn("cosine", F.round("cosine", 6))


@query("fn_label_edit_similarity", sql("""select episode, round(1 - levenshtein(x, y) / greatest(length(x), length(y))::double, 6) as similarity from (select episode,
    string_agg(case when a then 'y' else 'n' end, '' order by frame) as x, coalesce(string_agg(case when p then 'y' else 'n' end, '' order by frame) filter (p is not null), '') as y from frames group by episode)"""))
def fn_edit_similarity(spark, d):
    # a track against the known part of another: the lengths differ
    label = lambda c: F.when(F.col(c), "y").otherwise("n")
    track = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("frame", label(c).alias("l")))))["l"]
    rows = frames(spark, d).groupBy("episode").agg(track("a").alias("a"), track("p").alias("p"))
    return rows.select("episode", F.round(tx.edit_similarity(F.col("a"), F.col("p")), 6).alias("similarity"))


@query("ag34_text_statistics", """select doc_id, len(regexp_extract_all(text, '[^ ]+')) as words, len(regexp_extract_all(text, ' the ')) as the_count from documents""")
def ag34(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.regexp_count("text", F.lit("[^ ]+")).cast("long").alias("words"), F.regexp_count("text", F.lit(" the ")).cast("long").alias("the_count")
    )


@query("fn_sort_natural", """with names as (select p_partkey, 'file_0' || p_partkey || '_' || p_size || repeat('7', (p_partkey % 15)::int) as name from part), parts as (
        select p_partkey, name, p_partkey as a, (p_size || repeat('7', (p_partkey % 15)::int))::hugeint as b from names join part using (p_partkey))
    select x.p_partkey, x.name, x.b > y.b as after from parts x join parts y on y.p_partkey = x.p_partkey + 1""")
def fn_natural(spark, d):
    """Whether the last number of a name is larger than the next name's, by the keys of the two."""
    last = F.concat(F.col("p_size").cast("string"), F.expr("repeat('7', cast(p_partkey % 15 as int))"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("file_0"), "p_partkey", F.lit("_"), last).alias("name"), tx.natural_key(last).alias("key"))
    following = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("key").alias("_next"))
    return rows.join(following, "p_partkey").select("p_partkey", "name", (F.col("key") > F.col("_next")).alias("after"))


@query("src05_projected_scan", "select event_id, value > 100 or event_type = 'error' as contact from events where user_id = 7")
def src05(spark, d):
    rows = table(spark, d, "events").where("user_id = 7")
    return rows.select("event_id", ((F.col("value") > 100) | (F.col("event_type") == "error")).alias("contact"))


@query("src09_chunk_runs", sql('''select episode, frame, count(*) filter (new) over (partition by episode order by frame) as chunk from (
    select episode, frame, coalesce(lag(c) over (partition by episode order by frame) <> c, true) as new from frames)'''))
def src09(spark, d):
    w = Window.partitionBy("episode").orderBy("frame")
    new = F.coalesce(F.lag("c").over(w) != F.col("c"), F.lit(True))
    rows = frames(spark, d).withColumn("new", new)
    return rows.select("episode", "frame", F.count_if("new").over(w).alias("chunk"))


@query("src12_clock_checks", """select user_id, count(*) filter (ts <= was) as backward, count(*) as frames from (
    select user_id, ts, lag(ts) over (partition by user_id order by event_id) as was from events) group by user_id""")
def src12(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").withColumn("was", F.lag("ts").over(w))
    return rows.groupBy("user_id").agg(F.count_if(F.col("ts") <= F.col("was")).alias("backward"), F.count(F.lit(1)).alias("frames"))


@query("prj05_onset_supplied", sql("""select episode, frame from (select episode, frame, a and not coalesce(lag(a) over (partition by episode order by frame), false) as onset from frames) where onset and frame % 5 <> 0"""))
def prj05(spark, d):
    supplied = frames(spark, d).where("frame % 5 = 0").select("episode", "frame")
    onsets = positives(spark, d, "a").select("episode", F.col("start").alias("frame"))
    return onsets.join(supplied, ["episode", "frame"], "left_anti")


@query("prj07_disjoint_from_uncertain", sql('''select distinct x.episode, x."start" from runs_a x join runs_c u on u.episode = x.episode and u.state = 2 and u."start" < x."end" and x."start" < u."end" where x.state''', "a", "c"))
def prj07(spark, d):
    unsure = runs(spark, d, "c").where("state = 2")
    hit = tl.overlaps(positives(spark, d, "a"), unsure)
    return hit.select("episode", F.col("left_start").alias("start")).distinct()


@query("prj09_complete_annotations", sql('''select episode, n_frames = covered and touching as complete from (
    select episode, n_frames, sum("end" - "start") as covered, bool_and("start" = was) as touching from (
        select *, lag("end", 1, 0) over (partition by episode order by "start") as was from runs_p) join episodes using (episode) group by 1, 2)''', "p"))
def prj09(spark, d):
    w = Window.partitionBy("episode").orderBy("start")
    rows = runs(spark, d, "p").withColumn("was", F.lag("end", 1, 0).over(w)).join(episodes(spark, d).select("episode", "n_frames"), "episode")
    per = rows.groupBy("episode", "n_frames").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.every(F.col("start") == F.col("was")).alias("touching"))
    return per.select("episode", ((F.col("n_frames") == F.col("covered")) & F.col("touching")).alias("complete"))


@query("prj18_supported_details", sql('''select w.episode, w.s // 32 as "window", r."start", r."end" from (select episode, n_frames, unnest(generate_series(0, n_frames - 1, 32)) as s from episodes) w
    join runs_a r on r.episode = w.episode and r.state and r."start" < least(w.s + 32, n_frames) and r."end" > w.s and r."start" >= greatest(w.s - 8, 0) and r."end" <= least(w.s + 40, n_frames)''', "a"))
def prj18(spark, d):
    windows = tl.core_windows(episodes(spark, d), 32, 8).drop("lab", "fps", "n_frames")
    segments = positives(spark, d, "a").withColumn("citations", F.array(F.col("start"), F.col("end") - 1))
    return tl.supported_details(segments, windows)


#: Objects in lists in objects, as deep as the event's number says, with one identity inside another.
NESTED = """concat(repeat('{"x":[1,', event_id % 6), '{"dataset":"', event_type, '","episode_index":"', user_id, '","then":[{"dataset":null,"episode_index":', event_id, '},{"dataset":"no"}]}', repeat(']}', event_id % 6))"""


@query("prj24_nested_identities", f"""with recursive texts as (select event_id, {NESTED} as text from events), nodes(event_id, node) as (
        select event_id, text::json from texts
        union all
        select event_id, unnest(case when json_type(node) = 'ARRAY' then json_extract(node, '$[*]') else json_extract(node, '$.*') end) from nodes where json_type(node) in ('ARRAY', 'OBJECT')
    ) select event_id, json_extract_string(node, '$.dataset') as name, json_extract_string(node, '$.episode_index')::bigint as number from nodes
    where json_type(node) = 'OBJECT' and json_exists(node, '$.dataset') and json_exists(node, '$.episode_index')""")
def prj24(spark, d):
    """Identities at any depth, by a table function."""
    texts = table(spark, d, "events").select("event_id", F.expr(NESTED).alias("text"))
    found = tables.Identities(F.col("text").outer(), F.lit("dataset"), F.lit("episode_index"))
    return texts.lateralJoin(found).select("event_id", "name", "number")


@query("udtf_segment_frames", sql('select episode, frame from frames where a', "a"))
def udtf_frames(spark, d):
    """The frames of the positive segments of track a, by a table function."""
    segments = positives(spark, d, "a")
    return segments.lateralJoin(tables.SegmentFrames(F.col("start").outer(), F.col("end").outer())).select("episode", "frame")


@query("udtf_state_runs", sql("select * from runs_p", "p"))
def udtf_runs(spark, d):
    """Runs of a track with unknowns, by a polymorphic table function over each episode's sorted frames."""
    rows = frames(spark, d).select("episode", "frame", "p")
    return tables.StateRuns(rows.asTable(), F.lit("episode"), F.lit("p"))


@query("src09_episode_tree", """select event_type as dataset, user_id as episode, count(*) as frames, round(sum(value), 4) as total from events
    where event_type like 'p%' and user_id between 3 and 400 and value > 20 group by 1, 2""")
def src09_tree(spark, d):
    """A tree of episodes, written from the events and read through the data source with its filters pushed."""
    from ..sources import trees

    folder = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("episode"), "event_id", "value")
    trees.write_ranges(events, folder)
    rows = trees.episode_tree(spark, folder, "value").where(F.col("dataset").startswith("p") & (F.col("episode") >= 3) & (F.col("episode") <= 400) & (F.col("value") > 20))
    return rows.groupBy("dataset", "episode").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("value"), 4).alias("total"))


@query("src13_first_unfinished", """select event_type as dataset, count(distinct user_id) as episodes, min(user_id) filter (not done) as first_unfinished from (
    select event_type, user_id, max(value) over (partition by event_type, user_id) > 100 as done from events) group by 1""")
def src13(spark, d):
    """An episode is finished once a value of it is over 100."""
    from ..sources import trees

    rows = table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("episode"), "value")
    return trees.catalogue(rows, rows.where("value > 100"))


@query("ag37_fitted_threshold", """with x as (select doc_id, n_chars, toxic from documents join labels using (doc_id)), best as (
    select t.n_chars as threshold from (select distinct n_chars from x where doc_id % 2 = 0) t, x where x.doc_id % 2 = 0 group by t.n_chars
    order by 2 * count(*) filter (x.n_chars >= t.n_chars and toxic = 1) / (count(*) filter (x.n_chars >= t.n_chars) + count(*) filter (toxic = 1))::double desc, t.n_chars limit 1)
    select threshold, count(*) filter (n_chars >= threshold and toxic = 1) as tp, count(*) filter (n_chars >= threshold and toxic <> 1) as fp, count(*) filter (n_chars < threshold and toxic = 1) as fn
    from x, best where doc_id % 2 = 1 group by threshold""")
def ag37(spark, d):
    from ..operators import stats

    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").where("toxic is not null")
    best = stats.best_threshold(rows.where("doc_id % 2 = 0"), "n_chars", F.col("toxic") == 1).select("threshold")
    held = rows.where("doc_id % 2 = 1").crossJoin(F.broadcast(best))  # one row
    at, toxic = F.col("n_chars") >= F.col("threshold"), F.col("toxic") == 1
    return held.groupBy("threshold").agg(F.count_if(at & toxic).alias("tp"), F.count_if(at & ~toxic).alias("fp"), F.count_if(~at & toxic).alias("fn"))


@query("src14_tar_members", "select doc_id || '.txt' as name, cast(octet_length(encode(coalesce(text, ''))) as bigint) as length, sha256(coalesce(text, '')) as sha256, cast(null as varchar) as fault from documents")
def src14(spark, d):
    docs = table(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    packed = saved(tar_archives(docs, "name", "text", max(1, docs.count() // 1000)), "tar")
    members = tar_members(packed).select("name", "length", "sha256")
    manifest = docs.select("name", F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("sha256"))
    return members.join(tar_faults(members, manifest), "name", "full")


@query("snk03_replaced_table", "select o_orderkey, o_totalprice * 2 as price from orders")
def snk03(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    path = f"{shared_dir(spark)}/replaced-{uuid.uuid4().hex}"
    replace_table(orders, path)
    replace_table(read_current(spark, path).withColumn("price", F.col("price") * 2), path)
    return read_current(spark, path)
