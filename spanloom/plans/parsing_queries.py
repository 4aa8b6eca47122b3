"""Parser round trips and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as pr
from .binding import episodes, runs, sql, table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


def rendered(spark, d):
    """Each episode's track as a text, broken in a way that depends on the episode."""
    segment = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("state").alias("failure"))
    tracks = runs(spark, d, "a").groupBy("episode").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    text = pr.render_table(F.col("episode"), F.col("segments"))
    kind = F.col("episode") % 5
    broken = (
        F.when(kind == 1, F.regexp_replace(text, "# Episode", "# Run"))
        .when(kind == 2, F.concat(text, F.lit("\n| 1 | x | Yes |")))
        .when(kind == 3, F.concat(text, F.lit("\n| 900000 | 900001 | Yes |")))
        .otherwise(text)
    )
    return tracks.join(episodes(spark, d).select("episode", "n_frames"), "episode").withColumn("text", broken)


@query("prs01_prs06_table_round_trip", sql("""select episode, case episode % 5 when 1 then 'heading' when 2 then 'row' when 3 then 'boundaries' end as error,
    case when episode % 5 in (0, 4) then count(*) end as segments, case when episode % 5 in (0, 4) then sum(case when state then "end" - "start" else 0 end)::bigint end as positive
    from runs_a group by episode""", "a"))
def prs01(spark, d):
    parsed = pr.binary_table(F.col("text"), F.col("episode"), F.lit(0), F.col("n_frames").cast("int"))
    rows = rendered(spark, d).withColumn("p", parsed)
    positive = F.aggregate(
        "p.value", F.lit(0).cast("long"), lambda a, s: a + F.when(s["failure"], s["end"] - s["start"]).otherwise(0)
    )
    size = F.when(F.col("p.value").isNotNull(), F.size("p.value").cast("long"))
    return rows.select("episode", F.col("p.error").alias("error"), size.alias("segments"), positive.alias("positive"))


@query("prs02_core_prediction", sql("""select episode, case episode % 5 when 1 then 'heading' when 2 then 'row' when 3 then 'boundaries' end as error from episodes"""))
def prs02(spark, d):
    text = F.concat("text", F.lit("\n## Details\nfree text"))
    parsed = pr.binary_table(text, F.col("episode"), F.lit(0), F.col("n_frames").cast("int"), sections=True)
    return rendered(spark, d).select("episode", parsed["error"].alias("error"))


@query("prs04_rich_annotation", sql("""select episode, case episode % 4 when 1 then 'outcome' when 2 then 'grades' when 3 then 'frames' end as error from episodes where n_frames > 4"""))
def prs04(spark, d):
    n = F.col("n_frames").cast("int")
    kind = F.col("episode") % 4
    last = F.when(kind == 3, n - 1).otherwise(n).cast("string")
    text = F.concat(
        F.lit("# Episode: "), F.col("episode").cast("string"),
        F.lit("\n## Episode annotation\n- Language task: pick\n- Success label: "), F.when(kind == 1, "maybe").otherwise("failure"),
        F.lit("\n- Outcome evidence: frame 0 of top\n## Timeline\n| Start frame | End frame | Failure |\n| --- | --- | --- |\n| 0 | 2 | No |\n| 2 | "),
        n.cast("string"), F.lit(" | Yes |\n## Failure annotations\n### Failure 1\n- Frames: 2-"), last,
        F.lit("\n- Categories: grasp, collision\n- Explanation: frame 2 in top slips\n- Recovery: None\n- Severity: "),
        F.when(kind == 2, "awful").otherwise("low"), F.lit("\n- Severity evidence: x\n- Resetability: immediate\n- Resetability evidence: y\n"),
    )
    parsed = pr.rich_annotation(text, F.col("episode"), F.lit(0), n, F.sequence(F.lit(0), n - 1), F.array(F.lit("top")))
    return episodes(spark, d).where("n_frames > 4").select("episode", parsed["error"].alias("error"))


@query("prs10_lenient_json", """select event_id, case when event_id % 3 = 0 then 0 when event_id % 3 = 1 then 1 end as usable from events""")
def prs10(spark, d):
    k = F.col("event_id").cast("string")
    bad = F.concat(F.lit('```json\n{"segments": [{"start_frame": true, "end_frame": '), k, F.lit("}]}\n```"))
    good = F.concat(F.lit('x {"segments": [{"start_frame": 1, "end_frame": '), k, F.lit("}]} y"))
    text = F.when(F.col("event_id") % 3 == 0, bad).when(F.col("event_id") % 3 == 1, good).otherwise("no json")
    found = pr.usable_segments(pr.lenient_json(text))
    return table(spark, d, "events").select("event_id", F.when(found.isNotNull(), F.size(found)).alias("usable"))


@query("prs12_rubric_answers", """select event_id, round(case when event_id % 2 = 0 then value + 1 end, 4) as total from events""")
def prs12(spark, d):
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("why ANSWER: [1, "), F.col("value").cast("string"), F.lit("]"))).otherwise("none")
    scores = pr.rubric_scores(answer)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "events").select("event_id", F.round(total, 4).alias("total"))


@query("prs07_closed_intervals", """select event_id, event_id::int as "start", (event_id + 5 + event_id % 2)::int as "end", event_id % 2 = 1 as warning from events""")
def prs07(spark, d):
    k = F.col("event_id")
    closing = F.when(k % 2 == 1, "]").otherwise(")")
    text = F.concat(F.lit("- **Interval**: ["), k.cast("string"), F.lit(", "), (k + 5).cast("string"), closing, F.lit(" then frame 3"))
    found = F.element_at(pr.intervals_of_prose(text), 1)
    return table(spark, d, "events").select("event_id", found["start"].alias("start"), found["end"].alias("end"), found["warning"].alias("warning"))


@query("prs14_timed_cues", """select event_id, ((event_id % 50) * 60 + event_id % 60)::int as first_s, 2 as cues from events""")
def prs14(spark, d):
    k = F.col("event_id")
    stamp = F.format_string("at %d:%02d, then 59:59 and 1:2:3", (k % 50).cast("int"), (k % 60).cast("int"))
    times = pr.cue_times(stamp)
    return table(spark, d, "events").select("event_id", F.element_at(times, 1).alias("first_s"), F.size(times).alias("cues"))


@query("prs14_cue_intervals", """select event_id, ts, coalesce(min(ts) over (partition by user_id order by ts range between interval 1 microsecond following and unbounded following), timestamp '2100-01-01') as until from events""")
def prs14_intervals(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("following", F.lead("ts").over(w))  # times are unique within a user
    return rows.select("event_id", "ts", F.coalesce("following", F.lit("2100-01-01").cast("timestamp_ntz")).alias("until"))


@query("prs03_failure_annotations", sql("""select episode, case episode % 4 when 1 then 'categories' when 2 then 'frames' when 3 then 'explanation' end as error from episodes where n_frames > 4"""))
def prs03(spark, d):
    n, kind = F.col("n_frames").cast("int"), F.col("episode") % 4
    text = F.concat(
        F.lit("# Episode: "), F.col("episode").cast("string"),
        F.lit("\n| Start frame | End frame | Failure |\n|---|---|---|\n| 0 | 2 | No |\n| 2 | "), n.cast("string"),
        F.lit(" | Yes |\n## Failure annotations\n### Failure 1\n- Frames: 2 to "), F.when(kind == 2, n - 1).otherwise(n).cast("string"),
        F.lit("\n- Categories: "), F.when(kind == 1, "grasp, Unclear").otherwise("grasp"),
        F.lit("\n- Explanation: in top, "), F.when(kind == 3, "late").otherwise("frame 2"), F.lit(" slips\n"),
    )
    parsed = pr.failure_annotations(text, F.col("episode"), n, F.array(F.lit("top")))
    return episodes(spark, d).where("n_frames > 4").select("episode", parsed["error"].alias("error"))


@query("prs08_selections", """select event_id, case event_id % 4 when 1 then 'count' when 2 then 'order' when 3 then 'membership' end as error from events""")
def prs08(spark, d):
    kind = F.col("event_id") % 4
    text = F.when(kind == 1, "0, 5").when(kind == 2, "5, 0, 10").when(kind == 3, "0, 5, 11").otherwise("0, 5, 10")
    parsed = pr.selection(text, F.sequence(F.lit(0), F.lit(100), F.lit(5)), 3)
    return table(spark, d, "events").select("event_id", parsed["error"].alias("error"))


@query("prs11_reference_index", """select doc_id, source as id, sha256(text) as sha256 from documents""")
def prs11(spark, d):
    text = F.concat(F.lit("# Index\n"), F.col("source"), F.lit(": a.json, "), F.sha2("text", 256), F.lit("\nbroken line"))
    entry = F.element_at(pr.index_entries(text), 1)
    return table(spark, d, "documents").select("doc_id", entry["id"].alias("id"), entry["sha256"].alias("sha256"))


@query("prs13_response_text", """select conv_id, turn, text, role = 'user' as complete from conversations""")
def prs13(spark, d):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    half = (F.length("text") / 2).cast("int")
    parts = F.array(part("thinking", F.lit("x")), part("text", F.substring("text", F.lit(1), half)), part("text", F.substring("text", half + 1, F.length("text"))))
    status = F.when(F.col("role") == "user", "complete").otherwise("cut")
    answer = pr.response_text(F.to_json(F.struct(status.alias("status"), parts.alias("content"))))
    return table(spark, d, "conversations").select("conv_id", "turn", answer["text"].alias("text"), answer["complete"].alias("complete"))


ANNOTATION = """# Episode: {id}

## Identity

- Requested object: cup
- Manipulated object: bowl
- Match status: differs
- Uncertainty: None

### Evidence

- Frame {n}, camera left: a bowl
  with a rim

## Segment 1

- Frames: 0–{n}
- Action ID: a1
- Action: lift
- Object: None
- Destination: shelf
- Failure: {failure}
- Categories: grasp, other
- Recovery: None
- Severity: low
- Resetability: None
- Review required: No
- Uncertainty: None

### Observed result

{status}

### Boundary reason

stop

### What happened

slip

### Evidence

- Frame 0, camera left: {status}
"""


#: Texts of annotations that a task reads.
ANNOTATIONS_A_TASK = 100_000


@query("prs05_full_annotation", f"""with texts as (select o_orderkey as id, o_custkey % 90 + 1 as n, o_orderstatus as s,
        replace(replace(replace(replace('{ANNOTATION}', '{{id}}', o_orderkey::varchar), '{{n}}', (o_custkey % 90 + 1)::varchar),
            '{{failure}}', case o_orderstatus when 'P' then 'perhaps' when 'F' then 'Yes' else 'No' end), '{{status}}', o_orderpriority) as t, o_orderpriority as p from orders)
    select id, case when s = 'P' then 'answers' end as error, case when s <> 'P' then n end as "end", case when s <> 'P' then s = 'F' end as failure,
        case when s <> 'P' then p end as observed, case when s <> 'P' then position('## Segment 1' in t) - 1 end as segment_start, case when s <> 'P' then length(t) end as segment_end from texts""")
def prs05(spark, d):
    text = F.lit(ANNOTATION)
    status = F.when(F.col("o_orderstatus") == "P", "perhaps").when(F.col("o_orderstatus") == "F", "Yes").otherwise("No")
    filled = {"id": F.col("o_orderkey").cast("string"), "n": (F.col("o_custkey") % 90 + 1).cast("string"), "failure": status, "status": F.col("o_orderpriority")}
    for name, value in filled.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    orders = orders.repartition(max(1, -(-orders.count() // ANNOTATIONS_A_TASK)))  # a file's few bytes are many texts
    read = pr.full_annotations(orders.select(F.col("o_orderkey").alias("id"), text.alias("text")), "text", "x")
    first, span = F.get("x.value.segments", F.lit(0)), F.get("x.value.spans", F.lit(1))
    return read.select("id", "x.error", first["end"].alias("end"), first["failure"].alias("failure"), first["observed_result"].alias("observed"),
        span["start"].alias("segment_start"), span["end"].alias("segment_end"))
