"""The full annotation: values, spans in characters, and one text for each broken rule."""

from __future__ import annotations

from spanloom.functions import parsing

IDENTITY = """## Identity

- Requested object: cup
- Manipulated object: bowl
- Match status: differs
- Uncertainty: None

### Evidence

- Frame 3, camera left: a bowl – blue
  with a rim
"""
SEGMENT = """
## Segment {n}

- Frames: {a}–{b}
- Action ID: a{n}
- Action: lift
- Object: None
- Destination: shelf
- Failure: Yes
- Categories: grasp, other
- Recovery: None
- Severity: low
- Resetability: None
- Review required: No
- Uncertainty: None

### Observed result

fell

### Boundary reason

stop
- not a field

### What happened

slip

### Evidence

"""
TEXT = "# Episode: é1\n\n" + IDENTITY + SEGMENT.format(n=1, a=0, b=5) + SEGMENT.format(n=2, a=5, b=9)


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    return [r.x for r in parsing.full_annotations(rows, "text", "x").orderBy("i").collect()]


def test_values_and_spans(spark):
    plain, windows = read(spark, [TEXT, TEXT.replace("\n", "\r\n")])
    assert plain.error is None and windows.error is None
    value = plain.value
    assert (value.episode, value.identity.match_status, value.identity.uncertainty) == ("é1", "differs", "")
    assert [tuple(e) for e in value.identity.evidence] == [(3, "left", "a bowl – blue\nwith a rim")]
    assert [(s.start, s.end, s.action_id, s.object, s.destination, s.failure) for s in value.segments] == [
        (0, 5, "a1", None, "shelf", True), (5, 9, "a2", None, "shelf", True)]
    assert (value.segments[0].categories, value.segments[0].boundary_reason, value.segments[0].evidence) == (["grasp", "other"], "stop\n- not a field", [])
    cut = [TEXT[s.start : s.end] for s in value.spans]
    assert [c.split("\n")[0] for c in cut] == ["## Identity", "## Segment 1", "## Segment 2"]
    assert value.spans[-1].end == len(TEXT) and windows.value.spans[-1].end == len(TEXT.replace("\n", "\r\n"))
    assert windows.value.segments == value.segments


def test_each_rule(spark):
    once = lambda a, b: TEXT.replace(a, b, 1)
    broken = {
        "unfenced": ["```" + TEXT, None],
        "title": ["", TEXT[2:], once("## Identity", "prose\n## Identity")],
        "identity": ["# Episode: a\n", once("## Identity", "## Segment 1"), "# Episode: a\n" + IDENTITY],
        "numbering": [once("Segment 2", "Segment 3"), once("## Segment 1", "## Identity")],
        "bullets": [once("- Action: lift", "- Action: lift\nmore"), once("- Action: lift", "Action: lift")],
        "repeated": [once("- Action: lift", "- Action: lift\n- Action: lift")],
        "fields": [once("- Action: lift\n", ""), once("- Action: lift", "- Act: lift")],
        "subsections": [once("### What happened", "### What"), once("### Boundary reason", "### Observed result")],
        "evidence": [once("Frame 3, camera left", "Frame x, camera left")],
        "answers": [once("Failure: Yes", "Failure: maybe")],
        "frames": [once("0–5", "0 and 5")],
        "uncertain": [once("- Action: lift", "- Action: lift\n- Uncertain fields: weather"), once("- Action: lift", "- Action: lift\n- Uncertain fields: action, action")],
        "review": [once("- Action: lift", "- Action: lift\n- Uncertain fields: action")],
    }
    wanted = [rule for rule, texts in broken.items() for _ in texts]
    assert [x.error for x in read(spark, [t for texts in broken.values() for t in texts])] == wanted
    good = [once("Review required: No", "Review required: YES\n- Uncertain fields: action"), once("- Action: lift", "- Action: lift\n\n  and hold")]
    assert [x.error for x in read(spark, good)] == [None, None]


def test_annotation_texts_are_spread_and_their_parts_read_once(spark, sf, monkeypatch):
    from spanloom.plans import parsing_queries

    monkeypatch.setattr(parsing_queries, "ANNOTATIONS_A_TASK", 500)
    found = parsing_queries.prs05(spark, sf)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert found.rdd.getNumPartitions() == -(-n // 500) > 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?m)^(?=### )") == 1  # subsections are cut in one place
