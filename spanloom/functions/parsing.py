"""Strict readers of annotation texts, as column expressions.

Each returns a struct (value, error): the first broken rule's name, or a value.
Nothing is repaired; a text that breaks a rule has no value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "| Start frame | End frame | Failure |"
SEPARATOR = r"^\|(\s*:?-+:?\s*\|){3}$"
ROW = r"^\|\s*(\d{1,9})\s*\|\s*(\d{1,9})\s*\|\s*(Yes|No)\s*\|$"
#: Fixed values of the rich format.
CATEGORIES = (
    "reaching", "grasp", "manipulation", "sequencing_semantic", "collision", "task_not_attempted",
    "sudden_episode_termination", "visible_hardware_issue", "other",
)
OUTCOMES = ("success", "failure", "success but suboptimal", "success but side effects")
SEVERITIES = ("low", "medium", "catastrophic")
RESETABILITIES = ("immediate", "minor_reset", "hard_reset", "unresettable")
FAILURE_FIELDS = (
    "Frames", "Categories", "Explanation", "Recovery", "Severity", "Severity evidence", "Resetability",
    "Resetability evidence",
)


def lines_of(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def checked(value: Column, rules: dict[str, Column]) -> Column:
    """(value, error): the first rule that isn't true is the error."""
    error = reduce(lambda c, kv: c.when(~F.coalesce(kv[1], F.lit(False)), F.lit(kv[0])), rules.items(), F)
    error = error.otherwise(F.lit(None))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def _rows(lines: Column) -> Column:
    """Table rows as structs; null where a line is no row."""
    part = lambda x, g: F.regexp_extract(x, ROW, g)
    return F.transform(
        lines,
        lambda x: F.when(
            x.rlike(ROW),
            F.struct(part(x, 1).cast("int").alias("start"), part(x, 2).cast("int").alias("end"), (part(x, 3) == "Yes").alias("failure")),
        ),
    )


def table_rules(lines: Column, start: Column, end: Column, *, adjacent_yes: bool) -> tuple[Column, dict[str, Column]]:
    """Segments of the lines behind header and separator, and the rules of a partition."""
    rows = _rows(lines)
    size = F.size(rows)
    before = F.slice(rows, 1, F.greatest(size - 1, F.lit(0)))
    after = F.slice(rows, 2, F.greatest(size - 1, F.lit(0)))
    pairs = F.arrays_zip(before.alias("x"), after.alias("y"))
    equal = lambda p: (p["x"]["failure"] == p["y"]["failure"]) & (~p["x"]["failure"] if adjacent_yes else F.lit(True))
    return rows, {
        "row": (size > 0) & F.forall(rows, lambda r: r.isNotNull()),
        "boundaries": F.forall(rows, lambda r: (r["start"] < r["end"]) & (r["end"] <= end)),
        "contiguity": (F.element_at(rows, 1)["start"] == start) & F.forall(pairs, lambda p: p["x"]["end"] == p["y"]["start"]),
        "merge": ~F.exists(pairs, equal),
        "coverage": F.element_at(rows, -1)["end"] == end,
    }


def binary_table(text: Column, episode: Column, start: Column, end: Column, *, sections: bool = False) -> Column:
    """A heading and a table that partitions [start, end); with ``sections``, the table ends
    at the first '## ' line, as in predictions."""
    lines = lines_of(text)
    if sections:
        marks = F.transform(lines, lambda x: x.startswith("## "))
        at = F.array_position(marks, F.lit(True))
        lines = F.when(at > 0, F.slice(lines, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines)
    body = F.slice(lines, 4, F.greatest(F.size(lines), F.lit(1)))
    rows, rules = table_rules(body, start, end, adjacent_yes=False)
    head = {
        "heading": F.get(lines, F.lit(0)) == F.concat(F.lit("# Episode: "), episode.cast("string")),
        "columns": (F.get(lines, F.lit(1)) == HEADER) & F.get(lines, F.lit(2)).rlike(SEPARATOR),
    }
    return checked(rows, head | rules)


def render_table(episode: Column, segments: Column) -> Column:
    """The text that binary_table reads, of an array of (start, end, failure)."""
    row = lambda s: F.concat(
        F.lit("| "), s["start"].cast("string"), F.lit(" | "), s["end"].cast("string"), F.lit(" | "),
        F.when(s["failure"], "Yes").otherwise("No"), F.lit(" |"),
    )
    head = F.concat(F.lit("# Episode: "), episode.cast("string"), F.lit(f"\n\n{HEADER}\n| --- | --- | --- |\n"))
    return F.concat(head, F.array_join(F.transform(segments, row), "\n"))


def _field(block: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(block, rf"(?m)^- {name}: (.+)$", 1))


def _blocks(details: Column) -> Column:
    """Failure blocks: number, the lines' field names in order, and the fields."""
    parts = F.split(details, r"(?m)^### Failure (?=\d+\s*$)")
    blocks = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    named = lambda b, n: _field(b, n).alias(n.lower().replace(" ", "_"))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, r"^(\d+)", 1).cast("int").alias("number"),
            F.regexp_extract_all(b, F.lit(r"(?m)^- ([A-Z][A-Za-z ]*): "), F.lit(1)).alias("names"),
            (F.size(lines_of(b)) - 1).alias("lines"),
            *(named(b, n) for n in FAILURE_FIELDS),
        ),
    )


def cited_frames(text: Column) -> Column:
    """Numbers behind 'frame' or 'frames'."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\bframes?\s+(\d{1,9})"), F.lit(1))
    return F.transform(found, lambda x: x.cast("int"))


def rich_annotation(text: Column, episode: Column, start: Column, end: Column, frames: Column, cameras: Column) -> Column:
    """Outcome, timeline and one numbered eight-field block for each Yes row.

    frames and cameras: those that evidence may cite.
    """
    parts = F.split(text, r"(?m)^## (?:Episode annotation|Timeline|Failure annotations)\s*$")
    names = F.regexp_extract_all(text, F.lit(r"(?m)^## (Episode annotation|Timeline|Failure annotations)\s*$"), F.lit(1))
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    outcome, evidence = _field(part(1), "Success label"), _field(part(1), "Outcome evidence")
    table = lines_of(part(2))
    rows, rules = table_rules(F.slice(table, 3, F.greatest(F.size(table), F.lit(1))), start, end, adjacent_yes=True)
    blocks = _blocks(part(3))
    yes = F.filter(rows, lambda r: r["failure"])
    cites = lambda t: (
        (F.size(cited_frames(t)) > 0)
        & (F.size(F.array_except(cited_frames(t), frames)) == 0)
        & F.exists(cameras, lambda c: F.concat(F.lit(" "), F.regexp_replace(t, r"[^\w]", " "), F.lit(" ")).contains(F.concat(F.lit(" "), c, F.lit(" "))))
    )
    zipped = F.zip_with(blocks, yes, lambda b, s: F.struct(b.alias("b"), s.alias("s")))
    bounds = lambda z: z["b"]["frames"].rlike(r"^\d{1,9}\s*[-–]\s*\d{1,9}$") & (
        F.regexp_replace(z["b"]["frames"], r"\s*[-–]\s*", "-")
        == F.concat_ws("-", z["s"]["start"].cast("string"), z["s"]["end"].cast("string"))
    )
    categories = lambda b: F.transform(F.split(b["categories"], ","), lambda c: F.trim(c))
    known = lambda c: (F.size(F.array_except(c, F.array(*map(F.lit, CATEGORIES)))) == 0) & (F.size(F.array_distinct(c)) == F.size(c))
    numbers = F.transform(blocks, lambda b: b["number"])
    value = F.struct(
        episode.alias("episode"), _field(part(1), "Language task").alias("task"), outcome.alias("outcome"),
        evidence.alias("evidence"), rows.alias("segments"), blocks.alias("failures"),
    )
    return checked(
        value,
        {
            "heading": stripped(part(0)) == F.concat(F.lit("# Episode: "), episode.cast("string")),
            "sections": (F.size(parts) == 4) & (F.concat_ws(",", names) == "Episode annotation,Timeline,Failure annotations"),
            "outcome": outcome.isin(*OUTCOMES) & (F.size(lines_of(part(1))) == 3),
            "outcome_evidence": cites(evidence),
            "columns": (F.get(table, F.lit(0)) == HEADER) & F.get(table, F.lit(1)).rlike(SEPARATOR),
            **rules,
            "none": (F.size(yes) > 0) | (stripped(part(3)) == "None"),
            "numbering": (F.size(blocks) == F.size(yes))
            & ((F.size(yes) == 0) | (numbers == F.sequence(F.lit(1), F.greatest(F.size(yes), F.lit(1))))),
            "fields": F.forall(blocks, lambda b: (F.concat_ws(",", b["names"]) == ",".join(FAILURE_FIELDS)) & (b["lines"] == len(FAILURE_FIELDS))),
            "frames": F.forall(zipped, bounds),
            "categories": F.forall(blocks, lambda b: (b["categories"] == "Unclear") | known(categories(b))),
            "grades": F.forall(blocks, lambda b: b["severity"].isin(*SEVERITIES) & b["resetability"].isin(*RESETABILITIES)),
            "explanation_evidence": F.forall(blocks, lambda b: cites(b["explanation"])),
            "clean_success": ~((outcome == "success") & (F.size(yes) > 0)),
            "qualified_success": ~(outcome.startswith("success but") & (F.size(yes) == 0)),
        },
    )


def lenient_json(text: Column) -> Column:
    """The outermost {...} of an answer, without code fences, as a variant; null if unreadable."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))


def usable_segments(answer: Column) -> Column:
    """Segments with whole-number bounds, of an answer that may break the schema otherwise."""
    whole = lambda s, k: F.schema_of_variant(F.try_variant_get(s, f"$.{k}", "variant")) == "BIGINT"
    found = F.try_variant_get(answer, "$.segments", "array<variant>")
    good = F.filter(found, lambda s: F.coalesce(whole(s, "start_frame") & whole(s, "end_frame"), F.lit(False)))
    at = lambda s, k: F.try_variant_get(s, f"$.{k}", "bigint")
    return F.transform(good, lambda s: F.struct(at(s, "start_frame").alias("start"), at(s, "end_frame").alias("end")))


def rubric_scores(answer: Column) -> Column:
    """Numbers of the list behind the last 'ANSWER:'."""
    return F.from_json(F.regexp_extract(answer, r"(?s).*ANSWER:\s*(\[[^\]]*\])", 1), "array<double>")


def intervals_of_prose(text: Column) -> Column:
    """'Interval: [a, b)' statements; a closed [a, b] is read as [a, b + 1) and marked."""
    pattern = r"(?i)Interval(?:\*\*)?\s*:(?:\*\*)?\s*(\[\s*\d{1,9}\s*,\s*\d{1,9}\s*[)\]])"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    number = lambda x, i: F.element_at(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), i).cast("int")
    closed = lambda x: x.endswith("]")
    return F.transform(
        found,
        lambda x: F.struct(number(x, 1).alias("start"), (number(x, 2) + closed(x).cast("int")).alias("end"), closed(x).alias("warning")),
    )


def cue_times(text: Column) -> Column:
    """Seconds of the m:ss times of a line, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d:])(\d{1,2}:[0-5]\d)(?![\d]|:\d)"), F.lit(1))
    return F.transform(found, lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(x, F.lit(":"), F.lit(2)).cast("int"))


def failure_annotations(text: Column, episode: Column, end: Column, cameras: Column) -> Column:
    """A binary table from frame 0, and one Frames/Categories/Explanation block for each Yes row."""
    parts = F.split(text, r"(?m)^## Failure annotations\s*$")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    lines = lines_of(part(0))
    rows, rules = table_rules(F.slice(lines, 4, F.greatest(F.size(lines), F.lit(1))), F.lit(0), end, adjacent_yes=False)
    blocks = _blocks(part(1))
    yes = F.filter(rows, lambda r: r["failure"])
    zipped = F.zip_with(blocks, yes, lambda b, s: F.struct(b.alias("b"), s.alias("s")))
    bounds = lambda z: F.regexp_replace(z["b"]["frames"], r"\s*(?:[-–]|to)\s*", "-") == F.concat_ws(
        "-", z["s"]["start"].cast("string"), z["s"]["end"].cast("string")
    )
    categories = lambda b: F.transform(F.split(b["categories"], ","), lambda c: F.trim(c))
    known = lambda c: (F.size(F.array_except(c, F.array(*map(F.lit, CATEGORIES)))) == 0) & (F.size(F.array_distinct(c)) == F.size(c))
    cited = lambda t: (
        (F.size(cited_frames(t)) > 0)
        & F.forall(cited_frames(t), lambda f: f < end)
        & F.exists(cameras, lambda c: F.concat(F.lit(" "), F.regexp_replace(t, r"[^\w]", " "), F.lit(" ")).contains(F.concat(F.lit(" "), c, F.lit(" "))))
    )
    numbers = F.transform(blocks, lambda b: b["number"])
    head = {
        "sections": F.size(parts) == 2,
        "heading": F.get(lines, F.lit(0)) == F.concat(F.lit("# Episode: "), episode.cast("string")),
        "columns": (F.get(lines, F.lit(1)) == HEADER) & F.get(lines, F.lit(2)).rlike(SEPARATOR),
    }
    tail = {
        "none": (F.size(yes) > 0) | (stripped(part(1)) == "None"),
        "numbering": (F.size(blocks) == F.size(yes))
        & ((F.size(yes) == 0) | (numbers == F.sequence(F.lit(1), F.greatest(F.size(yes), F.lit(1))))),
        "fields": F.forall(blocks, lambda b: F.concat_ws(",", b["names"]) == "Frames,Categories,Explanation"),
        "frames": F.forall(zipped, bounds),
        "categories": F.forall(blocks, lambda b: (b["categories"] == "Unclear") | known(categories(b))),
        "explanation": F.forall(blocks, lambda b: cited(b["explanation"])),
    }
    return checked(F.struct(rows.alias("segments"), blocks.alias("failures")), head | rules | tail)


def selection(text: Column, allowed: Column, count: int) -> Column:
    """A list of ``count`` distinct allowed frames in ascending order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("int"))
    return checked(
        found,
        {
            "count": F.size(found) == count,
            "distinct": F.size(F.array_distinct(found)) == F.size(found),
            "order": found == F.array_sort(found),
            "membership": F.size(F.array_except(found, allowed)) == 0,
        },
    )


def index_entries(text: Column) -> Column:
    """'id: file, sha' lines as structs."""
    pattern = r"^([^:\s]+):\s*([^,\s]+),\s*([0-9a-f]{64})$"
    entry = lambda x: F.struct(*(F.regexp_extract(x, pattern, i).alias(n) for i, n in ((1, "id"), (2, "file"), (3, "sha256"))))
    return F.transform(F.filter(lines_of(text), lambda x: x.rlike(pattern)), entry)


def response_text(response: Column) -> Column:
    """(text, complete) of a provider's JSON answer: its text parts joined, and whether it ended."""
    parsed = F.from_json(response, "status string, content array<struct<type string, text string>>")
    parts = F.filter(parsed["content"], lambda c: c["type"] == "text")
    return F.struct(
        F.array_join(F.transform(parts, lambda c: c["text"]), "").alias("text"), (parsed["status"] == "complete").alias("complete")
    )


#: Fixed values of the full annotation: names of fields and subsections.
IDENTITY_FIELDS = ("Requested object", "Manipulated object", "Match status", "Uncertainty")
SEGMENT_FIELDS = (
    "Frames", "Action ID", "Action", "Object", "Destination", "Failure", "Categories", "Recovery", "Severity", "Resetability",
    "Review required", "Uncertainty",
)
SUBSECTIONS = ("Observed result", "Boundary reason", "What happened", "Evidence")
UNCERTAIN_FIELDS = (
    "timing", "action", "identity", "failure", "categories", "outcome", "mechanism", "recovery", "severity", "resetability",
)
BULLET = r"(?m)^- ([^:\n]+): ([^\n]*(?:\n  [^\n]*)*)$"
SPAN = r"^(\d{1,9})\s*(?:–|-|to)\s*(\d{1,9})$"


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _dense(block: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(block, r"(?m)^[ \t]*\n", ""), r"\n+[ \t]*$", "")


def _bullets(dense: Column) -> Column:
    """Names and values of '- name: value' lines; indented lines go on with a value.  ``rest`` is what
    is no such line."""
    return F.struct(
        F.regexp_extract_all(dense, F.lit(BULLET), F.lit(1)).alias("names"),
        F.transform(F.regexp_extract_all(dense, F.lit(BULLET), F.lit(2)), lambda v: F.replace(v, F.lit("\n  "), F.lit("\n"))).alias("values"),
        F.length(F.trim(F.regexp_replace(F.regexp_replace(dense, BULLET, ""), "\n", ""))).alias("rest"),
    )


def _sections(blocks: Column) -> Column:
    """Sections behind their heading lines: their bullets, subsections by name, and evidence.

    Each step is a transform of its own: a lambda's argument is evaluated once, an expression in its body
    as often as it stands there.
    """
    head = lambda p: F.regexp_extract(p, r"^### ([^\n]+?)[ \t]*(?:\n|$)", 1)
    body = lambda p: F.regexp_replace(F.regexp_replace(p, r"^### [^\n]*\n*", ""), r"\n+$", "")
    named = lambda parts: F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    evidence = lambda s: F.get(s["bodies"], (F.array_position(s["heads"], "Evidence") - 1).cast("int"))
    cut = F.transform(blocks, lambda b: F.split(b, r"(?m)^(?=### )"))
    cut = F.transform(cut, lambda parts: F.struct(F.get(parts, F.lit(0)).alias("top"), named(parts).alias("named")))
    cut = F.transform(cut, lambda s: F.struct(s["top"].alias("top"), F.transform(s["named"], head).alias("heads"), F.transform(s["named"], body).alias("bodies")))
    cut = F.transform(cut, lambda s: F.struct(_dense(s["top"]).alias("top"), s["heads"].alias("heads"), s["bodies"].alias("bodies"), _dense(F.coalesce(evidence(s), F.lit(""))).alias("proof")))
    return F.transform(cut, lambda s: F.struct(_bullets(s["top"]).alias("fields"), s["heads"].alias("heads"), s["bodies"].alias("bodies"), _bullets(s["proof"]).alias("evidence")))


def _value(section: Column, name: str) -> Column:
    fields = section["fields"]
    return F.get(fields["values"], (F.array_position(fields["names"], name) - 1).cast("int"))


def _list(value: Column) -> Column:
    return F.when(value == "None", F.array().cast("array<string>")).otherwise(F.transform(F.split(value, ","), lambda x: F.trim(x)))


def _evidence(section: Column) -> Column:
    place = r"^Frame (\d{1,9}), camera (.+)$"
    return F.zip_with(
        section["evidence"]["names"], section["evidence"]["values"],
        lambda n, v: F.struct(
            F.regexp_extract(n, place, 1).try_cast("int").alias("frame"), F.regexp_extract(n, place, 2).alias("camera"), v.alias("observation")
        ),
    )


def full_annotations(rows: DataFrame, text: str, name: str = "annotation") -> DataFrame:
    """Adds ``name``, a (value, error) of the texts: an episode's title, an identity section and numbered segments, each with its fields, subsections
    and evidence, and the span of each section in characters of the text.

    Fields are in any order, each once; unknown and missing ones, prose between fields and fenced
    texts are errors.  'None' is null where a field may have no value.  Null has the error 'unfenced',
    as has a text with a fence.  Numbers have at most nine digits.  The sections are read in a column of
    their own, once for each text, as all values and rules refer to them.
    """
    unix = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    marks = r"(?m)^(?=## (?:Identity|Segment \d{1,9})[ \t]*\r?$)"
    cut = rows.withColumn("_parts", F.split(unix, marks))
    cut = cut.withColumn("_lengths", F.transform(F.split(text, marks), lambda p: F.length(p)))
    parts, lengths = F.col("_parts"), F.col("_lengths")
    sections = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    heads = F.transform(sections, lambda s: F.regexp_extract(s, r"^## (Identity|Segment \d{1,9})", 1))
    cut = cut.withColumn("_heads", heads)
    cut = cut.withColumn("_read", _sections(F.transform(sections, lambda s: F.regexp_replace(s, r"^## [^\n]*(?:\n|$)", ""))))
    heads, read, title = F.col("_heads"), F.col("_read"), F.get(parts, F.lit(0))
    identity = F.get(read, F.lit(0))
    segments = F.slice(read, 2, F.greatest(F.size(read), F.lit(1)))
    each = lambda rule: F.forall(segments, rule)
    same = lambda found, wanted: F.sort_array(found) == F.sort_array(wanted)
    optional = lambda s: F.array_union(_texts(SEGMENT_FIELDS), F.array_intersect(s["fields"]["names"], _texts(("Uncertain fields",))))
    yes = lambda s, n: F.lower(_value(s, n)) == "yes"
    uncertain = lambda s: F.coalesce(_list(_value(s, "Uncertain fields")), F.array().cast("array<string>"))
    none = lambda s, n: F.nullif(_value(s, n), F.lit("None"))
    body = lambda s, n: F.get(s["bodies"], (F.array_position(s["heads"], n) - 1).cast("int"))
    bound = lambda s, i: F.regexp_extract(_value(s, "Frames"), SPAN, i).try_cast("int")
    segment = lambda s: F.struct(
        bound(s, 1).alias("start"), bound(s, 2).alias("end"), _value(s, "Action ID").alias("action_id"), _value(s, "Action").alias("action"),
        none(s, "Object").alias("object"), none(s, "Destination").alias("destination"), yes(s, "Failure").alias("failure"),
        _list(_value(s, "Categories")).alias("categories"), none(s, "Recovery").alias("recovery"), none(s, "Severity").alias("severity"),
        none(s, "Resetability").alias("resetability"), yes(s, "Review required").alias("review_required"),
        F.coalesce(none(s, "Uncertainty"), F.lit("")).alias("uncertainty"), uncertain(s).alias("uncertain_fields"),
        body(s, "Observed result").alias("observed_result"), body(s, "Boundary reason").alias("boundary_reason"),
        body(s, "What happened").alias("what_happened"), _evidence(s).alias("evidence"),
    )
    until = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n)
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths) - 1, F.lit(1))), lambda i: F.struct(until(i).alias("start"), until(i + 1).alias("end")))
    value = F.struct(
        F.regexp_extract(title, r"^# Episode: ([^\n]+)\n", 1).alias("episode"),
        F.struct(
            *(_value(identity, n).alias(n.lower().replace(" ", "_")) for n in IDENTITY_FIELDS[:3]),
            F.coalesce(none(identity, "Uncertainty"), F.lit("")).alias("uncertainty"), _evidence(identity).alias("evidence"),
        ).alias("identity"),
        F.transform(segments, segment).alias("segments"), spans.alias("spans"),
    )
    numbers = F.transform(F.slice(heads, 2, F.greatest(F.size(heads), F.lit(1))), lambda h: F.regexp_extract(h, r"(\d+)", 1).try_cast("int"))
    error = checked(
        F.lit(True),
        {
            "unfenced": ~F.col(text).contains("```"),
            "title": title.rlike(r"^# Episode: [^\n]+\n\s*$"),
            "identity": (F.size(sections) >= 2) & (F.get(heads, F.lit(0)) == "Identity"),
            "numbering": numbers == F.sequence(F.lit(1), F.greatest(F.size(sections) - 1, F.lit(1))),
            "bullets": F.forall(read, lambda s: (s["fields"]["rest"] == 0) & (s["evidence"]["rest"] == 0)),
            "repeated": F.forall(read, lambda s: (F.size(F.array_distinct(s["fields"]["names"])) == F.size(s["fields"]["names"]))
                & (F.size(F.array_distinct(s["evidence"]["names"])) == F.size(s["evidence"]["names"]))),
            "fields": same(identity["fields"]["names"], _texts(IDENTITY_FIELDS)) & each(lambda s: same(s["fields"]["names"], optional(s))),
            "subsections": (identity["heads"] == _texts(("Evidence",))) & each(lambda s: same(s["heads"], _texts(SUBSECTIONS))),
            "evidence": F.forall(read, lambda s: F.forall(s["evidence"]["names"], lambda n: n.rlike(r"^Frame \d{1,9}, camera .+$"))),
            "answers": each(lambda s: F.lower(_value(s, "Failure")).isin("yes", "no") & F.lower(_value(s, "Review required")).isin("yes", "no")),
            "frames": each(lambda s: _value(s, "Frames").rlike(SPAN)),
            "uncertain": each(lambda s: (F.size(F.array_except(uncertain(s), _texts(UNCERTAIN_FIELDS))) == 0) & (F.size(F.array_distinct(uncertain(s))) == F.size(uncertain(s)))),
            "review": each(lambda s: ~F.array_contains(s["fields"]["names"], "Uncertain fields") | (yes(s, "Review required") == (F.size(uncertain(s)) > 0))),
        },
    )
    cut = cut.withColumn("_error", error["error"])
    result = F.struct(F.when(F.col("_error").isNull(), value).alias("value"), F.col("_error").alias("error"))
    return cut.withColumn(name, result).drop("_parts", "_lengths", "_heads", "_read", "_error")
