"""Published expectations and properties that SQL doesn't cover."""

from __future__ import annotations

import random
import struct
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import parsing, text
from spanloom.operators import agreement, matching, sampling, timeline
from spanloom.sources import media, tables


def segments(spark, rows):
    return spark.createDataFrame(rows, "episode long, start long, end long, state boolean")


@pytest.mark.parametrize("n", [1, 31, 32, 33, 193, 1500])
@pytest.mark.parametrize(("core", "context"), [(16, 8), (32, 8), (32, 16)])
def test_each_frame_is_in_one_core(spark, n, core, context):
    episodes = spark.createDataFrame([(1, n)], "episode long, n_frames long")
    rows = timeline.core_windows(episodes, core, context).collect()
    frames = [f for r in rows for f in range(r.core_start, r.core_end)]
    assert sorted(frames) == list(range(n))
    assert all(0 <= r.context_start <= r.core_start and r.core_end <= r.context_end <= n for r in rows)


def test_clip(spark):
    rows = segments(spark, [(1, 0, 25, False), (1, 25, 50, True), (1, 50, 100, False)])
    window = spark.createDataFrame([(1, 0, 32, 64)], "episode long, window long, core_start long, core_end long")
    assert sorted((r.start, r.end, r.state) for r in timeline.clip(rows, window).collect()) == [(32, 50, True), (50, 64, False)]


def test_runs_do_not_bridge_unknown_frames(spark):
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate([True, True, None, True])], "episode long, frame long, v boolean")
    assert sorted((r.start, r.end) for r in timeline.to_runs(frames, "v").collect()) == [(0, 2), (3, 4)]


def test_unknowns_are_no_negatives(spark):
    rows = list(zip([None, True, None, False], [True, True, False, False], strict=True))
    frames = spark.createDataFrame([(1, p, r) for p, r in rows], "episode long, p boolean, r boolean")
    m = agreement.unknown_aware(agreement.cells(frames, "p", "r", ["episode"])).first()
    assert (m.coverage, m.agreement, m.unknown_pos, m.unknown_neg, m.recall) == (0.5, 0.5, 1, 1, 0.5)
    frames = spark.createDataFrame([(1, False, r) for r in (True, True, False, False)], "episode long, p boolean, r boolean")
    m = agreement.unknown_aware(agreement.cells(frames, "p", "r", ["episode"])).first()
    assert (m.agreement, m.f1, m.recall, m.precision) == (0.5, 0, 0, None)


@pytest.mark.parametrize(("zero", "value"), [("null", None), ("zero", 0.0), ("one", 1.0)])
def test_zero_denominators(spark, zero, value):
    assert spark.range(1).select(agreement.ratio(F.lit(0), F.lit(0), zero).alias("r")).first().r == value


def test_parts_carry_frames(spark):
    rows = timeline.chained_parts(spark.createDataFrame([(1, 2000)], "episode long, n_frames long"), 350, 2).collect()
    rows.sort(key=lambda r: r.start)
    assert len(rows) == 6
    assert [f for r in rows for f in range(r.start, r.end)] == list(range(2000))
    assert sum(r.start - r.context_start for r in rows) == 10
    assert [r.previous_part for r in rows] == [None, 0, 1, 2, 3, 4]


points = st.lists(st.integers(0, 40), max_size=5, unique=True).map(sorted)


@settings(max_examples=150, deadline=None)
@given(points, points, st.integers(0, 8))
def test_ordered_matching_is_optimal(a, b, tolerance):
    scored = {(x, y): float(tolerance + 1 - abs(x - y)) for x in a for y in b if abs(x - y) <= tolerance}
    counts, totals = [(0, 0.0)], [(0.0, 0)]
    for k in range(1, min(len(a), len(b)) + 1):
        for x in combinations(a, k):
            for y in combinations(b, k):  # in order
                values = [scored.get(pair) for pair in zip(x, y, strict=True)]
                if None not in values:
                    counts.append((k, sum(values)))
                    totals.append((sum(values), k))
    found = {m: matching.METHODS[m](scored) for m in ("ordered", "alignment", "most")}
    total = {m: sum(scored[p] for p in pairs) for m, pairs in found.items()}
    assert (len(found["ordered"]), total["ordered"]) == max(counts)
    assert (total["alignment"], len(found["alignment"])) == max(totals)
    assert len(found["most"]) == max(counts)[0]


def test_total_first_and_count_first_differ():
    scored = {("a", "x"): 0.3, ("a", "y"): 0.8, ("b", "y"): 0.3}
    assert sorted(matching.METHODS["ordered"](scored)) == [("a", "x"), ("b", "y")]
    assert matching.METHODS["alignment"](scored) == [("a", "y")]


def test_greedy_prefers_later_ones_on_ties():
    assert matching.greedy({(0, 0): 0.5, (0, 2): 0.5}) == [(0, 2)]
    assert matching.greedy({(0, 0): 0.5, (4, 2): 0.5, (4, 0): 0.9}) == [(4, 0)]
    assert matching.greedy_nearest({(10, 11): 4.0, (11, 11): 5.0}) == [(10, 11)]
    assert matching.greedy_nearest({(10, 9): 4.0, (10, 11): 4.0}) == [(10, 9)]


def test_uncontested_pairs_do_not_change_the_matching(spark):
    rng = random.Random(3)
    rows = [(e, *sorted(rng.sample(range(60), 2))) for e in range(40) for _ in range(6)]
    left, right = (spark.createDataFrame(rows[k::2], "episode long, start long, end long").distinct() for k in (0, 1))
    pairs = timeline.overlaps(left, right).where("iou >= 0.1").collect()
    for method in ("greedy", "most"):
        found = matching.match_segments(left.dropDuplicates(["episode", "start"]), right.dropDuplicates(["episode", "start"]), 0.1, method).collect()
        assert {(r.episode, r.left_start, r.right_start) for r in found} <= {(r.episode, r.left_start, r.right_start) for r in pairs}
        assert len({(r.episode, r.left_start) for r in found}) == len({(r.episode, r.right_start) for r in found}) == len(found)


def test_overlaps_over_many_bins(spark):
    a = spark.createDataFrame([(1, 0, 500), (1, 700, 701)], "episode long, start long, end long")
    b = spark.createDataFrame([(1, 100, 400), (1, 450, 900), (1, 64, 64)], "episode long, start long, end long")
    found = sorted((r.left_start, r.right_start, r.overlap) for r in timeline.overlaps(a, b).collect())
    assert found == [(0, 100, 300), (0, 450, 50), (700, 450, 1)]


def test_balanced_order_starts_with_different_groups(spark):
    rows = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(11)], "id long, lab string")
    ordered = sampling.balanced_order(rows, "s", "id", ["lab"]).orderBy("turn", "group_order").collect()
    again = sampling.balanced_order(rows.orderBy(F.desc("id")), "s", "id", ["lab"]).orderBy("turn", "group_order").collect()
    assert [r.id for r in ordered] == [r.id for r in again]
    assert ordered[0].lab != ordered[1].lab


def test_shards_close_before_they_overflow(spark):
    rows = spark.createDataFrame([("g", i, float(s)) for i, s in enumerate([4, 5, 3, 9, 1, 1, 1])], "g string, i long, s double")
    shards = {r.i: r.shard for r in sampling.next_fit_shards(rows, "g", ["i"], "s", 10, 3).collect()}
    assert [shards[i] for i in range(7)] == [0, 0, 1, 2, 2, 3, 3]


def test_closest_subset_prefers_undershoot():
    sizes = {"a": 4, "b": 6, "c": 9}
    assert sum(sizes[x] for x in sampling.closest_subset(sizes, 12)) == 13
    assert sum(sizes[x] for x in sampling.closest_subset({"a": 4, "b": 8}, 6)) == 4


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 7), (20, 20)], "a long, b long")
    found = {r.node: r.root for r in sampling.components(edges, tables.saved).collect()}
    assert found == {3: 3, 4: 3, 5: 3, 7: 3, 8: 8, 9: 8}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    words = lambda s: F.array(*map(F.lit, s.split()))
    assert one(spark, text.edit_distance(words("a b c d"), words("b c x"))) == 2
    assert one(spark, text.common_subsequence(words("a b c d"), words("b x d"))) == 2
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, text.anchored(F.lit("a"), F.lit("a"), F.lit(0.2))) == 1
    assert [tuple(r) for r in one(spark, text.citations(F.lit("Frames 40-70 in wrist, 9")))] == [(40, 70), (9, 9)]
    names = ["run10", "run9", "run1a"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["run1a", "run9", "run10"]


def rich(frames="2-5", categories="grasp", outcome="failure", severity="low"):
    return (
        f"# Episode: 7\n## Episode annotation\n- Language task: t\n- Success label: {outcome}\n- Outcome evidence: frame 1 of cam\n"
        "## Timeline\n| Start frame | End frame | Failure |\n|---|---|---|\n| 0 | 2 | No |\n| 2 | 5 | Yes |\n## Failure annotations\n"
        f"### Failure 1\n- Frames: {frames}\n- Categories: {categories}\n- Explanation: frames 3 in cam\n- Recovery: None\n- Severity: {severity}\n"
        "- Severity evidence: e\n- Resetability: immediate\n- Resetability evidence: e\n"
    )


@pytest.mark.parametrize(
    ("changes", "error"),
    [
        ({}, None), ({"frames": "2-4"}, "frames"), ({"categories": "grasp, grasp"}, "categories"), ({"categories": "Unclear"}, None),
        ({"outcome": "maybe"}, "outcome"), ({"outcome": "success"}, "clean_success"), ({"severity": "high"}, "grades"),
    ],
)
def test_rich_annotations(spark, changes, error):
    parsed = parsing.rich_annotation(F.lit(rich(**changes)), F.lit(7), F.lit(0), F.lit(5), F.array(*map(F.lit, range(5))), F.array(F.lit("cam")))
    found = one(spark, parsed)
    assert found.error == error
    assert (found.value is None) == (error is not None)


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_video_headers(spark, tmp_path):
    def movie(frames):
        tkhd = bytes(76) + struct.pack(">II", 640 << 16, 480 << 16)
        stbl = box(b"stbl", box(b"stsz", bytes(8) + struct.pack(">I", frames)))
        mdia = box(b"mdia", box(b"hdlr", bytes(8) + b"vide") + box(b"minf", stbl))
        mvhd = bytes(12) + struct.pack(">II", 1000, 2500)
        return box(b"ftyp", b"x") + box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"tkhd", tkhd) + mdia))

    (tmp_path / "a.mp4").write_bytes(movie(75))
    (tmp_path / "b.mp4").write_bytes(movie(75)[:-30])
    rows = {r.path[-5:]: tuple(r)[1:] for r in media.video_headers(spark, str(tmp_path)).collect()}
    assert rows == {"a.mp4": (640, 480, 75, 2.5), "b.mp4": (None,) * 4}


def test_writes_are_idempotent(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(5)
    assert tables.write_once(rows, path)
    assert not tables.write_once(rows, path)
    with pytest.raises(ValueError, match="other rows"):
        tables.write_once(spark.range(6), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_new(rows, path)


def test_sources(spark, tmp_path):
    (tmp_path / "f10.csv").write_text("﻿a,b\n1,x\n", encoding="utf-8")
    (tmp_path / "f9.csv").write_text("a,b\n2,y\n", encoding="utf-8")
    assert tables.read_csv(spark, str(tmp_path / "f10.csv")).columns == ["a", "b"]
    files = tables.discovered(spark, str(tmp_path), "*.csv")
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["f9.csv", "f10.csv"]
    wrong = files.select("path", F.lit("0").alias("sha256")).limit(1)
    assert tables.unverified(files, files.select("path", "sha256").union(wrong)).count() == 1
    report = tables.markdown_table(spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double"))
    assert report.splitlines()[2:] == ["| 1 | 0.5000 |", "| 2 | N/A |"]
    wide = tables.union_of_columns(spark.range(1).select("id"), spark.range(1).withColumn("x", F.lit(1)))
    assert wide.columns == ["id", "x"]


def test_portable_export_is_verified(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}", "train" if i % 3 else "eval") for i in range(9)], "id long, text string, split string")
    path = f"{tmp_path}/export"
    tables.export_portable(rows, path)
    schema = "id long, text string, split string"
    assert sorted(map(tuple, tables.read_portable(spark, path, schema, "id").collect())) == sorted(map(tuple, rows.collect()))
    target = F.concat(F.lit("text "), F.col("id").cast("string"))
    assert tables.read_portable(spark, path, schema, "id", derived={"text": target}).count() == 9
    with pytest.raises(ValueError, match="text isn't what"):
        tables.read_portable(spark, path, schema, "id", derived={"id": F.col("id"), "text": F.when(F.col("id") != 4, target)})
    changed = next(tmp_path.glob("export/data/split=eval/*.json"))
    whole = changed.read_text()
    changed.write_text(whole.replace("text", "next"))
    changed.with_name(f".{changed.name}.crc").unlink()  # the file system's own checksum
    with pytest.raises(ValueError, match="manifest"):
        tables.read_portable(spark, path, schema, "id")
    changed.unlink()
    with pytest.raises(ValueError, match="manifest"):
        tables.read_portable(spark, path, schema, "id")
    tables.export_portable(rows.union(rows.where("id = 1")), f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="unique"):
        tables.read_portable(spark, f"{tmp_path}/twice", schema, "id")


def test_quota_take_is_the_greedy_choice(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.choice([0, 0, 0, 1, 2]), i) for i in range(60)]
    found = sampling.quota_take(spark.createDataFrame(data, "g string, outcome long, id long"), "g", "outcome", ["id"], 11).collect()
    for g in "ab":
        queues = {o: sorted(i for h, p, i in data if (h, p) == (g, o)) for o in (0, 1, 2)}
        taken, chosen = {o: 0 for o in queues}, []
        while len(chosen) < 11 and any(queues.values()):
            o = min((o for o in queues if queues[o]), key=lambda o: (taken[o], o))
            chosen.append(queues[o].pop(0))
            taken[o] += 1
        assert sorted(r.id for r in found if r.g == g) == sorted(chosen)


def test_numbers_of_any_length_sort_by_value(spark):
    names = [f"a{n}.txt" for n in (9, 10, 1234567890123, 1234567890124, 9999999999999, 10**30, 10**30 + 1)]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == names
    padded = spark.createDataFrame([("x010",), ("x9",)], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in padded] == ["x9", "x010"]


def test_bootstrap_draws_are_spread_over_tasks(spark, monkeypatch):
    """A small table of slots is many draws: they are dealt to tasks of at most DRAWS draws."""
    from spanloom.operators import stats

    monkeypatch.setattr(stats, "DRAWS", 100)
    draws = stats.bootstrap_draws(spark.range(50).withColumnRenamed("id", "e"), "e", 20, "s")
    plan = draws._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 10, true" in plan
    rows = draws.collect()
    assert sum(r.times for r in rows) == 1000 and {r["round"] for r in rows} == set(range(20))
