"""The tree data source, byte-range reads and table functions."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from spanloom.functions import tables
from spanloom.sources import media, trees


@pytest.fixture()
def tree(spark, tmp_path):
    rows = spark.range(120).selectExpr("concat('set', id % 4) as dataset", "id % 6 as episode", "id as frame", "id * 0.5 as value", "array(id) as more")
    rows.repartition(3).write.partitionBy("dataset", "episode").parquet(str(tmp_path / "tree"))
    (tmp_path / "tree" / "_notes").mkdir()
    (tmp_path / "tree" / "plain").mkdir()
    spark.range(3).selectExpr("id as frame", "id * 1.0 as value", "array(id) as more").coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "tree" / "plain" / "episode_000007.parquet")
    return rows, str(tmp_path / "tree")


def test_a_tree_reads_as_it_was_written(spark, tree):
    rows, path = tree
    found = trees.episode_tree(spark, path)
    assert found.columns == ["dataset", "episode", "frame", "value", "more"]
    own = found.where("dataset <> 'plain'")
    assert sorted(map(repr, own.collect())) == sorted(map(repr, rows.select(*own.columns).selectExpr("dataset", "episode", "frame", "cast(value as decimal(38,1)) as value", "more").select(*own.columns).withColumn("value", F.col("value").cast(own.schema["value"].dataType)).collect()))
    assert [(r.dataset, r.episode, r.frame) for r in found.where("dataset = 'plain'").orderBy("frame").collect()] == [("plain", 7, i) for i in range(3)]
    assert trees.episode_tree(spark, path, "value").columns == ["dataset", "episode", "value"]


def test_filters_are_pushed_and_partitions_left_out(spark, tree):
    _, path = tree
    rows = trees.episode_tree(spark, path, "frame")
    some = rows.where(F.col("dataset").startswith("set") & F.col("episode").isin(1, 3) & (F.col("frame") > 10))
    plan = some._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]  # what is left for Spark to filter
    assert "frame" in above.split("Filter")[1]
    assert "dataset" not in above.split("Filter")[1]
    assert "episode" not in above.split("Filter")[1]
    assert some.rdd.getNumPartitions() == sum(1 for s in range(4) for e in (1, 3) if any(i % 4 == s and i % 6 == e for i in range(120)))
    assert sorted(r.frame for r in some.collect()) == [i for i in range(11, 120) if i % 6 in (1, 3)]
    assert rows.where("dataset = 'none'").count() == 0
    assert rows.where("episode > 2 and episode <= 3 and frame < 50").count() == sum(i % 6 == 3 for i in range(50))


def test_the_first_unfinished_episode(spark):
    every = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 5)], "dataset string, episode long")
    done = spark.createDataFrame([("a", 1), ("b", 5), ("c", 0)], "dataset string, episode long")
    assert sorted(tuple(r) for r in trees.catalogue(every, done).collect()) == [("a", 2, 2), ("b", 1, None)]


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, kind)) + body


def movie(frames, seconds):
    track = box(
        b"trak", box(b"tkhd", bytes(76), struct.pack(">II", 640 << 16, 480 << 16)),
        box(b"mdia", box(b"hdlr", bytes(8), b"vide"), box(b"minf", box(b"stbl", box(b"stsz", struct.pack(">III", 0, 4, frames))))),
    )
    return box(b"moov", box(b"mvhd", bytes(12), struct.pack(">II", 1000, int(seconds * 1000))), track)


def test_headers_are_read_by_range(spark, tmp_path):
    """A sparse file of 5 GB with the movie box behind the samples: a few hundred bytes are read."""
    header = movie(90, 3.5)
    with open(tmp_path / "large.mp4", "wb") as f:
        f.write(box(b"ftyp", b"isom"))
        f.write(struct.pack(">I4sQ", 1, b"mdat", 5_000_000_000))
        f.seek(12 + 5_000_000_000)
        f.write(header)
    (tmp_path / "front.mp4").write_bytes(header + box(b"mdat", bytes(100_000)))
    (tmp_path / "broken.mp4").write_bytes(box(b"ftyp", b"isom") + struct.pack(">I4s", 999, b"mdat"))
    (tmp_path / "short.mp4").write_bytes(b"abc")
    found = {r.path.rsplit("/", 1)[1]: r for r in trees.ranged_video_headers(spark, str(tmp_path)).collect()}
    for name in ("large.mp4", "front.mp4"):
        r = found[name]
        assert (r.width, r.height, r.frames, r.seconds) == (640, 480, 90, 3.5)
        assert r.bytes_read < len(header) + 64
    assert found["large.mp4"].length > 5_000_000_000
    assert found["broken.mp4"].frames is None
    assert found["short.mp4"].bytes_read == 0
    assert media.video_header((tmp_path / "front.mp4").read_bytes())[:3] == (640, 480, 90)


def test_identities_at_any_depth(spark):
    deep = '{"x":[' * 400 + '{"dataset":"d","episode_index":7}' + "]}" * 400
    texts = [(1, deep), (2, None), (3, "no json"), (4, "[]"), (5, '{"dataset":"a","episode_index":"1","y":{"dataset":null,"episode_index":2}}')]
    rows = spark.createDataFrame(texts, "id long, text string")
    found = rows.lateralJoin(tables.Identities(F.col("text").outer(), F.lit("dataset"), F.lit("episode_index")))
    assert [(r.id, r.name, r.number) for r in found.orderBy("id", "number").collect()] == [(1, "d", 7), (5, "a", 1), (5, None, 2)]


def test_runs_by_a_polymorphic_table_function(spark):
    spark.udtf.register("state_runs", tables.StateRuns)
    spark.createDataFrame([("e", 0, "x"), ("e", 1, "x"), ("e", 3, "x"), ("e", 4, None), ("e", 5, "y"), ("f", 0, "y")], "who string, frame long, s string").createOrReplaceTempView("rows_of_states")
    found = spark.sql("select * from state_runs(table(rows_of_states), 'who', 's')")
    assert found.dtypes == [("who", "string"), ("start", "bigint"), ("end", "bigint"), ("state", "string")]
    assert sorted(tuple(r) for r in found.collect()) == [("e", 0, 2, "x"), ("e", 3, 4, "x"), ("e", 5, 6, "y"), ("f", 0, 1, "y")]
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from state_runs(table(rows_of_states), 'who', 'nothing')")


def test_empty_segments_have_no_frames(spark):
    rows = spark.createDataFrame([(1, 3), (4, 4), (None, 2)], "a long, b long")
    found = rows.lateralJoin(tables.SegmentFrames(F.col("a").outer(), F.col("b").outer()))
    assert sorted(r.frame for r in found.collect()) == [1, 2]


def test_a_tree_of_ranges_has_a_folder_for_many_episodes(spark, tmp_path):
    rows = spark.range(200).selectExpr("if(id % 2 = 0, 'a', 'b') as dataset", "id as episode", "id * 1.5D as value")
    trees.write_ranges(rows, str(tmp_path / "t"), width=50)
    assert len(list((tmp_path / "t").glob("*/*"))) == 8
    read = lambda: trees.episode_tree(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, read().select("dataset", "episode", "value").collect())) == sorted(map(tuple, rows.collect()))
    for wanted in ("episode >= 48 and episode < 53 and dataset = 'a'", "episode in (3, 199, 500)", "episode = 100", "episode > 149", "episode > 199"):
        got = read().where(wanted).select("dataset", "episode", "value")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.where(wanted).collect())), wanted
    assert read().where("episode >= 48 and episode < 53 and dataset = 'a'").rdd.getNumPartitions() == 2
