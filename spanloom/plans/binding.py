"""The engine's tables derived from the events table, in Spark and as SQL for comparison.

An episode is a user's event sequence; labelers are boolean tracks over its frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import timeline as tl


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """One row per frame: tracks a, b, p (b with missing values), the 3-class score c, and more columns of the event."""
    by_time = Window.partitionBy("episode").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    # named before it is dealt, so that Spark knows the frames of an episode to be together
    return table(spark, sf_dir, "events").withColumn("episode", F.col("user_id")).select(
        "episode",
        (F.col("user_id") % 5).alias("lab"),
        (10 + 5 * (F.col("user_id") % 3)).cast("double").alias("fps"),
        "event_id", "ts", "value", "event_type",
        (F.row_number().over(by_time) - 1).cast("long").alias("frame"),
        F.count(F.lit(1)).over(Window.partitionBy("episode")).alias("n_frames"),
        (F.col("event_type") == "error").alias("a"),
        (F.col("value") > 150).alias("b"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") > 150).alias("p"),
        F.when(k < 25, 1).when(k < 50, 2).otherwise(3).cast("long").alias("c"),
        *more,
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(u.alias("episode"))
        .agg(F.count(F.lit(1)).alias("n_frames"))
        .withColumn("lab", F.col("episode") % 5)
        .withColumn("fps", (10 + 5 * (F.col("episode") % 3)).cast("double"))
    )


def runs(spark: SparkSession, sf_dir: str, track: str) -> DataFrame:
    return tl.to_runs(frames(spark, sf_dir), track)


def positives(spark: SparkSession, sf_dir: str, track: str) -> DataFrame:
    return runs(spark, sf_dir, track).where("state")


FRAMES = """
    frames as (
        select user_id as episode, user_id % 5 as lab, cast(10 + 5 * (user_id % 3) as double) as fps,
            event_id, ts, value, event_type,
            row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
            count(*) over (partition by user_id) as n_frames,
            event_type = 'error' as a, value > 150 as b,
            case when event_id % 7 <> 0 then value > 150 end as p,
            case when cast(json_extract_string(props, '$.k') as bigint) < 25 then 1
                when cast(json_extract_string(props, '$.k') as bigint) < 50 then 2 else 3 end as c
        from events
    ), episodes as (
        select episode, any_value(lab) as lab, any_value(fps) as fps, count(*) as n_frames from frames group by episode
    )"""


def runs_sql(track: str) -> str:
    return f""", runs_{track} as (
        select episode, min(frame) as "start", max(frame) + 1 as "end", state from (
            select episode, frame, {track} as state,
                frame - row_number() over (partition by episode, {track} order by frame) as island
            from frames where {track} is not null)
        group by episode, state, island
    )"""


def sql(body: str, *tracks: str) -> str:
    return f"with {FRAMES}{''.join(map(runs_sql, tracks))} {body}"
