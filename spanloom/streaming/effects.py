"""Side effects of a stream, journalled before they happen.

Each micro-batch leaves three records, each in a folder of its own that is written whole or not at all:
the intents (what is about to be sent, with the batch's token), the outcomes of what was sent, and how each
intent was settled.  A batch that runs again after a crash finds its intents.  Those without an
outcome may or may not have been sent, so they are looked up by key and token at the receiver:
``reconciled`` if they are there; else ``unknown``, never sent again, or, where the receiver's list is
known to be whole, sent now.

A task that Spark runs again mustn't send twice either: only the first attempt of a task sends,
others hand in their rows as unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Takes rows and their tokens, sends them and returns the receiver's ids.
Send = Callable[[pd.DataFrame], list[str]]
#: Gives what the receiver has, as (key, token, remote).
LookUp = Callable[[SparkSession], DataFrame]


def _there(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _sent(intents: DataFrame, key: str, send: Send) -> DataFrame:
    kind = intents.schema[key].dataType.simpleString()

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        first = context.attemptNumber() == 0 and context.stageAttemptNumber() == 0 if hasattr(context, "stageAttemptNumber") else context.attemptNumber() == 0
        for pdf in pdfs:
            remote = send(pdf) if first and len(pdf) else [None] * len(pdf)
            yield pd.DataFrame({key: pdf[key], "token": pdf["token"], "remote": pd.Series(remote, dtype=object)})

    return intents.mapInPandas(work, f"{key} {kind}, token string, remote string")


def settle(batch: DataFrame, batch_id: int, key: str, send: Send, look_up: LookUp, folder: str, resend: bool = False, at: Callable[[str], None] = lambda step: None) -> None:
    """Journal, send and settle one batch.  ``at`` is called between the steps (tests crash there)."""
    spark, own = batch.sparkSession, f"batch={batch_id}"
    intents = _there(spark, f"{folder}/intent/{own}")
    again = intents is not None
    if not again:
        at("intent")
        token = F.sha2(F.concat_ws(":", F.lit(str(batch_id)), F.col(key).cast("string")), 256)
        rows = batch.dropDuplicates([key]).where(F.col(key).isNotNull()).withColumn("token", token)
        before = _there(spark, f"{folder}/intent")
        if before is not None:  # an intent of any earlier batch stands, whatever became of it
            rows = rows.join(before.where(F.col("batch") != batch_id).select(key), key, "left_anti")
        rows.write.parquet(f"{folder}/intent/{own}")  # fails if another run of the batch was faster
        intents = spark.read.schema(rows.schema).parquet(f"{folder}/intent/{own}")
        at("send")
        _sent(intents, key, send).write.parquet(f"{folder}/outcome/{own}")
        at("settle")
    kind = intents.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, token string, remote string"
    outcomes = _there(spark, f"{folder}/outcome/{own}", shape)
    if outcomes is None:
        outcomes = spark.createDataFrame([], shape)
    known = outcomes.where("remote is not null").select(key, "token", F.col("remote").alias("_sent"))
    found = look_up(spark).select(key, "token", F.col("remote").alias("_found"))
    both = intents.select(key, "token").join(known, [key, "token"], "left").join(found, [key, "token"], "left")
    state = F.when(F.col("_sent").isNotNull(), "sent").when(F.col("_found").isNotNull(), "reconciled").otherwise("unknown")
    settled = both.select(key, "token", F.coalesce("_sent", "_found").alias("remote"), state.alias("state"))
    if resend:  # the receiver's list is whole: what isn't there was never received
        missing = intents.join(settled.where("state = 'unknown'").select(key), key, "left_semi")
        late = f"{folder}/late/{own}"
        if _there(spark, late, shape) is None:
            if not missing.isEmpty():
                _sent(missing, key, send).write.parquet(late)
        if (later := _there(spark, late, shape)) is not None:
            later = later.where("remote is not null").select(key, F.col("remote").alias("_late"))
            settled = settled.join(later, key, "left").select(key, "token", F.coalesce("remote", "_late").alias("remote"), F.when(F.col("_late").isNotNull(), "resent").otherwise(F.col("state")).alias("state"))
    settled.write.mode("overwrite").parquet(f"{folder}/settled/{own}")


def journalled(stream: DataFrame, key: str, send: Send, look_up: LookUp, folder: str, resend: bool = False):
    """Send each key of a stream once, by ``settle``; (key, token, remote, state, batch) is in ``<folder>/settled``."""

    def one(batch: DataFrame, batch_id: int) -> None:
        settle(batch, batch_id, key, send, look_up, folder, resend)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
