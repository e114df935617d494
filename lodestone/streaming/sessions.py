"""Question sessions as streams whose results are exactly once, and running summaries of sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.ranking import keep_best
from lodestone.operators.evaluation import summary_columns


def _epoch(checkpoint: str, epoch: int) -> str:
    """Name of a micro-batch: a stream with a checkpoint of its own counts anew, under another name."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:8]}-{epoch:09}"


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str, session: str, checkpoint: str) -> StreamingQuery:
    """Runs `answer`, any batch plan over (query_id, query), on each micro-batch and keeps what it returns, in the table in `folder` by session and epoch.

    A micro-batch that Spark replays after a failure is written over itself, so its results stand there once.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{folder}/session_id={session}/epoch={_epoch(checkpoint, epoch)}")

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary_stream(results: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps a running summary of each session of a stream (session_id, ok, seconds): the state is Spark's own, by session.

    Each micro-batch writes the summaries that it changed, over itself if it is replayed; latest_summaries() reads the last of each session.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("at", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/epoch={_epoch(checkpoint, epoch)}")

    summaries = results.groupBy("session_id").agg(*summary_columns())
    return summaries.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The last summary of each session."""
    return keep_best(spark.read.parquet(folder), ["session_id"], F.desc("at")).drop("at", "epoch")
