"""Streaming forms of the log analytics: files appear, running results follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.calls import detect
from sieveline.sources import scratch


def usage_totals(steps: DataFrame) -> DataFrame:
    """Running totals by model of a stream of steps (model, tokens, cost): aggregations whose state is a row per model."""
    return steps.groupBy("model").agg(F.count("*").alias("steps"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def drain(frame: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, and return its last result, written in the shared folder."""
    spark = frame.sparkSession
    path = scratch.new_folder(spark, "drained")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    keep(spark.createDataFrame([], frame.schema), -1)  # a stream without rows has no batch
    query = frame.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")


def loop_verdicts(calls: DataFrame, sink, checkpoint: str):
    """Judge each micro-batch of complete turns (as ``calls.detect``) and hand it to ``sink(frame, batch_id)``."""
    return calls.writeStream.foreachBatch(lambda frame, number: sink(detect(frame), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
