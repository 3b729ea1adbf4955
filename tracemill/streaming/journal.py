"""Structured Streaming over journals that grow by files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import shared_path


def run_stream(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], files_per_trigger: int = 8) -> DataFrame:
    """Everything in `path` so far through a stateful streaming plan, in micro-batches; the state after the last one.

    The checkpoint and the result are in the shared folder; a batch that runs again overwrites its own result.
    """
    out, state = shared_path(spark, "result"), shared_path(spark, "state")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    running = plan(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(out)
