"""Streams run over all that their source holds, each with a checkpoint and a sink in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.sources.shared import fresh_path


def shared_dir(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir; in a folder of our own only on one machine where none is set."""
    return fresh_path(spark, "stream")


def replayed(stream: DataFrame) -> DataFrame:
    """What the append-mode sink holds once the stream has read all that is there."""
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows", format="parquet")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def followed(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """step applied to each batch once: a batch has a folder of its own, which a repetition after a failure overwrites."""
    spark = stream.sparkSession
    path = path or shared_dir(spark)

    def once(batch: DataFrame, k: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={k}")

    query = stream.writeStream.foreachBatch(once).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("batch")
