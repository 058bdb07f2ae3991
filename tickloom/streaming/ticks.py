"""Streaming operators over ticks (symbol, ts, price, size): windows on event time, closed by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tick_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The stand-in ticks as a file source that takes up files of this name (or pattern) as they come."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return events.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"),
    )


def closed_bars(ticks: DataFrame, width: str = "1 minute", grace: str = "3 seconds") -> DataFrame:
    """A bar per symbol and window, once the watermark has passed its end; later ticks of it are dropped."""
    bars = ticks.withWatermark("ts", grace).groupBy(F.window("ts", width).alias("w"), "symbol")
    bars = bars.agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("n"),
    )
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "volume", "n")


def trailing(ticks: DataFrame, width: str = "15 minutes", slide: str = "1 minute", grace: str = "3 seconds") -> DataFrame:
    """Metrics of sliding windows per symbol, once the watermark has passed their end."""
    some = ticks.withWatermark("ts", grace).groupBy(F.window("ts", width, slide).alias("w"), "symbol")
    some = some.agg(F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.avg("price"), 6).alias("mean_price"), F.sum("size").alias("volume"), F.count("*").alias("n"))
    return some.select("symbol", F.col("w.end").cast("timestamp_ntz").alias("window_end"), "low", "high", "mean_price", "volume", "n")


def breadth(bars: DataFrame) -> DataFrame:
    """Rising and falling symbols of each bar; all bars of one start are closed in the same batch."""
    rising = F.count_if(F.col("close") > F.col("open"))
    return bars.groupBy("bar_start").agg(rising.alias("rising"), F.count_if(F.col("close") < F.col("open")).alias("falling"), F.count("*").alias("symbols"))
