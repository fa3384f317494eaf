"""Streaming forms of resampling, de-duplication and activity sessions. On closed windows they equal the batch operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch


def read_events(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """File stream of meter readings; event time is cast to TIMESTAMP, since a watermark does not take TIMESTAMP_NTZ."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def resample(stream: DataFrame, keys: list[str], ts: str, value: Column, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Mean and count per tumbling (or sliding) window; late rows beyond the delay are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w, *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(
        *keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def dedupe(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row per key within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Activity sessions per key that end after `gap` of silence."""
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over all available input into a Parquet table with its own checkpoint, and read the table."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_progress").option("path", f"{path}/table")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
