"""Incremental reading with Structured Streaming.

The engine's own analyses are batch; these helpers keep stored data up to date
from a growing folder, exactly once per file, and count events in buckets as
they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_new_files(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, shape=None) -> int:
    """Append the files that came since the last call; the number of rows they had."""
    stream = spark.readStream.schema(schema).parquet(folder)
    out = shape(stream) if shape else stream
    query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def bucket_counts(stream: DataFrame, ts: str, bucket: str, lateness: str, *keys: str) -> DataFrame:
    """Rows per time bucket and keys; a bucket closes ``lateness`` after its end."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", lateness)
    counted = timed.groupBy(F.window("__ts", bucket), *keys).agg(F.count(F.lit(1)).alias("value"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), *keys, "value")


def sessions(events: DataFrame, actor: str, ts: str, gap: str) -> DataFrame:
    """Activity sessions per actor: they end after ``gap`` without an event. Batch or stream."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__ts", gap)
    grouped = timed.groupBy(F.session_window("__ts", gap).alias("s"), actor).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(actor, F.col("s.start").cast("timestamp_ntz").alias("begin"), F.col("s.end").cast("timestamp_ntz").alias("end"), "events")
