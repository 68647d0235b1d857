"""Streams over event logs. Each query has a batch twin that gives the same rows once all events are in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trace import sampled


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone, which a watermark needs."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, errors and mean value of each window and type; the watermark bounds the state."""
    rows = timed(events).withWatermark("ts", late) if events.isStreaming else timed(events)
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days", quota: int = 20) -> DataFrame:
    """Sessions of each user with their events, and whether they are over quota."""
    rows = timed(events).withWatermark("ts", late) if events.isStreaming else timed(events)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), "n", (F.col("n") > quota).alias("over_quota"))


def append(events: DataFrame, path: str, checkpoint: str, sample_rate: float = 1.0) -> StreamingQuery:
    """Sampled events to files; what is available is written and the query ends. A restart goes on behind the checkpoint."""
    kept = events.filter(sampled(F.col("event_id").cast("string"), sample_rate))
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Aggregates to files as windows close."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def unfinished(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that a run that resumes has still to do."""
    return items.join(done.select(key), key, "left_anti")
