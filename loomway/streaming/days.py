"""Structured Streaming versions of the day summary and of sessions by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_totals(events: DataFrame, time: str = "ts", key: str = "user_id", value: str = "value", late: str = "1 day") -> DataFrame:
    """(key, start, events, total) per day; a day is final when the watermark has passed it, later rows are dropped."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(key, F.window("_t", "1 day").alias("_w")).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(key, F.col("_w.start").alias("start"), "events", "total")


def sessions(events: DataFrame, gap: str = "6 hours", time: str = "ts", key: str = "user_id", late: str = "1 day") -> DataFrame:
    """(key, start, end, events): sessions that end when nothing comes for `gap`."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(key, F.session_window("_t", gap).alias("_w")).agg(F.count("*").alias("events")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def deduplicated(events: DataFrame, ids: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows once each within the watermark, for loads that send rows again."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(ids).drop("_t")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now into a table in memory, for tests; a cluster writes to a sink instead."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
