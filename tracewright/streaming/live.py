"""Structured Streaming over log folders and event tables.

The batch techniques have no streaming counterpart to match; these three cover
what a running service would want of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_contents(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Log files as they appear, each content once within the delay."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", F.col("modificationTime").alias("mtime"), "length", F.sha2("content", 256).alias("sha256"))
    return rows.withWatermark("mtime", delay).dropDuplicatesWithinWatermark(["sha256"])


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of a user's events with no pause longer than ``gap``; final once the watermark has passed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "errors")


def error_rates(events: DataFrame, width: str = "1 day", slide: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Sliding shares of errors."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"))
    return rows.agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"), F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rate", "events")


def online_cusum(events: DataFrame, target: float, slack: float, limit: float) -> DataFrame:
    """One row for each user and batch: two-sided CUSUM of the error indicator, kept as state, and alarms so far.

    Events of a batch are taken in order of time; the state is two sums and a count.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hi, lo, alarms = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for bad in rows.bad:
            hi, lo = max(0.0, hi + bad - target - slack), max(0.0, lo + target - slack - bad)
            if max(hi, lo) > limit:
                alarms += 1
                hi = lo = 0.0
        state.update((hi, lo, alarms))
        yield pd.DataFrame([(key[0], hi, lo, alarms)], columns=["user_id", "s_hi", "s_lo", "alarms"])

    rows = events.select("user_id", "ts", "event_id", (F.col("event_type") == "error").cast("double").alias("bad"))
    out = "user_id bigint, s_hi double, s_lo double, alarms bigint"
    return rows.groupBy("user_id").applyInPandasWithState(update, out, "s_hi double, s_lo double, alarms bigint", "update", GroupStateTimeout.NoTimeout)
