"""Streams over events: windowed metrics with late data, sessions, a ban list and a seeded bandit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream of a folder's parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; events later than ``lateness`` behind the newest are dropped."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return e.groupBy(F.window("at", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) per session."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return e.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def bans(events: DataFrame, minutes: int = 60, lateness: str = "2 hours") -> DataFrame:
    """(user_id, event_id, banned): an error bans its user for ``minutes``; state is one time stamp per user and ends with the ban."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness).select("user_id", "event_id", "event_type", "at")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else 0
        out = []
        for pdf in batches:
            for at, event, kind in sorted(zip(pdf["at"], pdf["event_id"], pdf["event_type"])):
                ms = int(at.timestamp() * 1000)
                out.append((key[0], event, ms < until))
                if kind == "error":
                    until = max(until, ms + minutes * 60_000)
        state.update((until,))
        if until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "banned"])

    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, banned boolean", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def append_metrics(events: DataFrame, folder: str, checkpoint: str):
    """An append-only metric store; returns the started query."""
    rows = events.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("metric_name"), "value", F.col("props").alias("metadata"))
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
