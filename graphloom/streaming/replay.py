"""Structured Streaming forms of the session and event queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, pattern = path.rsplit("/", 1)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    # watermarks need instants: times without a zone are taken in the session's
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n_events", F.round("total", 4).alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: runs of events with gaps below ``gap``."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("session_window.start").alias("start"), "n_events")


def phase_updates(messages: DataFrame) -> DataFrame:
    """State of each session as its messages arrive: conv_id, n_asked, n_answered, phase."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        asked, answered = state.get if state.exists else (0, 0)
        for batch in batches:
            asked += int((batch["role"] == "user").sum())
            answered += int((batch["role"] == "assistant").sum())
        state.update((asked, answered))
        phase = "idle" if asked == 0 else "collecting" if answered < 2 else "gap_summary" if answered < 4 else "course"
        yield pd.DataFrame({"conv_id": [key[0]], "n_asked": [asked], "n_answered": [answered], "phase": [phase]})

    return messages.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, n_asked long, n_answered long, phase string", "n_asked long, n_answered long", "update", "NoTimeout")
