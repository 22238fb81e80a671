"""Streams of spikes: counts per cluster and window of event time, with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(rows: DataFrame, at: str, width: str, keys: list[str], value: str | None = None) -> DataFrame:
    """(window, *keys, n[, total_value]): rows per window of event time and keys, of a table or a stream."""
    return rows.groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"), *([F.sum(value).alias(f"total_{value}")] if value else []))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Spikes per recording, cluster and window of ``loaded_at``; each ``spike_id`` counts once.

    Rows later than ``late`` behind the newest are dropped, as the watermark says; so is the state
    that remembers which ids have come.
    """
    rows = stream.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late)
    return counts_by_window(rows.dropDuplicatesWithinWatermark(["spike_id"]), "at", width, ["recording_id", "cluster_id"], "amplitude")
