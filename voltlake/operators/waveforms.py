"""Snippets and waveforms: selection, averages, peaks, centroids, medians over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.scalars import value_range


def traces(snippets: DataFrame) -> DataFrame:
    """One row per valid snippet and channel: (snippet_id, recording_id, cluster_id, channel_id, x, scale_to_uv)."""
    rows = snippets.where("valid and data is not null").select("snippet_id", "recording_id", "cluster_id", "sample_idx", "channel_ids", "data", "scale_to_uv").dropDuplicates(["snippet_id"])
    pairs = F.explode(F.arrays_zip("channel_ids", "data"))
    return rows.select("snippet_id", "recording_id", "cluster_id", "sample_idx", "scale_to_uv", pairs.alias("p")).select("snippet_id", "recording_id", "cluster_id", "sample_idx", "scale_to_uv", F.col("p.channel_ids").alias("channel_id"), F.col("p.data").alias("x"))


def select_window(snippets: DataFrame, first: int, last: int) -> DataFrame:
    """Snippets cut to readings ``first`` to ``last``, counted from 1; the window moves along."""
    cut = F.transform("data", lambda t: F.slice(t, first, last - first + 1))
    return snippets.withColumns({"data": cut, "window_hi": F.col("window_lo") + last - 1, "window_lo": F.col("window_lo") + first - 1})


def readings(rows: DataFrame) -> DataFrame:
    """Traces in long form: one row per reading, ``t`` counted from 1."""
    return rows.select(*(c for c in rows.columns if c != "x"), F.posexplode("x").alias("t", "v")).withColumn("t", F.col("t") + 1)


def mean_waveforms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, standard error and count per group, channel and time, in microvolts."""
    uv = F.col("v").cast("double") * F.col("scale_to_uv").cast("double")
    out = readings(rows).groupBy(*keys, "channel_id", "t").agg(F.avg(uv).alias("mean_uv"), F.stddev_samp(uv).alias("sd"), F.count(uv).alias("n"))
    return out.withColumn("sem_uv", F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n"))).drop("sd")


def centred(rows: DataFrame, baseline: int) -> DataFrame:
    """Traces less the mean of their first ``baseline`` readings."""
    mean = F.aggregate(F.slice("x", 1, baseline), F.lit(0.0), lambda a, v: a + v.cast("double")) / F.least(F.lit(baseline), F.size("x"))
    return rows.withColumn("_m", mean).withColumn("x", F.transform("x", lambda v: v.cast("double") - F.col("_m"))).drop("_m")


def centroids(rows: DataFrame, channels: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Centre of each snippet: channel positions weighted by range, where it is large enough."""
    w = Window.partitionBy("snippet_id")
    part = rows.withColumn("r", value_range(F.col("x")).cast("double")).withColumn("top", F.max("r").over(w)).where(F.col("r") >= threshold * F.col("top"))
    placed = part.join(channels.select("channel_id", "pos_x", "pos_y"), "channel_id")
    return placed.groupBy("snippet_id").agg(*(F.try_divide(F.sum(F.col("r") * F.col(c)), F.sum("r")).alias(c) for c in ("pos_x", "pos_y")), F.count(F.lit(1)).alias("n_channels"))


def localized(rows: DataFrame, channels: DataFrame, share: float = 0.5, reach: float = 200.0) -> DataFrame:
    """Whether the channels with a large part of a snippet's peak lie close together."""
    w = Window.partitionBy("snippet_id")
    peak = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))).cast("double")
    part = rows.withColumn("r", peak).withColumn("top", F.max("r").over(w)).where(F.col("r") >= share * F.col("top"))
    placed = part.join(channels.select("channel_id", "pos_x", "pos_y"), "channel_id")
    pts = placed.groupBy("snippet_id").agg(F.collect_list(F.struct("pos_x", "pos_y")).alias("p"))
    far = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: F.sqrt((a["pos_x"] - b["pos_x"]) ** 2 + (a["pos_y"] - b["pos_y"]) ** 2)))))
    return pts.select("snippet_id", (F.coalesce(far, F.lit(0.0)) < reach).alias("localized"))


def rms_by_channel(rows: DataFrame) -> DataFrame:
    """Root mean square about each trace's mean, per recording and channel, in microvolts."""
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")) / n
    ss = F.aggregate(F.transform("x", lambda v: (v.cast("double") - F.col("_m")) * (v.cast("double") - F.col("_m"))), F.lit(0.0), lambda a, v: a + v)
    scaled = rows.withColumn("_m", mean).select("recording_id", "channel_id", (ss * F.col("scale_to_uv").cast("double") ** 2).alias("ss"), n.alias("n"))
    return scaled.groupBy("recording_id", "channel_id").agg(F.sqrt(F.sum("ss") / F.sum("n")).alias("rms_uv"))


def median_waveforms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median and median absolute deviation per group, channel and time, in microvolts."""
    uv = F.col("v").cast("double") * F.col("scale_to_uv").cast("double")
    long = readings(rows).select(*keys, "channel_id", "t", uv.alias("v"))
    med = long.groupBy(*keys, "channel_id", "t").agg(F.median("v").alias("med"))
    return long.join(med, [*keys, "channel_id", "t"]).groupBy(*keys, "channel_id", "t").agg(F.first("med").alias("med"), F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))


def stacked(rows: DataFrame) -> DataFrame:
    """Traces less their median, divided by their largest deviation, lifted by their channel's place in the snippet."""
    n = F.size("x")
    sorted_ = F.array_sort(F.transform("x", lambda v: v.cast("double")))
    median = (F.element_at(sorted_, F.expr("int((size(x) + 1) div 2)")) + F.element_at(sorted_, F.expr("int(size(x) div 2 + 1)"))) / 2
    place = F.row_number().over(Window.partitionBy("snippet_id").orderBy("channel_id"))
    rows = rows.where(n > 0).withColumn("_m", median).withColumn("x", F.transform("x", lambda v: v.cast("double") - F.col("_m")))
    rows = rows.withColumns({"_t": F.nullif(F.array_max(F.transform("x", lambda v: F.abs(v))), F.lit(0.0)), "_p": place})
    return rows.withColumn("x", F.transform("x", lambda v: v / F.col("_t") + F.col("_p"))).drop("_m", "_t", "_p")
