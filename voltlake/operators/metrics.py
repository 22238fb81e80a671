"""Templates and what follows from them: amplitudes, places on the probe, similarity, places of spikes.

Templates are rows (recording_id, template_id, channel_id, w): ``w`` is the waveform on a channel, an array in microvolts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.scalars import trough_to_peak_ms, value_range
from voltlake.operators.joins import nearest
from voltlake.runtime import small_side

TEMPLATE = ["recording_id", "template_id"]


def from_means(means: DataFrame, value: str = "mean_uv") -> DataFrame:
    """Templates of clusters' mean waveforms (recording_id, cluster_id, channel_id, t, value)."""
    lists = means.groupBy("recording_id", F.col("cluster_id").cast("int").alias("template_id"), "channel_id").agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("w"))
    return lists.select(*TEMPLATE, "channel_id", F.col("w.v").alias("w"))


def unwhitened(templates: DataFrame, inverse: DataFrame) -> DataFrame:
    """Templates times the inverse of the whitening matrix (recording_id, channel_id, to_channel, f)."""
    rows = templates.join(inverse, ["recording_id", "channel_id"]).select(*TEMPLATE, F.col("to_channel").alias("channel_id"), F.posexplode(F.transform("w", lambda v: v * F.col("f"))).alias("t", "v"))
    sums = rows.groupBy(*TEMPLATE, "channel_id", "t").agg(F.sum("v").alias("v"))
    return from_means(sums.withColumnRenamed("template_id", "cluster_id"), "v")


def amplitudes(templates: DataFrame) -> DataFrame:
    """(recording_id, template_id, amplitude, channel_id, ttp_ms): largest range of a channel, that channel, time from trough to peak there."""
    top = F.max_by(F.struct("channel_id", "w"), F.struct(value_range(F.col("w")), -F.col("channel_id")))
    rows = templates.groupBy(*TEMPLATE).agg(F.max(value_range(F.col("w"))).alias("amplitude"), top.alias("top"))
    return rows.select(*TEMPLATE, "amplitude", "top.channel_id", trough_to_peak_ms(F.col("top.w"), 30000.0).alias("ttp_ms"))


def best_channels(templates: DataFrame, channels: DataFrame, n: int = 24) -> DataFrame:
    """(recording_id, template_id, channel_id, rank): the channel of largest range, then those nearest to it."""
    near = nearest(channels, n - 1, "channel_id", ["pos_x", "pos_y", "pos_z"])
    order = near.select(F.col("channel_id").alias("_peak"), F.col("other").alias("channel_id"), (F.col("rank") + 1).alias("rank"))
    itself = channels.where("pos_x is not null").select(F.col("channel_id").alias("_peak"), "channel_id", F.lit(1).alias("rank"))
    peaks = amplitudes(templates).select(*TEMPLATE, F.col("channel_id").alias("_peak"))
    return peaks.join(small_side(order.unionByName(itself), 100_000), "_peak").drop("_peak")


def on_channels(best: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(recording_id, channel_id, template_id, rank): of the templates a channel is among the best of the ``n`` largest."""
    rows = best.select(*TEMPLATE, "channel_id").join(sizes.select(*TEMPLATE, "amplitude"), TEMPLATE)
    rank = F.row_number().over(Window.partitionBy("recording_id", "channel_id").orderBy(F.desc("amplitude"), "template_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("recording_id", "channel_id", "template_id", "rank")


def _large(templates: DataFrame, size: Column, share: float) -> DataFrame:
    rows = templates.withColumn("r", size)
    return rows.withColumn("_top", F.max("r").over(Window.partitionBy(*TEMPLATE))).where(F.col("r") >= share * F.col("_top"))


def places(templates: DataFrame, channels: DataFrame, share: float = 0.1) -> DataFrame:
    """(recording_id, template_id, x, y): channel positions weighted by range, where it is large enough."""
    placed = _large(templates, value_range(F.col("w")), share).join(small_side(channels.select("channel_id", "pos_x", "pos_y"), 100_000), "channel_id")
    return placed.groupBy(*TEMPLATE).agg(*(F.try_divide(F.sum(F.col("r") * F.col(f"pos_{c}")), F.sum("r")).alias(c) for c in "xy"))


def localized(templates: DataFrame, channels: DataFrame, share: float = 0.5, reach: float = 200.0) -> DataFrame:
    """(recording_id, template_id, localized): whether the channels with a large part of the peak lie close together."""
    peak = F.greatest(F.abs(F.array_max("w")), F.abs(F.array_min("w")))
    placed = _large(templates, peak, share).join(small_side(channels.select("channel_id", "pos_x", "pos_y"), 100_000), "channel_id")
    pts = placed.groupBy(*TEMPLATE).agg(F.collect_list(F.struct("pos_x", "pos_y")).alias("p"))
    far = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: F.sqrt((a["pos_x"] - b["pos_x"]) ** 2 + (a["pos_y"] - b["pos_y"]) ** 2)))))
    return pts.select(*TEMPLATE, (F.coalesce(far, F.lit(0.0)) < reach).alias("localized"))


def all_localized(use: DataFrame, flags: DataFrame) -> DataFrame:
    """(recording_id, cluster_id, localized): whether all templates a cluster uses are; true if it uses none that is known."""
    return use.join(flags, TEMPLATE, "left").groupBy("recording_id", "cluster_id").agg(F.coalesce(F.bool_and("localized"), F.lit(True)).alias("localized"))


def cluster_shape(use: DataFrame, sizes: DataFrame) -> DataFrame:
    """(recording_id, cluster_id, ttp_ms): mean over the templates of a cluster with such a time, weighted by use."""
    rows = use.join(sizes.select(*TEMPLATE, "ttp_ms").where("ttp_ms is not null"), TEMPLATE)
    return rows.groupBy("recording_id", "cluster_id").agg((F.sum(F.col("n") * F.col("ttp_ms")) / F.sum("n")).alias("ttp_ms"))


def cluster_templates(use: DataFrame, templates: DataFrame, scale: DataFrame) -> DataFrame:
    """(recording_id, cluster_id, template_id, channel_id, w): the template a cluster uses most, times that template's ``scale``."""
    top = use.where("rank = 1").select("recording_id", "cluster_id", "template_id")
    return top.join(templates, TEMPLATE).join(scale, TEMPLATE).select("recording_id", "cluster_id", "template_id", "channel_id", F.transform("w", lambda v: v * F.col("scale")).alias("w"))


def spike_places(spikes: DataFrame, best: DataFrame, channels: DataFrame, sizes: DataFrame, n_channels: int = 2) -> DataFrame:
    """Spikes with ``uv`` (amplitude times that of the template) and ``x``, ``y``.

    The place is the mean of the feature channels' positions, weighted by the square of their first component where that is
    positive; feature channels are the template's ``n_channels`` best. Without features or a positive one it is null.
    """
    spots = best.where(F.col("rank") <= n_channels).join(small_side(channels.select("channel_id", "pos_x", "pos_y"), 100_000), "channel_id")
    spots = spots.groupBy(*TEMPLATE).agg(F.array_sort(F.collect_list(F.struct("rank", "pos_x", "pos_y"))).alias("_s"))
    table = small_side(spots.join(sizes.select(*TEMPLATE, F.col("amplitude").alias("_a")), TEMPLATE), 500_000)
    first = F.transform("pc_features", lambda c: F.greatest(F.get(c, F.lit(0)).cast("double"), F.lit(0.0)))
    rows = spikes.join(table, TEMPLATE, "left").withColumn("_f", F.zip_with(first, "_s", lambda f, s: F.struct((f * f).alias("q"), s["pos_x"].alias("x"), s["pos_y"].alias("y"))))
    total = lambda g: F.aggregate("_f", F.lit(0.0), lambda a, v: a + F.coalesce(g(v), F.lit(0.0)))
    weight = F.nullif(total(lambda v: v["q"]), F.lit(0.0))
    return rows.withColumns({"uv": F.col("amplitude") * F.col("_a"), "x": total(lambda v: v["q"] * v["x"]) / weight, "y": total(lambda v: v["q"] * v["y"]) / weight}).drop("_s", "_a", "_f")


def similarity(templates: DataFrame, lags: int, least: float = 0.1) -> DataFrame:
    """(recording_id, template_id, other, similarity, lag): largest normalized cross-correlation over lags, for pairs that share a channel.

    Clipped to [0, 1]; a similarity below ``least`` has lag 0. ``lag`` is by how many samples the other comes later; of equally good
    ones the smallest.
    """
    norm = F.sqrt(F.sum(F.aggregate("w", F.lit(0.0), lambda a, v: a + v * v)).over(Window.partitionBy(*TEMPLATE)))
    rows = templates.withColumn("_n", norm)
    other = rows.select("recording_id", "channel_id", F.col("template_id").alias("other"), F.col("w").alias("_w"), F.col("_n").alias("_m"))
    size = F.size("w")

    def at(lag: Column) -> Column:
        a = F.slice("w", F.greatest(F.lit(1), 1 - lag), F.greatest(F.lit(0), size - F.abs(lag)))
        b = F.slice("_w", F.greatest(F.lit(1), 1 + lag), F.greatest(F.lit(0), size - F.abs(lag)))
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    pairs = rows.join(other, ["recording_id", "channel_id"]).where("template_id <> other")
    each = pairs.select(*TEMPLATE, "other", "_n", "_m", F.posexplode(F.transform(F.sequence(F.lit(-lags), F.lit(lags)), at)).alias("_p", "_c"))
    score = each.groupBy(*TEMPLATE, "other", "_p").agg((F.sum("_c") / F.nullif(F.first("_n") * F.first("_m"), F.lit(0.0))).alias("_s"))
    best = score.groupBy(*TEMPLATE, "other").agg(F.max("_s").alias("_s"), F.max_by("_p", F.struct(F.round("_s", 9), -F.abs(F.col("_p") - lags), -F.col("_p"))).alias("_p"))
    clipped = F.coalesce(F.least(F.greatest("_s", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return best.select(*TEMPLATE, "other", clipped.alias("similarity"), F.when(clipped < least, 0).otherwise(F.col("_p") - lags).cast("int").alias("lag"))


def most_similar(pairs: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The ``k`` most similar others of each template, at least ``least``, ties by id: adds ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*TEMPLATE).orderBy(F.desc(F.round("similarity", 9)), "other"))
    return pairs.where(F.col("similarity") >= max(0.0, least)).withColumn("rank", rank).where(F.col("rank") <= k)


def cluster_similarity(use: DataFrame, pairs: DataFrame) -> DataFrame:
    """(recording_id, cluster_id, other_cluster, similarity): templates' similarity weighted by both clusters' use; a template and itself count 1."""
    w = use.select("recording_id", "cluster_id", "template_id", "share")
    itself = w.select("recording_id", "template_id", F.col("template_id").alias("other"), F.lit(1.0).alias("similarity")).distinct()
    s = pairs.select("recording_id", "template_id", "other", "similarity").unionByName(itself)
    v = w.select("recording_id", F.col("cluster_id").alias("other_cluster"), F.col("template_id").alias("other"), F.col("share").alias("_v"))
    rows = w.join(s, TEMPLATE).join(v, ["recording_id", "other"]).where("cluster_id < other_cluster")
    return rows.groupBy("recording_id", "cluster_id", "other_cluster").agg(F.sum(F.col("share") * F.col("similarity") * F.col("_v")).alias("similarity"))


def duplicate_counts(duplicates: DataFrame, spikes: DataFrame, kind: str) -> DataFrame:
    """(recording_id, a, b, n, share): spikes of ``kind`` (template_id or cluster_id) b that duplicate ones of a, and their share of all of b."""
    of = spikes.select("recording_id", F.col("spike_id").alias("of_spike"), F.col(kind).alias("a"))
    own = spikes.select("recording_id", "spike_id", F.col(kind).alias("b"))
    n = duplicates.join(own, ["recording_id", "spike_id"]).join(of, ["recording_id", "of_spike"]).groupBy("recording_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    whole = own.groupBy("recording_id", "b").agg(F.count(F.lit(1)).alias("_all"))
    return n.join(whole, ["recording_id", "b"]).select("recording_id", "a", "b", "n", (F.col("n") / F.col("_all")).alias("share"))
