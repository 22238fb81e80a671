"""Trials: cleaning, filters, segmentation of spikes, counts and firing rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.joins import interval_join

#: Width of the buckets that spread spikes and trials along a recording.
BUCKET = 1 << 18


def once(df: DataFrame, loaded: str = "loaded_at") -> DataFrame:
    """Rows without the repetitions that a second load brings."""
    return df.drop(loaded).distinct()


def valid_trials(trials: DataFrame) -> DataFrame:
    """Trials with both ends, in order; repeated rows once."""
    return once(trials).where("trial_start > 0 and trial_stop >= trial_start")


def narrow(trials: DataFrame, from_ms: float, to_ms: float) -> DataFrame:
    """Trials cut to a window in ms after their start."""
    at = lambda ms: F.col("trial_start") + F.round(F.lit(ms) * F.col("fs") / 1000).cast("long")
    return trials.withColumns({"trial_stop": at(to_ms), "trial_start": at(from_ms)})


def truncate(trials: DataFrame, seconds: float) -> DataFrame:
    """Trials that last longer than ``seconds`` end after so long."""
    most = F.col("trial_start") + F.floor(F.col("fs") * seconds)
    return trials.withColumn("trial_stop", F.least(F.col("trial_stop"), most))


def segment(spikes: DataFrame, trials: DataFrame) -> DataFrame:
    """Spikes with each trial of their recording whose closed interval holds them."""
    return interval_join(spikes, trials, ["recording_id"], "spike_time", "trial_start", "trial_stop", BUCKET)


def segment_adjacent(times: DataFrame, trials: DataFrame) -> DataFrame:
    """Times with the trial last begun, up to the next trial's start; the last ends at its stop."""
    w = Window.partitionBy("recording_id").orderBy("trial_start", "trial_id")
    ends = trials.withColumn("_end", F.coalesce(F.lead("trial_start").over(w) - 1, F.col("trial_stop")))
    return interval_join(times, ends.select("recording_id", "trial_id", F.col("trial_start").alias("_start"), "_end"), ["recording_id"], "spike_time", "_start", "_end", BUCKET).drop("_start", "_end")


def in_trials(spikes: DataFrame, trials: DataFrame) -> DataFrame:
    """Spikes inside at least one trial."""
    return interval_join(spikes, trials, ["recording_id"], "spike_time", "trial_start", "trial_stop", BUCKET, "left_semi")


def trial_cluster_counts(spikes: DataFrame, trials: DataFrame, clusters: DataFrame) -> DataFrame:
    """Spikes per trial and cluster of the recording, zeros kept."""
    counts = segment(spikes, trials).groupBy("recording_id", "trial_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    grid = trials.select("recording_id", "trial_id").join(clusters, "recording_id")
    return grid.join(counts, ["recording_id", "trial_id", "cluster_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def firing_rates(counts: DataFrame, trials: DataFrame) -> DataFrame:
    """Spikes a second per trial and cluster; null where the trial has no duration."""
    seconds = (F.col("trial_stop") - F.col("trial_start")) / F.col("fs")
    return counts.join(trials.select("recording_id", "trial_id", "condition_id", seconds.alias("seconds")), ["recording_id", "trial_id"]).withColumn("rate", F.try_divide(F.col("n").cast("double"), F.col("seconds")))


def condition_rates(rates: DataFrame) -> DataFrame:
    """Mean rate per condition and cluster, between the first and last trial that has spikes."""
    w = Window.partitionBy("recording_id", "cluster_id")
    some = F.when(F.col("rate") > 0, F.col("trial_id"))
    inside = rates.withColumns({"_a": F.min(some).over(w), "_b": F.max(some).over(w)}).where(F.col("trial_id").between(F.col("_a"), F.col("_b")))
    return inside.groupBy("recording_id", "condition_id", "cluster_id").agg(F.avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("n_trials"))


def active_regions(trials: DataFrame, pause_s: float) -> DataFrame:
    """Stretches of trials without a pause longer than ``pause_s`` between them."""
    w = Window.partitionBy("recording_id").orderBy("trial_start", "trial_id")
    reach = F.max("trial_stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("trial_start") - reach > F.col("fs") * pause_s)).cast("int")
    regions = trials.withColumn("_f", fresh).withColumn("region", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return regions.groupBy("recording_id", "region").agg(F.min("trial_start").alias("idx_start"), F.max("trial_stop").alias("idx_stop"), F.min("trial_id").alias("first_trial"), F.max("trial_id").alias("last_trial"), F.count(F.lit(1)).alias("n_trials"))


def relative_ms(spike_time: Column, start: Column, fs: Column) -> Column:
    return (spike_time - start) / fs * 1000


def pick(trials: DataFrame, ids: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Trials whose id is among ``ids`` and lies in the closed range from ``first`` to ``last``, as far as given."""
    at = F.col("trial_id")
    ok = F.lit(True)
    for given, test in ((ids, lambda v: at.isin(v)), (first, lambda v: at >= v), (last, lambda v: at <= v)):
        ok = ok if given is None else ok & test(given)
    return trials.where(ok)


def smoothed(rates: DataFrame, radius: int) -> DataFrame:
    """Rates with ``smooth``, the mean over ``radius`` trials of the same condition to either side."""
    w = Window.partitionBy("recording_id", "cluster_id", "condition_id").orderBy("trial_id").rowsBetween(-radius, radius)
    return rates.withColumn("smooth", F.avg("rate").over(w))
