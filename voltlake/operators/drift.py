"""Probe drift: depth histograms over time, offsets and jumps, medians and quantiles from counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import small_side


def counted_quantiles(df: DataFrame, keys: list[str], value: Column, step: float, probs: dict[str, float]) -> DataFrame:
    """(*keys, n, one column a name of ``probs``): quantiles of ``value`` rounded to ``step``, the lower one of two.

    Values are counted per step first, so a group costs as many rows as it has steps; null and NaN are left out.
    """
    counts = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", F.round(F.col("_v") / step).cast("long")).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    rows = counts.withColumns({"_through": F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    at = [F.min(F.when(F.col("_through") >= F.greatest(F.ceil(F.lit(p) * F.col("_all")), F.lit(1)), F.col("_b"))) for p in probs.values()]
    return rows.groupBy(*keys).agg(F.sum("_n").alias("n"), *((a * step).alias(k) for a, k in zip(at, probs)))


def large_spikes(spikes: DataFrame, deviations: float) -> DataFrame:
    """Spikes with a place whose amplitude ``uv`` exceeds the recording's mean by so many standard deviations."""
    rows = spikes.where("y is not null and uv is not null")
    bound = rows.groupBy("recording_id").agg((F.avg("uv") + deviations * F.stddev_samp("uv")).alias("_bound"))
    return rows.join(small_side(bound, 500_000), "recording_id").where("uv > _bound").drop("_bound")


def depth_histogram(spikes: DataFrame, width_um: float, width_samples: int) -> DataFrame:
    """Amplitude-weighted histogram of depth per recording and stretch of time; stretches are (lo, hi]."""
    return spikes.where("y is not null and uv is not null").groupBy("recording_id", (F.ceil(F.col("spike_time") / width_samples)).alias("time_bin"), F.floor(F.col("y") / width_um).alias("depth_bin")).agg(F.sum("uv").alias("weight"), F.count(F.lit(1)).alias("n"))


def offsets(histogram: DataFrame, width_um: float, most_bins: int) -> DataFrame:
    """(recording_id, time_bin, offset_um): shift of each stretch against the recording's middle one, less that of the first.

    The shift is the one of at most ``most_bins`` for which the histograms agree best; of equally good ones the smallest.
    """
    times = histogram.select("recording_id", "time_bin").distinct()
    w = Window.partitionBy("recording_id")
    ranked = times.withColumns({"_r": F.row_number().over(w.orderBy("time_bin")), "_m": F.count(F.lit(1)).over(w)})
    middle = ranked.where(F.col("_r") == F.floor((F.col("_m") + 1) / 2)).select("recording_id", F.col("time_bin").alias("_t"))
    ref = histogram.join(small_side(middle, 500_000), "recording_id").where("time_bin = _t")
    ref = ref.select("recording_id", F.col("weight").alias("_w"), F.col("depth_bin").alias("_d"), F.explode(F.sequence(F.lit(-most_bins), F.lit(most_bins))).alias("shift")).withColumn("depth_bin", F.col("_d") + F.col("shift"))
    pairs = histogram.join(ref, ["recording_id", "depth_bin"])
    score = pairs.groupBy("recording_id", "time_bin", "shift").agg(F.sum(F.col("weight") * F.col("_w")).alias("score"))
    best = score.groupBy("recording_id", "time_bin").agg(F.max_by("shift", F.struct(F.round("score", 6), -F.abs("shift"), "shift")).alias("shift"))
    first = F.min_by("shift", "time_bin").over(w)
    return best.withColumn("offset_um", (F.col("shift") - first) * width_um).select("recording_id", "time_bin", "offset_um")


def depth_jumps(spikes: DataFrame, width_samples: int, jump_um: float, least: int, step: float = 0.1) -> DataFrame:
    """Stretches whose median depth differs from the cluster's median by more than ``jump_um``; depths count in steps."""
    rows = spikes.withColumn("time_bin", F.floor(F.col("spike_time") / width_samples))
    keys = ["recording_id", "cluster_id"]
    whole = counted_quantiles(rows, keys, F.col("y"), step, {"usual": 0.5}).drop("n")
    part = counted_quantiles(rows, [*keys, "time_bin"], F.col("y"), step, {"depth": 0.5})
    return part.join(whole, keys).where((F.abs(F.col("depth") - F.col("usual")) > jump_um) & (F.col("n") > least))


def depth_trace(spikes: DataFrame, width_samples: int, least: int, hole: int) -> DataFrame:
    """(recording_id, cluster_id, time_bin, n, depth, after_gap): mean depth per stretch with at least ``least`` spikes.

    ``after_gap`` tells that more than ``hole`` stretches without enough spikes lie before.
    """
    keys = ["recording_id", "cluster_id"]
    rows = spikes.where("y is not null").groupBy(*keys, F.floor(F.col("spike_time") / width_samples).alias("time_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("depth")).where(F.col("n") >= least)
    step = F.col("time_bin") - F.lag("time_bin").over(Window.partitionBy(*keys).orderBy("time_bin"))
    return rows.withColumn("after_gap", F.coalesce(step - 1 > hole, F.lit(False)))


def filled_shifts(trace: DataFrame) -> DataFrame:
    """(recording_id, cluster_id, time_bin, depth, shift): every stretch between a cluster's first and last, missing depths from the one before.

    ``shift`` is the distance to the cluster's first depth. Nothing is carried beyond the last known depth.
    """
    keys = ["recording_id", "cluster_id"]
    grid = trace.groupBy(*keys).agg(F.min("time_bin").alias("_a"), F.max("time_bin").alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias("time_bin"))
    w = Window.partitionBy(*keys).orderBy("time_bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(trace.select(*keys, "time_bin", "depth"), [*keys, "time_bin"], "left").withColumn("depth", F.last("depth", ignorenulls=True).over(w))
    return rows.withColumn("shift", F.col("depth") - F.first("depth", ignorenulls=True).over(w))


def amplitude_bins(spikes: DataFrame, low: float, high: float, bins: int, step: float = 0.01) -> DataFrame:
    """Spikes with the colour bin of their amplitude between two quantiles of the recording, which count in steps."""
    clean = spikes.where("spike_amplitude is not null and not isnan(spike_amplitude)")
    q = small_side(counted_quantiles(clean, ["recording_id"], F.col("spike_amplitude"), step, {"_lo": low, "_hi": high}).drop("n"), 500_000)
    at = F.floor((F.col("spike_amplitude") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins) + 1
    return clean.join(q, "recording_id").withColumn("color_bin", F.greatest(F.lit(1), F.least(F.lit(bins), at)).cast("int")).drop("_lo", "_hi")


def lowess(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Locally weighted lines: at each point the fit to the nearest ``share`` of all points, at least three, with tricube weights."""
    n = len(x)
    k = min(n, max(3, int(np.ceil(share * n))))
    if n < 3:
        return y.astype(np.float64)
    x, y, out = x.astype(np.float64), y.astype(np.float64), np.empty(n)
    for lo in range(0, n, 512):
        d = np.abs(x[lo : lo + 512, None] - x)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(d, near, 1)
        w = np.clip(1 - (d / np.maximum(d.max(1, keepdims=True) * (1 + 1e-9), 1e-12)) ** 3, 0, None) ** 3
        u, v = x[near] - x[lo : lo + 512, None], y[near]
        s, su, sv, suu, suv = w.sum(1), (w * u).sum(1), (w * v).sum(1), (w * u * u).sum(1), (w * u * v).sum(1)
        det = s * suu - su**2
        flat = det <= 1e-12 * np.maximum(s * suu, 1e-300)
        out[lo : lo + 512] = np.where(flat, sv / s, (suu * sv - su * suv) / np.where(flat, 1.0, det))
    return out


def smoothed_trace(trace: DataFrame, share: float = 0.3) -> DataFrame:
    """(recording_id, cluster_id, time_bin, part, smooth): depth traces smoothed by ``lowess`` between gaps.

    ``trace`` is one of ``depth_trace``; ``part`` counts a cluster's stretches between gaps from 0. What is handled together are the
    stretches of one part, at most as many as a recording has.
    """
    keys = ["recording_id", "cluster_id"]
    w = Window.partitionBy(*keys).orderBy("time_bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = trace.withColumn("part", F.sum(F.col("after_gap").cast("int")).over(w))
    lists = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("time_bin", "depth"))).alias("l"))
    kinds = ", ".join(f"{k} {trace.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(3)
            at, e = own.offsets.to_numpy(), own.values
            x, y = e.field("time_bin").to_numpy(), e.field("depth").to_numpy()
            smooth = [lowess(x[lo:hi], y[lo:hi], share) for lo, hi in zip(at[:-1], at[1:])]
            row = pa.array(np.repeat(np.arange(b.num_rows), np.diff(at)))
            inner = slice(at[0], at[-1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(x[inner]), b.column(2).take(row), pa.array(np.concatenate([np.empty(0), *smooth]))], [*keys, "time_bin", "part", "smooth"])

    return lists.mapInArrow(run, f"{kinds}, time_bin bigint, part bigint, smooth double")
