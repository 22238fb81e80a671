"""Spike tables: counts, rates, correlograms, lags, duplicates, appending and splicing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.joins import band_join, interval_join, with_previous
from voltlake.operators.trials import BUCKET

KEY = ["recording_id", "cluster_id"]
#: Width of the chunks along which a recording is cut where the order of its spikes matters.
CHUNK = 1 << 23


def clusters_of(spikes: DataFrame) -> DataFrame:
    """Every cluster of every recording."""
    return spikes.select(*KEY).distinct()


def cluster_counts(spikes: DataFrame) -> DataFrame:
    """Spikes per cluster: all, cutoff, and the rest."""
    return spikes.groupBy(*KEY).agg(F.count_if(~F.col("is_cutoff")).alias("n_spikes"), F.count_if("is_cutoff").alias("n_cutoff"), F.count(F.lit(1)).alias("n_all"))


def basic_stats(spikes: DataFrame, fs: float, above_hz: float = 3.0) -> DataFrame:
    """Per recording: spikes, clusters, seconds, clusters that fire above ``above_hz`` and their spikes."""
    per = spikes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("spike_time").alias("last"))
    w = Window.partitionBy("recording_id")
    per = per.withColumn("seconds", F.max("last").over(w) / fs).withColumn("rate", F.col("n") / F.col("seconds"))
    fast = F.col("rate") > above_hz
    return per.groupBy("recording_id").agg(F.sum("n").alias("n_spikes"), F.count(F.lit(1)).alias("n_clusters"), F.max("seconds").alias("seconds"), F.count_if(fast).alias("n_fast"), F.coalesce(F.sum(F.when(fast, F.col("n"))), F.lit(0)).alias("spikes_fast"))


def binned_counts(spikes: DataFrame, width: int) -> DataFrame:
    """Spikes per cluster and bin of ``width`` samples; bins without spikes have no row."""
    return spikes.groupBy(*KEY, F.floor(F.col("spike_time") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def valid_span(binned: DataFrame, least: int = 5) -> DataFrame:
    """Per cluster: first and last bin with ``least`` spikes, and share of valid bins between.

    A single bin that falls short between two valid ones counts as valid.
    """
    good = binned.where(F.col("n") >= least)
    w = Window.partitionBy(*KEY).orderBy("bin")
    step = F.col("bin") - F.lag("bin").over(w)
    return good.withColumn("held", F.when(step == 2, 2).otherwise(1)).groupBy(*KEY).agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("held").alias("n_valid")).withColumn("share", F.col("n_valid") / (F.col("last_bin") - F.col("first_bin") + 1))


def correlogram(a: DataFrame, b: DataFrame, bin_width: int, n_bins: int, same: bool) -> DataFrame:
    """Counts of lags ``b - a`` per recording, pair of clusters and bin, lags nearer than n_bins * width.

    Bins are rounded half away from zero; with ``same`` a spike isn't paired with itself.
    """
    keys = KEY if same else ["recording_id"]
    left = a.select(*keys, F.col("cluster_id").alias("cluster_a"), F.col("spike_id").alias("_ia"), F.col("spike_time").alias("_ta"))
    right = b.select(*keys, F.col("cluster_id").alias("cluster_b"), F.col("spike_id").alias("_ib"), F.col("spike_time").alias("_tb"))
    reach = bin_width * n_bins - 1
    pairs = band_join(left, right, keys, "_ta", "_tb", -reach, reach)
    if same:
        pairs = pairs.where("_ia <> _ib")
    return pairs.groupBy("recording_id", "cluster_a", "cluster_b", F.round((F.col("_tb") - F.col("_ta")) / bin_width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def auto_lags(spikes: DataFrame, low: int, high: int) -> DataFrame:
    """Consecutive spikes of a cluster with a lag in [low, high]."""
    rows = with_previous(spikes.select(*KEY, "spike_id", "spike_time"), KEY, "spike_time", ["spike_id"], ["spike_id", "spike_time"], CHUNK)
    rows = rows.select(*KEY, F.col("prev_spike_id").alias("spike_id"), F.col("prev_spike_time").alias("spike_time"), F.col("spike_id").alias("next_id"), (F.col("spike_time") - F.col("prev_spike_time")).alias("lag"))
    return rows.where(F.col("lag").between(low, high))


def pair_lags(a: DataFrame, b: DataFrame, centre: int, radius: int, keys: list[str]) -> DataFrame:
    """Spikes of ``b`` whose lag to a spike of ``a`` with the same keys lies within ``radius`` of ``centre``."""
    left = a.select(*keys, F.col("spike_id").alias("id_a"), F.col("spike_time").alias("_ta"))
    right = b.select(*keys, F.col("spike_id").alias("id_b"), F.col("spike_time").alias("_tb"))
    return band_join(left, right, keys, "_ta", "_tb", centre - radius, centre + radius).select(*keys, "id_a", "id_b", (F.col("_tb") - F.col("_ta")).alias("lag"))


def cover(spikes: DataFrame, others: DataFrame, n: int, window: int) -> DataFrame:
    """For each spike the tightest window that holds a spike of each of ``n`` other clusters.

    ``others`` has (recording_id, cluster_id, member, spike_time): spikes of cluster ``member`` that windows around
    spikes of ``cluster_id`` must hold. (recording_id, spike_id, width): the smallest largest distance, per spike
    that has all ``n`` within ``window``.
    """
    first = spikes.select(*KEY, "spike_id", F.col("spike_time").alias("_t"))
    near = band_join(first, others.select(*KEY, "member", F.col("spike_time").alias("_u")), KEY, "_t", "_u", -window, window)
    best = near.groupBy("recording_id", "spike_id", "member").agg(F.min(F.abs(F.col("_u") - F.col("_t"))).alias("d"))
    return best.groupBy("recording_id", "spike_id").agg(F.max("d").alias("width"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).drop("_n")


def template_use(spikes: DataFrame) -> DataFrame:
    """Uses of each template per cluster, their share, and rank by use."""
    used = spikes.where("template_id is not null").groupBy(*KEY, "template_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*KEY)
    return used.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "template_id")))


def sample_per_cluster(spikes: DataFrame, n: int, by: str = "first") -> DataFrame:
    """Up to ``n`` spikes per cluster: the first, the largest, or those of smallest hash."""
    order = {"first": [F.col("spike_time"), F.col("spike_id")], "largest": [F.desc_nulls_last("amplitude"), F.col("spike_id")], "hash": [F.xxhash64("spike_id"), F.col("spike_id")]}[by]
    return spikes.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where(F.col("rank") <= n)


def accept_cutoff(spikes: DataFrame) -> DataFrame:
    """Cutoff spikes taken in among the others."""
    return spikes.withColumn("is_cutoff", F.lit(False))


def splice(spikes: DataFrame, again: DataFrame, windows: DataFrame) -> DataFrame:
    """Spikes with those inside ``windows`` (recording_id, w_lo, w_hi) replaced by ``again``."""
    kept = interval_join(spikes, windows, ["recording_id"], "spike_time", "w_lo", "w_hi", BUCKET, "left_anti")
    return kept.unionByName(again, allowMissingColumns=True)


def islands(spikes: DataFrame, within: int) -> DataFrame:
    """Spikes with ``isle``: the number of the chunk and the place in it at which their island begins.

    An island ends where the pause to the next spike of the recording is at least ``within``. Time is cut into chunks;
    islands that reach over a chunk's end are stitched on one row a chunk.
    """
    rows = with_previous(spikes, ["recording_id"], "spike_time", ["spike_id"], ["spike_time"], CHUNK).withColumn("_c", F.floor(F.col("spike_time") / CHUNK))
    fresh = F.col("prev_spike_time").isNull() | (F.col("spike_time") - F.col("prev_spike_time") >= within)
    w = Window.partitionBy("recording_id", "_c").orderBy("spike_time", "spike_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_f", fresh.cast("int")).withColumn("_k", F.sum("_f").over(w))
    chunks = rows.groupBy("recording_id", "_c").agg(F.sum("_f").alias("_n"))
    before = Window.partitionBy("recording_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.last(F.when(F.col("_n") > 0, F.struct("_c", "_n")), ignorenulls=True).over(before)
    chunks = chunks.select("recording_id", "_c", open_.alias("_open"))
    rows = rows.join(chunks, ["recording_id", "_c"])
    return rows.withColumn("isle", F.when(F.col("_k") > 0, F.struct(F.col("_c"), F.col("_k").alias("_n"))).otherwise(F.col("_open"))).drop("_c", "_f", "_k", "_open", "prev_spike_time")


def duplicates(spikes: DataFrame, within: int, reach: float | None = None) -> DataFrame:
    """Spikes that duplicate an earlier one, in time order and greedily: (recording_id, spike_id, of_spike).

    A spike not marked itself marks every later one less than ``within`` samples on whose template lies less than ``reach``
    away (``x``, ``y`` hold the places of the templates; a template without a place is near none), or any if no reach is given; the last
    spike to mark another is the one reported. Only inside an island of spikes closer than ``within`` the order matters.
    """
    places = [F.col(c).cast("double").alias(c) for c in ("x", "y")] if reach is not None else [F.lit(0.0).alias("x"), F.lit(0.0).alias("y")]
    isles = islands(spikes.select("recording_id", "spike_id", "spike_time", *places), within)
    crowded = isles.groupBy("recording_id", "isle").agg(F.array_sort(F.collect_list(F.struct("spike_time", "spike_id", "x", "y"))).alias("s")).where(F.size("s") > 1)
    far = float("inf") if reach is None else reach

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            record, which, of = [], [], []
            lists = b.column(1)
            ends, e = lists.offsets.to_numpy(), lists.values
            t, ids = e.field("spike_time").to_numpy(), e.field("spike_id").to_numpy()
            x, y = (e.field(c).to_numpy(zero_copy_only=False) for c in "xy")
            for r, name in enumerate(b.column(0).to_pylist()):
                lo, hi = ends[r], ends[r + 1]
                dup = np.full(hi - lo, -1, np.int64)
                until = np.searchsorted(t[lo:hi], t[lo:hi] + within, "left")
                for i in range(hi - lo):
                    if dup[i] >= 0:
                        continue
                    j = np.arange(i + 1, until[i])
                    near = np.hypot(x[lo + j] - x[lo + i], y[lo + j] - y[lo + i]) < far
                    dup[j[near]] = i
                got = np.flatnonzero(dup >= 0)
                record += [name] * len(got)
                which.append(ids[lo + got])
                of.append(ids[lo + dup[got]])
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(record, b.schema.field(0).type), pa.array(np.concatenate([none, *which])), pa.array(np.concatenate([none, *of]))], ["recording_id", "spike_id", "of_spike"])

    return crowded.select("recording_id", "s").mapInArrow(mark, "recording_id int, spike_id bigint, of_spike bigint")


def groups_by_lags(spikes: DataFrame, short: int, least: int, good: float, mua: float) -> DataFrame:
    """(recording_id, cluster_id, label): good, mua or noise by the share of lags below ``short``; unsorted below ``least`` spikes."""
    rows = with_previous(spikes, KEY, "spike_time", ["spike_id"], ["spike_time"], CHUNK)
    share = F.count_if(F.col("spike_time") - F.col("prev_spike_time") < short) / F.count(F.lit(1))
    per = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), share.alias("_v"))
    label = F.when(F.col("_n") < least, "unsorted").when(F.col("_v") < good, "good").when(F.col("_v") < mua, "mua").otherwise("noise")
    return per.select(*KEY, label.alias("label"))
