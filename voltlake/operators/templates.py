"""Cluster centroids and templates: distances, similarity, reconstruction, principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.joins import band_join, interval_join
from voltlake.operators.trials import BUCKET


def feature_centroids(spikes: DataFrame, keys: list[str], features: list) -> DataFrame:
    """Mean of each feature per group, as an array ``c``; spikes without features are left out."""
    names = [f"_f{i}" for i in range(len(features))]
    rows = spikes.select(*keys, *(f.cast("double").alias(n) for f, n in zip(features, names))).dropna(subset=names)
    return rows.groupBy(*keys).agg(F.array(*(F.avg(n) for n in names)).alias("c"), F.count(F.lit(1)).alias("n"))


def _distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distances(centroids: DataFrame, within: list[str], key: str) -> DataFrame:
    """Distances between the centroids of one group, each pair once: (within, key, other, distance).

    For clusters of a recording or batches of a cluster, of which there are a few dozen.
    """
    other = centroids.select(*within, F.col(key).alias("other"), F.col("c").alias("_o"))
    return centroids.join(other, within).where(F.col(key) < F.col("other")).select(*within, key, "other", _distance("c", "_o").alias("distance"))


def most_similar(pairs: DataFrame, within: list[str], key: str, k: int) -> DataFrame:
    """The ``k`` nearest others of each, ties by id."""
    both = pairs.unionByName(pairs.select(*within, F.col("other").alias(key), F.col(key).alias("other"), "distance"))
    rank = F.row_number().over(Window.partitionBy(*within, key).orderBy("distance", "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def drift_distance(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Largest distance between two batches' centroids of a cluster."""
    return pairs.groupBy(*keys).agg(F.max("distance").alias("drift"))


def overlapping(spikes: DataFrame, windows: DataFrame, before: int, after: int) -> DataFrame:
    """Spikes whose template, from ``before`` to ``after`` samples around them, touches a window.

    ``windows`` has (recording_id, window_id, w_lo, w_hi).
    """
    wide = windows.select("recording_id", "window_id", (F.col("w_lo") - after).alias("_lo"), (F.col("w_hi") + before).alias("_hi"), "w_lo", "w_hi")
    return interval_join(spikes, wide, ["recording_id"], "spike_time", "_lo", "_hi", BUCKET).drop("_lo", "_hi")


def reconstruct(spikes: DataFrame, windows: DataFrame, templates: DataFrame, before: int, after: int) -> DataFrame:
    """Sum of amplitude times template on every channel and sample of a window that a spike reaches: (window_id, channel_id, sample_idx, v).

    ``templates`` has (recording_id, template_id, channel_id, w), ``w`` from ``before`` samples before a spike to ``after`` after it.
    """
    near = overlapping(spikes, windows, before, after).select("recording_id", "window_id", "template_id", "amplitude", "w_lo", "w_hi", "spike_time")
    near = near.join(templates, ["recording_id", "template_id"]).select("window_id", "channel_id", "amplitude", "w_lo", "w_hi", "spike_time", F.posexplode("w").alias("_p", "_v"))
    near = near.withColumn("sample_idx", F.col("spike_time") + F.col("_p") - before)
    inside = near.where(F.col("sample_idx").between(F.col("w_lo"), F.col("w_hi")))
    return inside.groupBy("window_id", "channel_id", "sample_idx").agg(F.sum(F.col("amplitude") * F.col("_v")).alias("v"))


def snippet_samples(requests: DataFrame, samples: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Samples at ``low`` to ``high`` around each requested index: (*keys, request_id, offset, x)."""
    got = band_join(requests.select(*keys, "request_id", F.col("at").alias("_at")), samples.select(*keys, F.col("sample_idx").alias("_s"), "x"), keys, "_at", "_s", low, high)
    return got.select(*keys, "request_id", (F.col("_s") - F.col("_at")).alias("offset"), "x")


def moments(rows: DataFrame, columns: list) -> DataFrame:
    """(i, j, n, mean_i, mean_j, cov): means and covariances of all pairs of columns, in one aggregation; rows with a null are left out."""
    names = [f"_{i}" for i in range(len(columns))]
    x = rows.select(*(c.cast("double").alias(n) for c, n in zip(columns, names))).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.count(F.lit(1)).alias("n"), F.avg(names[i]).alias("mean_i"), F.avg(names[j]).alias("mean_j"), F.covar_samp(names[i], names[j]).alias("cov")) for i, j in pairs))
    return x.agg(cells.alias("c")).select(F.inline("c"))


def principal_components(rows: DataFrame, columns: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (one a row, largest element positive) and explained shares of the columns.

    The moments are one aggregation; only they come to the driver. Rows with a null are left out.
    """
    d = len(columns)
    got = moments(rows, columns).collect()
    if not got or got[0]["n"] < 2:
        return np.full(d, np.nan), np.full((k, d), np.nan), np.full(k, np.nan)
    mean, cov = np.zeros(d), np.zeros((d, d))
    for r in got:
        mean[r["i"]] = r["mean_i"]
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    comps = vectors[:, order].T
    comps *= np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)])[:, None]
    return mean, comps, values[order] / values.sum()
