import numpy as np
from pyspark.sql import functions as F

from voltlake.operators import templates as t


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3)) @ np.array([[3.0, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0)], "a double, b double, c double")
    mean, comps, share = t.principal_components(df, [F.col(c) for c in "abc"], 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(mean, x.mean(0))
    for k in range(2):
        assert abs(abs(comps[k] @ vectors[:, -1 - k]) - 1) < 1e-6
    assert np.allclose(share, values[::-1][:2] / values.sum())
    assert np.isnan(t.principal_components(df.limit(0), [F.col("a")], 1)[1]).all()


def test_reconstruct_adds_up_overlapping_spikes(spark):
    spikes = spark.createDataFrame([(1, 1, 10, 5, 2.0), (2, 1, 11, 5, 1.0), (3, 2, 10, 5, 9.0), (4, 1, 10, 6, 9.0)], "spike_id bigint, recording_id int, spike_time bigint, template_id int, amplitude double")
    windows = spark.createDataFrame([(1, 7, 9, 12)], "recording_id int, window_id bigint, w_lo bigint, w_hi bigint")
    shapes = spark.createDataFrame([(1, 5, 3, [1.0, -2.0, 1.0]), (1, 5, 4, [0.0, 1.0, 0.0])], "recording_id int, template_id int, channel_id int, w array<double>")
    got = {(r.channel_id, r.sample_idx): r.v for r in t.reconstruct(spikes, windows, shapes, 1, 1).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 3} == {9: 2.0, 10: -3.0, 11: 0.0, 12: 1.0}
    assert {k[1]: v for k, v in got.items() if k[0] == 4} == {9: 0.0, 10: 2.0, 11: 1.0, 12: 0.0}


def test_nearest_and_drift(spark):
    c = spark.createDataFrame([(1, k, [float(v), 0.0]) for k, v in enumerate([0, 3, 4, 10])], "r int, k int, c array<double>")
    pairs = t.distances(c, ["r"], "k")
    assert pairs.count() == 6 and t.drift_distance(pairs, ["r"]).first().drift == 10
    assert {(r.k, r.other) for r in t.most_similar(pairs, ["r"], "k", 1).collect()} == {(0, 1), (1, 2), (2, 1), (3, 2)}
