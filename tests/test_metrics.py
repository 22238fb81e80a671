import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators import channels, curation, drift, joins, metrics, signal, spikes, tensor, timeshift, trials

EXTRA = "x string, y string, n string"


def points(spark, n=300, seed=1, span=1000):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randrange(span)) for i in range(n)] + [(1, n, None)]
    return rows, spark.createDataFrame(rows, "k int, id bigint, t bigint").repartition(3)


@pytest.mark.parametrize("chunk", [7, 100, 10_000])
def test_previous_and_numbers_over_chunks(spark, chunk):
    rows, df = points(spark)
    want, place = {}, {}
    for key in (1, 2, None):
        own = sorted((t, i) for k, i, t in rows if k == key and t is not None)
        for n, (t, i) in enumerate(own):
            want[i] = own[n - 1][1] if n else None
            place[i] = n + 1
    got = joins.with_previous(df, ["k"], "t", ["id"], ["id"], chunk).collect()
    assert {r.id: r.prev_id for r in got} == want and len(got) == len(want)
    got = joins.numbered(df, ["k"], "t", ["id"], chunk, "place").collect()
    assert {r.id: r.place for r in got} == place and len(got) == len(place)


@pytest.mark.parametrize("chunk", [9, 10_000])
def test_as_of_over_chunks(spark, chunk):
    rows, df = points(spark, 120)
    marks = [(1, 50, 0), (1, 300, 1), (1, 301, 2), (2, 900, 3)]
    got = joins.as_of(df.where("k is not null and t is not null"), spark.createDataFrame(marks, "k int, m bigint, v int"), ["k"], "t", "m", "v", chunk).collect()
    for r in got:
        before = [v for k, m, v in marks if k == r.k and m <= r.t]
        assert r.v == (before[-1] if before else None)
    assert len(got) == sum(1 for k, _, t in rows if k is not None and t is not None)


@pytest.mark.parametrize("chunk", [11, 64, 1 << 20])
def test_islands_and_duplicates_over_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(spikes, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(rng.choice([1, 2]), i, rng.randrange(600), float(rng.choice([0, 10, 100])), 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "recording_id int, spike_id bigint, spike_time bigint, x double, y double")
    want = {}
    for rec in (1, 2):
        own = sorted((t, i, x) for r, i, t, x, _ in rows if r == rec)
        marked = {}
        for a, (t, i, x) in enumerate(own):
            if i in marked:
                continue
            for u, j, z in own[a + 1 :]:
                if u < t + 6 and abs(x - z) < 50:
                    marked[j] = i
        want |= marked
    assert {r.spike_id: r.of_spike for r in spikes.duplicates(df, 6, 50.0).collect()} == want
    isles = {}
    for r in spikes.islands(df, 6).collect():
        isles.setdefault((r.recording_id, r.isle), []).append(r.spike_time)
    true = {}
    for rec in (1, 2):
        last, name = None, None
        for t in sorted(t for r, _, t, *_ in rows if r == rec):
            name = t if last is None or t - last >= 6 else name
            true.setdefault((rec, name), []).append(t)
            last = t
    assert sorted(map(sorted, isles.values())) == sorted(map(sorted, true.values()))


def test_common_gain_golden(spark):
    df = spark.createDataFrame([(1, 1, 250), (1, 2, 500), (2, 1, 3), (2, 2, None), (3, 1, 0)], "recording_id int, file_ord int, gain_x bigint")
    got = {(r.recording_id, r.file_ord): (r.common_gain, r.times) for r in channels.common_gains(df).collect()}
    assert got == {(1, 1): (500, 2), (1, 2): (500, 1), (2, 1): (3, 1)}


def templates(spark, rows):
    return spark.createDataFrame(rows, "recording_id int, template_id int, channel_id int, w array<double>")


def test_similarity_finds_the_lag(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([np.zeros(5), rng.normal(size=20), np.zeros(5)])
    t = templates(spark, [(1, 0, 4, a.tolist()), (1, 1, 4, np.roll(a, 3).tolist()), (1, 2, 9, a.tolist()), (1, 3, 4, (-a).tolist()), (2, 0, 4, a.tolist())])
    got = {(r.template_id, r.other): (round(r.similarity, 6), r.lag) for r in metrics.similarity(t, 6).collect()}
    assert got[0, 1] == (1.0, 3) and got[1, 0] == (1.0, -3)
    assert (0, 2) not in got and all(0 <= s <= 1 for s, _ in got.values())
    assert metrics.similarity(t.limit(0), 6).count() == 0


def test_unwhitening_by_a_full_matrix(spark):
    rng = np.random.default_rng(1)
    t, m = rng.normal(size=(3, 8)), rng.normal(size=(3, 3))
    rows = templates(spark, [(1, 0, c, t[c].tolist()) for c in range(3)])
    inverse = spark.createDataFrame([(1, i, j, float(m[i, j])) for i in range(3) for j in range(3)], "recording_id int, channel_id int, to_channel int, f double")
    got = {r.channel_id: r.w for r in metrics.unwhitened(rows, inverse).collect()}
    assert np.allclose([got[c] for c in range(3)], m.T @ t)


def test_spike_places(spark):
    ch = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 30.0)], "channel_id int, pos_x double, pos_y double")
    best = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2)], "recording_id int, template_id int, channel_id int, rank int")
    sizes = spark.createDataFrame([(1, 0, 50.0)], "recording_id int, template_id int, amplitude double")
    rows = [(1, 1, 0, 2.0, [[1.0, 9.0], [2.0, 9.0]]), (2, 1, 0, 2.0, [[3.0], [-5.0]]), (3, 1, 0, 2.0, [[-1.0], [-1.0]]), (4, 1, 0, 2.0, None), (5, 1, 7, 2.0, [[1.0], [1.0]]), (6, 1, None, 1.0, [[None], [2.0]])]
    df = spark.createDataFrame(rows, "spike_id bigint, recording_id int, template_id int, amplitude double, pc_features array<array<float>>")
    got = {r.spike_id: (r.uv, r.y) for r in metrics.spike_places(df, best, ch, sizes).collect()}
    assert got == {1: (100.0, 24.0), 2: (100.0, 0.0), 3: (100.0, None), 4: (100.0, None), 5: (None, None), 6: (None, None)}


def test_offsets_of_a_moving_probe(spark):
    shift = [0, 1, 2, 3, 2]
    rows = [(1, t, 20 + s + d, float(w)) for t, s in enumerate(shift) for d, w in enumerate([5, 1, 0, 9, 2, 7])]
    got = drift.offsets(spark.createDataFrame(rows, "recording_id int, time_bin bigint, depth_bin bigint, weight double"), 10.0, 4).collect()
    assert {r.time_bin: r.offset_um for r in got} == {t: 10.0 * s for t, s in enumerate(shift)}


def test_quantiles_from_counts(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=501), 2)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)] + [(0, None), (0, float("nan"))], "k int, v double")
    got = {r.k: (r.n, r.q, r.p) for r in drift.counted_quantiles(df, ["k"], F.col("v"), 0.01, {"q": 0.5, "p": 0.9}).collect()}
    for k in (0, 1):
        own = np.sort(x[k::2])
        assert got[k][0] == len(own) and np.allclose(got[k][1:], [own[int(np.ceil(p * len(own))) - 1] for p in (0.5, 0.9)])


def test_curation_tables(spark):
    r = spark.createDataFrame([(1, 1, 3, True), (1, 2, 0, False)], "recording_id int, cluster_id int, rating int, flag boolean")
    new = spark.createDataFrame([(1, 2, 4), (1, 9, 1), (1, 1, None)], "recording_id int, cluster_id int, rating int")
    assert sorted((x.cluster_id, x.rating, x.flag) for x in curation.upsert(r, new).collect()) == [(1, 3, True), (2, 4, False), (9, 1, None)]
    own = spark.createDataFrame([(1, 2), (1, 5)], "recording_id int, cluster_id int")
    assert sorted((x.cluster_id, x.rating) for x in curation.realign(r, own, {"rating": 7}).collect()) == [(2, 0), (5, 7)]
    m = spark.createDataFrame([(1, 1, 1), (1, 4, 1), (1, 6, 1), (1, 8, 8)], "recording_id int, cluster_id int, new_id int")
    assert sorted((x.cluster_id, x.partners) for x in curation.merge_partners(m).collect()) == [(1, [4, 6]), (4, [1, 6]), (6, [1, 4])]


def test_small_tables(spark):
    parts = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 1, 6), (1, 1, 5)], "r int, f int, c int")
    assert [tuple(x) for x in joins.in_all(parts, ["r"], "f", "c").collect()] == [(1, 5)]
    spec = spark.createDataFrame([(1, 1, 10, 19, 1), (1, 2, 30, 39, 5)], "recording_id int, ord int, idx_start bigint, idx_stop bigint, shift_start bigint")
    slots = spark.createDataFrame([(1, i, s) for i, s in enumerate([1, 4, 5, 10, 14, 15])], "recording_id int, id bigint, s bigint")
    assert {x.s: x.source_idx for x in timeshift.source_index(slots, spec, "s", "id").collect()} == {1: 10, 4: 13, 5: 30, 10: 35, 14: 39, 15: 0}
    t = spark.createDataFrame([(i,) for i in range(9)], "trial_id int")
    assert [x[0] for x in trials.pick(t, [1, 4, 6, 8], 2, 6).collect()] == [4, 6]
    got = tensor.ragged(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 3, "z"), (2, 1, "c")], "k int, o int, v string"), ["k"], ["o"], "v", "l").collect()
    assert {x.k: x.l for x in got} == {1: ["a", "b"], 2: ["c"]}
    grid = spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(map(tuple, tensor.inflated(spark.createDataFrame([(2, 5.0)], "k int, v double"), grid, ["k"], {"v": -1.0}).collect())) == [(1, -1.0), (2, 5.0)]


def test_window_of_samples(spark):
    rows = [(1, i, [i, -i]) for i in range(1, 9)] + [(1, 3, [3, -3]), (1, None, [0, 0]), (1, 4, None)]
    df = spark.createDataFrame(rows, "f int, sample_idx bigint, x array<smallint>")
    got = {r.sample_idx: r.uv for r in signal.read_window(df, ["f"], 0, 3, 0.5).collect()}
    assert got == {1: [0.5, -0.5], 2: [1.0, -1.0], 3: [1.5, -1.5]}


def test_lowess_against_a_plain_fit():
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(100, 40, replace=False))
    y = rng.normal(size=40)
    got = drift.lowess(x, y, 0.3)
    for i in range(40):
        d = np.abs(x - x[i])
        near = np.argsort(d, kind="stable")[:12]
        if (np.sort(d)[11] == d).sum() > 1:
            continue  # which of equally far points counts isn't settled, and it weighs nothing
        w = np.clip(1 - (d[near] / d[near].max()) ** 3, 0, None) ** 3
        a = np.polyfit(x[near], y[near], 1, w=np.sqrt(w))
        assert abs(np.polyval(a, x[i]) - got[i]) < 1e-5
    assert np.allclose(drift.lowess(np.arange(20), 3.0 * np.arange(20) + 1, 0.4), 3.0 * np.arange(20) + 1)
    assert drift.lowess(np.arange(2), np.array([1.0, 5.0]), 0.5).tolist() == [1.0, 5.0] and len(drift.lowess(np.empty(0), np.empty(0), 0.5)) == 0


def test_traces_are_smoothed_between_gaps(spark):
    rows = [(1, 7, t, 2.0 * t, t == 20) for t in [*range(8), *range(20, 26)]] + [(2, 7, 3, 1.0, False)]
    df = spark.createDataFrame(rows, "recording_id int, cluster_id bigint, time_bin bigint, depth double, after_gap boolean")
    got = {(r.recording_id, r.time_bin): (r.part, round(r.smooth, 6)) for r in drift.smoothed_trace(df).collect()}
    assert got == {(r, t): (int(r == 1 and t >= 20), 2.0 * t if r == 1 else 1.0) for r, _, t, *_ in rows}
    assert drift.smoothed_trace(df.limit(0)).count() == 0


def test_sections_by_blocks_are_those_sample_by_sample():
    rng = np.random.default_rng(5)
    sections = signal.butterworth_highpass(3, 300.0, 30000.0)
    for n in (0, 1, 63, 64, 200):
        x = rng.normal(size=(3, n))
        want = x
        for c in sections:
            out = np.zeros_like(want)
            for t in range(n):
                u = lambda a, k: a[:, t - k] if t >= k else 0.0
                out[:, t] = c[0] * u(want, 0) + c[1] * u(want, 1) + c[2] * u(want, 2) - c[3] * u(out, 1) - c[4] * u(out, 2)
            want = out
        assert np.allclose(signal._run_sections(x, sections, 64), want)
