import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.functions import scalars
from voltlake.operators import channels, curation, joins, signal, spikes, tensor, timeshift
from voltlake.plans import reference
from voltlake.sources import ini, npy, raw
from voltlake.streaming.binned import windowed_counts


def test_discretize_documented_example(spark):
    values = [0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4.5]
    df = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(values)], "row_id int, k int, at double")
    win = spark.createDataFrame([(1, 1, 0.5, 1.5), (1, 2, 1.5, 2.5), (1, 3, 3.5, 4.5)], "k int, window_ord int, w_lo double, w_hi double")
    got = joins.discretize(df, win, ["k"], "at", 1).orderBy("row_id").collect()
    assert [r.window_ord for r in got] == [1, 1, 2, 2, 2, None, 3, 3]


def test_band_join_against_brute_force(spark):
    rng = random.Random(3)
    a = [(rng.randrange(2), i, rng.randrange(200)) for i in range(60)]
    b = [(rng.randrange(2), i, rng.randrange(200)) for i in range(60)]
    got = joins.band_join(spark.createDataFrame(a, "k int, i int, t int"), spark.createDataFrame(b, "k int, j int, u int"), ["k"], "t", "u", -3, 7)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and -3 <= y[2] - x[2] <= 7)


def test_lookup_raises_on_a_missing_key(spark):
    df, t = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert joins.lookup(df.where("k = 1"), t, ["k"]).collect()[0].v == "a"
    with pytest.raises(Exception, match="no entry"):
        joins.lookup(df, t, ["k"]).collect()


def test_as_of(spark):
    p = spark.createDataFrame([(1, 5), (1, 10), (1, 11), (2, 3)], "k int, t int")
    m = spark.createDataFrame([(1, 10, "b0"), (1, 0, "a")], "k int, s int, name string")
    got = {(r.k, r.t): r["name"] for r in joins.as_of(p, m, ["k"], "t", "s", "name").collect()}
    assert got == {(1, 5): "a", (1, 10): "b0", (1, 11): "b0", (2, 3): None}


def greedy(times, within):
    dup = {}
    for i in range(len(times)):
        if i in dup:
            continue
        for j in range(i + 1, len(times)):
            if times[j] - times[i] < within and j not in dup:
                dup[j] = i
    return dup


def test_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    t = sorted(rng.randrange(400) for _ in range(120))
    df = spark.createDataFrame([(1, i, x, 1) for i, x in enumerate(t)], "recording_id int, spike_id bigint, spike_time bigint, template_id int")
    got = {r.spike_id: r.of_spike for r in spikes.duplicates(df, 5).collect()}
    assert got == greedy(t, 5)
    far = df.selectExpr("*", "100.0 * spike_id as x", "0.0 as y")
    assert spikes.duplicates(far, 5, 50.0).count() == 0
    assert {r.spike_id: r.of_spike for r in spikes.duplicates(far, 5, 1e9).collect()} == greedy(t, 5)
    assert spikes.duplicates(df.selectExpr("*", "cast(null as double) as x", "0.0 as y"), 5, 50.0).count() == 0
    assert spikes.duplicates(df.limit(0), 5).count() == 0


def test_merge_sets_are_transitive(spark):
    pairs = [(1, i, i + 1) for i in range(12) if i != 6] + [(2, 3, 9), (2, 9, 3), (2, 3, 3), (2, None, 4)]
    got = {(r.recording_id, r.cluster_id): r.new_id for r in curation.merge_sets(spark.createDataFrame(pairs, "recording_id int, a int, b int")).collect()}
    assert got == {**{(1, i): 0 for i in range(7)}, **{(1, i): 7 for i in range(7, 13)}, (2, 3): 3, (2, 9): 3}


def test_shift_and_back(spark):
    spec = timeshift.excise_gaps(spark.createDataFrame([(1, 10, 19), (1, 50, 59)], "recording_id int, idx_start bigint, idx_stop bigint"))
    t = spark.createDataFrame([(1, x) for x in (9, 10, 19, 30, 50, 59, 60)], "recording_id int, t bigint")
    moved = timeshift.shift(t, spec, "t")
    assert sorted((r.t, r.shifted) for r in moved.collect()) == [(10, 1), (19, 10), (50, 11), (59, 20)]
    assert all(r.t == r.source for r in timeshift.unshift(moved, spec, "shifted").collect())
    assert timeshift.from_text(timeshift.to_text([(1, 2, 3), (4, 5, 6)])) == [(1, 2, 3), (4, 5, 6)]


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, 12, 18, [1.0, -3.0, 3.0])], "v double, a int, b int, w array<double>")
    r = df.select(scalars.sat_int16(F.col("v") * 1e6).alias("s"), scalars.sat_int16(-F.col("v")).alias("h"), scalars.gcd(F.col("a"), F.col("b")).alias("g"), scalars.signed_peak(F.col("w")).alias("p"), scalars.argmin(F.col("w")).alias("m")).first()
    assert tuple(r) == (32767, -3, 6, 3.0, 2)
    assert channels.common_gain([50, 125, 250]) == 250


def test_common_average_and_notch():
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 10, (8, 400)) + np.arange(8)[:, None] * 50 + 30 * np.sin(np.arange(400))[None]).astype(np.int16)
    y = signal.common_average(x)
    assert abs(np.median(y, axis=0)).max() <= 1 and y.std() < x.std()
    line = (rng.normal(0, 5, (2, 4000)) + 200 * np.sin(2 * np.pi * 0.05 * np.arange(4000))).astype(np.int16)
    assert signal.notch_lines(line).std() < 20
    slow = np.full((1, 2000), 100, np.int16)
    assert abs(signal.zero_phase_highpass(slow, 300, 30000)[:, 500:1500]).max() <= 1


def test_transform_chunks(spark):
    rows = [(1, i, [i % 7, i % 5, 3]) for i in range(1, 51)] + [(1, 4, [4, 4, 3]), (1, None, [0, 0, 0]), (1, 60, None)]
    df = spark.createDataFrame(rows, "r int, sample_idx bigint, x array<smallint>")
    out = signal.transform_chunks(df, ["r"], [lambda x: x, lambda x, idx: (x + (idx > 0)).astype(np.int16)], 16, 4)
    got = sorted((r.sample_idx, tuple(r.x)) for r in out.collect())
    assert got == [(i, (i % 7 + 1, i % 5 + 1, 4)) for i in range(1, 51)]


@pytest.mark.parametrize("n,chunk,before,after", [(10, 3, 2, 1), (1, 5, 1, 1), (12, 4, 0, 0)])
def test_chunk_plan_covers_all(n, chunk, before, after):
    p = raw.chunk_plan(n, chunk, before, after)
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(p.keep_lo, p.keep_hi)]).tolist() == list(range(1, n + 1))
    assert (p.read_lo <= p.keep_lo).all() and (p.read_hi >= p.keep_hi).all() and p.read_lo.min() >= 1 and p.read_hi.max() <= n


def test_npy_round_trip(spark, tmp_path):
    for x in (np.arange(7, dtype=">u4"), np.asfortranarray(np.arange(12.0).reshape(4, 3)), np.arange(24, dtype=np.int16).reshape(2, 3, 4)):
        np.save(tmp_path / "a.npy", x)
        df = npy.read_npy(spark, str(tmp_path / "a.npy"), rows_each=2)
        assert [r.v for r in df.orderBy("row_idx").collect()] == x.tolist()
        npy.write_npy(df, "row_idx", "v", str(tmp_path / "b.npy"), x.dtype.str)
        assert (np.load(tmp_path / "b.npy") == x).all()


def test_raw_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).integers(-32768, 32767, (50, 3)).astype("<i2")
    x.tofile(tmp_path / "a.bin")
    df = raw.read_raw(spark, str(tmp_path / "a.bin"), 3, chunk=16)
    assert [r.x for r in df.orderBy("sample_idx").collect()] == x.tolist()
    assert raw.write_raw(df, str(tmp_path / "b.bin")) == 50 and (tmp_path / "b.bin").read_bytes() == x.tobytes()


def test_ini(spark, tmp_path):
    text = "nSavedChans=385\n~imroTbl=(1,2)(0 0)\nrate = 30000.5\nlist=1;2;3\nflag=true\nname='a b'\nnone=NaN\n# c\nset={1,x}\n"
    got = ini.parse(text)
    assert got == {"nSavedChans": 385, "imroTbl": "(1,2)(0 0)", "rate": 30000.5, "list": [1, 2, 3], "flag": True, "name": "a b", "none": None, "set": [1, "x"]}
    assert ini.parse(ini.render({"a": [1, 2], "b": None, "c": True})) == {"a": [1, 2], "b": None, "c": True}
    (tmp_path / "x.meta").write_text(text)
    assert {r.meta_key: r.meta_value for r in ini.read_ini(spark, str(tmp_path)).collect()}["imroTbl"] == "(1,2)(0 0)"
    assert ini.recording_file("r1.imec3.ap.bin") == ("r1", 3, "ap") and ini.recording_file("x.txt") is None


def test_tensor(spark):
    t = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, float("nan"), 1.0, 3.0, 0.0], 1)], "k int, i int, v double")
    r = tensor.arg_extreme(t, "i", ["k"]).first()
    assert (r.at_min, r.at_max) == (5, 1)
    assert tensor.reduce_dims(t, ["k"]).first().n == 4
    assert [x.i for x in tensor.first_nonzero(t, "i", ["k"], 1, last=True).collect()] == [4]
    f = spark.createDataFrame([(1, i, bool(x)) for i, x in enumerate([1, 0, 1, 0, 0, 1])], "k int, i int, flag boolean")
    assert [x.closed for x in tensor.closing(f, "i", ["k"], 2).orderBy("i").collect()] == [True, True, True, False, False, True]


def test_stream_counts_each_spike_once(spark, tmp_path):
    rows = pd.DataFrame({"spike_id": [1, 1, 2, 3], "recording_id": [1, 1, 1, 1], "cluster_id": [0, 0, 0, 1], "amplitude": [1.0, 1.0, 2.0, 3.0], "loaded_at": pd.to_datetime(["2024-01-01 00:10"] * 4)})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    src = spark.read.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.cluster_id, r.n) for r in spark.table("counts").collect()} == {(0, 2), (1, 1)}


def test_cross_correlograms_of_all_clusters(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randrange(2), 0, rng.randrange(3_000_000), rng.randrange(6), 0, 1.0, 1.0, False) for i in range(150)]
    kinds = "spike_id bigint, recording_id int, probe_id int, spike_time bigint, cluster_id bigint, template_id int, amplitude double, spike_amplitude double, is_cutoff boolean"
    spark.createDataFrame(rows + rows[:9], kinds).write.parquet(str(tmp_path / "spikes.parquet"))
    want = Counter()
    for a in rows:
        for b in rows:
            lag = b[3] - a[3]
            if a[1] == b[1] and a[4] != b[4] and abs(lag) < 600_000:
                want[a[1], a[4], b[4], int(np.sign(lag) * ((abs(lag) + 30_000) // 60_000))] += 1
    got = reference.QUERIES["agg10_ccg"](spark, str(tmp_path)).collect()
    assert {(r.recording_id, r.cluster_a, r.cluster_b, r.bin): r.n for r in got} == want and {r.cluster_a for r in got} == set(range(6))


def test_snippets_from_every_file_and_band(spark, tmp_path):
    kinds = "spike_id bigint, recording_id int, probe_id int, spike_time bigint, cluster_id bigint, template_id int, amplitude double, spike_amplitude double, is_cutoff boolean"
    times = {1: 50, 2: 999, 3: 1100, 4: 2600}  # in the first file, at its end, in the second, in the third
    spark.createDataFrame([(i, 1, 0, t, 0, 0, 1.0, 1.0, False) for i, t in times.items()] * 2, kinds).write.parquet(str(tmp_path / "spikes.parquet"))
    size = {1: 1000, 2: 1500, 3: 400}
    spark.createDataFrame([(1, f, n) for f, n in size.items()], "recording_id int, file_ord int, samples_pre_shift bigint").write.parquet(str(tmp_path / "concat_segments.parquet"))
    rows = [(1, f, "ap", k, [f * 5000 + k]) for f, n in size.items() for k in range(1, n + 1)] + [(1, f, "lf", k, [-f * 500 - k]) for f, n in size.items() for k in range(1, n // 12 + 1)]
    spark.createDataFrame(rows, "recording_id int, file_ord int, band string, sample_idx bigint, x array<smallint>").write.parquet(str(tmp_path / "samples.parquet"))
    before = {1: 0, 2: 1000, 3: 2500}
    want = set()
    for i, t in times.items():
        own = max(f for f in size if before[f] < t)
        slow = (t - before[own] - 1) // 12 + 1
        for _, f, band, k, x in rows:
            off = before[f] + k - t if band == "ap" else k - slow
            if abs(off) <= 60 and (band == "ap" or f == own):
                want.add((i, band, f, off, x[0]))
    got = [(r.request_id, r.band, r.file_ord, r.offset, r.x1) for r in reference.QUERIES["sig06_snippet_samples"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and {(b, f) for _, b, f, _, _ in got} == {(b, f) for b in ("ap", "lf") for f in size}
