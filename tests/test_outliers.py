import numpy as np

from voltlake.operators.outliers import bad_channels, faulty_traces, hot_salts, search_outliers, source_models

SCHEMA = "snippet_id bigint, recording_id int, channel_ids array<int>, data array<array<float>>, adc_bits int, valid boolean, level string"
META = "recording_id int, meta_key string, meta_value string"


def snippets(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        e = rng.normal(0, 5, (2, 44))
        x = np.zeros((2, 44))
        for t in range(2, 44):
            x[:, t] = 0.5 * x[:, t - 1] + 0.2 * x[:, t - 2] + e[:, t]
        rows.append([i, 1, [7, 8], np.round(x[:, 4:] + [[30], [-40]]).tolist(), 10, True, "x"])
    rows[3][3][0][20] += 300  # spike
    rows[4][3][1][0] -= 300  # spike at the edge
    rows[5][3][0][10:30] = [12.0] * 20  # stuck
    rows[6][3][1][5] = 512.0  # beyond 10 bits
    rows[7][3][0][15:] = [v + 200 for v in rows[7][3][0][15:]]  # level shift
    rows[8][5] = False
    rows[9][3] = None
    rows[10][3][0][3] = float("nan")
    rows[11][1] = None
    rows.append([3, *rows[3][1:]])
    return spark.createDataFrame(rows, SCHEMA), rows


def test_finds_planted_faults(spark):
    df, _ = snippets(spark)
    got = {(r[0], r[1]): r for r in faulty_traces(df.repartition(3)).collect()}
    assert set(got) == {(3, 7), (4, 8), (5, 7), (6, 8), (7, 7)}
    assert got[3, 7].spiked and got[5, 7].stuck and got[6, 8].beyond_limits and got[7, 7].spiked


def test_bad_channels_are_left_out(spark):
    df, _ = snippets(spark)
    meta = spark.createDataFrame([(1, "~badChannels", "[8, 20:22]"), (2, "badChannels", None), (3, "badChannels", "")], META)
    assert [tuple(r) for r in bad_channels(meta).collect()] == [(1, [8, 20, 21, 22])]
    assert {r[1] for r in faulty_traces(df, meta).collect()} == {7}


def test_models_match_plain_statistics(spark):
    df, rows = snippets(spark)
    got = {r.channel_id: r for r in source_models(df).where("recording_id = 1").collect()}
    data = {r[0]: r[3] for r in rows if r[1] == 1 and r[5] and r[3]}
    for lane, channel in enumerate((7, 8)):
        x = np.array([v for d in data.values() for v in d[lane]], np.float32)
        x = x[np.isfinite(x)]
        assert got[channel].n_readings == len(x)
        assert got[channel].level == np.median(x)
        assert abs(got[channel].spread - 1.4826 * np.median(np.abs(x - np.median(x)))) < 1e-6
        assert 0.3 < got[channel].phi1 < 0.8


def test_empty_and_hot(spark):
    df, _ = snippets(spark)
    assert faulty_traces(df.limit(0)).collect() == []
    assert [tuple(r) for r in hot_salts(spark.range(100).selectExpr("id % 2 as k"), "k", 20).orderBy("_hot").collect()] == [(0, 3), (1, 3)]


def test_a_slow_wave_is_not_a_spike():
    wave = 4 * np.sin(np.linspace(0, np.pi, 40))[None]
    one = np.ones(1)
    assert not search_outliers(wave, one, 0.9 * one, 0 * one, 0.4 * one, 10.0)[0]
    wave[0, 20] += 12
    assert search_outliers(wave, one, 0.9 * one, 0 * one, 0.4 * one, 10.0)[0]
