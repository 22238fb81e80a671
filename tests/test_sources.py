import numpy as np
import pytest

from voltlake.sources import recording, sorter


def folder(path, n=50, seed=0):
    rng = np.random.default_rng(seed)
    arrays = {
        "spike_times": np.sort(rng.integers(0, 1000, n)).astype("<u8"), "spike_clusters": rng.integers(0, 4, n).astype("<u4"), "spike_templates": rng.integers(0, 3, n).astype("<u4"), "amplitudes": rng.random(n),
        "pc_features": rng.random((n, 3, 2)).astype("<f4"), "channel_map": np.arange(4)[:, None].astype("<i4"), "channel_positions": rng.random((4, 2)), "cutoff_spike_times": np.array([7, 2000], "<u8"), "cutoff_spike_clusters": np.array([9, 1], "<u4"), "cutoff_spike_templates": np.array([0, 1], "<u4"),
    }
    t = rng.normal(size=(3, 6, 4)).astype("<f4")
    t[:, :2] = 0
    arrays["templates"] = t
    for k, v in arrays.items():
        np.save(path / f"{k}.npy", np.asfortranarray(v) if k == "pc_features" else v)
    (path / "params.py").write_text("dat_path = 'x.bin'\nn_channels_dat = 4\nsample_rate = 30000.\nhp_filtered = False\n")
    (path / "cluster_groups.csv").write_text("cluster_id\tgroup\n0\tgood\n1\tmua\n")
    (path / "cluster_group.tsv").write_text("cluster_id\tgroup\n1\tnoise\n")
    (path / "cluster_KSLabel.tsv").write_text("cluster_id\tKSLabel\n2\tgood\n")
    return arrays


def test_sorter_folder_and_back(spark, tmp_path):
    a = folder(tmp_path)
    got = sorter.read_folder(spark, str(tmp_path), n_samples=1500)
    rows = sorted(got["spikes"].where("not is_cutoff").collect(), key=lambda r: r.spike_id)
    assert [r.spike_time for r in rows] == a["spike_times"].tolist() and [r.cluster_id for r in rows] == a["spike_clusters"].tolist()
    assert [r.template_id for r in rows] == (a["spike_templates"].astype(int) + 1).tolist() and np.allclose([r.pc_features for r in rows], a["pc_features"])
    cut = got["spikes"].where("is_cutoff").collect()
    assert [(r.spike_id, r.spike_time, r.cluster_id, r.template_id, r.amplitude) for r in cut] == [(-1, 7, 9, 1, None)]
    labels = {r.cluster_id: (r.group, r.ks_label) for r in got["clusters"].collect()}
    assert labels == {0: ("good", None), 1: ("noise", None), 2: ("unsorted", "good"), 3: ("unsorted", None), 9: ("unsorted", None)}
    assert [(r.channel_id, r.shank) for r in sorted(got["channels"].collect(), key=lambda r: r.row_idx)] == [(k + 1, 1) for k in range(4)]
    t = {(r.template_id, r.channel_row): r.w for r in got["templates"].collect()}
    assert len(t) == 12 and np.allclose(t[2, 3], a["templates"][1, 2:, 3])
    assert got["params"]["n_channels_dat"] == 4 and got["params"]["hp_filtered"] is False

    kept = got["spikes"].where("not is_cutoff").select("spike_id", "spike_time", "cluster_id", "template_id", "amplitude", "pc_features")
    assert sorter.write_folder(kept, got["clusters"], {"dat_path": "y.bin", "n_channels_dat": 4}, str(tmp_path / "out")) == 50
    for k in ("spike_times", "spike_clusters", "spike_templates", "amplitudes"):
        x = np.load(tmp_path / "out" / f"{k}.npy")
        assert (x == a[k]).all() and x.dtype == a[k].dtype
    assert np.allclose(np.load(tmp_path / "out" / "pc_features.npy"), a["pc_features"])
    assert sorter.read_folder(spark, str(tmp_path / "out"))["clusters"].where("`group` = 'noise'").count() == 1
    with pytest.raises(FileExistsError):
        sorter.write_folder(kept, got["clusters"], {}, str(tmp_path / "out"))


def test_sorter_folder_that_lacks_files(spark, tmp_path):
    np.save(tmp_path / "spike_times.npy", np.arange(3))
    with pytest.raises(FileNotFoundError):
        sorter.read_spikes(spark, str(tmp_path))
    np.save(tmp_path / "spike_clusters.npy", np.arange(2))
    np.save(tmp_path / "spike_templates.npy", np.arange(3))
    with pytest.raises(ValueError):
        sorter.read_spikes(spark, str(tmp_path))
    for f in ("spike_times", "spike_clusters", "spike_templates"):
        np.save(tmp_path / f"{f}.npy", np.empty(0, np.int64))
    assert sorter.read_spikes(spark, str(tmp_path)).count() == 0


def record(path, name, gain, x, bad="[3, 5:7]"):
    x.astype("<i2").tofile(path / f"{name}.imec0.ap.bin")
    (path / f"{name}.imec0.ap.meta").write_text(f"nSavedChans=3\nimSampRate=30000\nimroTbl=(1,3,384)(0 0 1 {gain} 250)(1 0 1 {gain} 250)\nimAiRangeMin=-0.6\nimAiRangeMax=0.6\n~badChannels={bad}\nsyncBitNames=a;b\n")


def test_open_and_concatenate_recordings(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y = rng.integers(-20_000, 20_000, (70, 3)), rng.integers(-100, 100, (40, 3))
    record(tmp_path, "one", 250, x)
    record(tmp_path, "two", 500, y, "9")
    with pytest.raises(ValueError):
        recording.open_recording(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        recording.open_recording(str(tmp_path / "three"))
    a, b = (recording.open_recording(str(tmp_path / s)) for s in ("one", "two"))
    assert (a.stem, a.band, a.probe, a.n_channels, a.n_samples, a.fs, a.gain, a.bad_channels, a.sync_names) == ("one", "ap", 0, 3, 70, 30000.0, 250.0, (3, 5, 6, 7), ("a", "b"))
    assert b.scale_uv == pytest.approx(2.34375)
    out = tmp_path / "both.imec0.ap.bin"
    meta = recording.write_concatenated(spark, [a, b], str(out))
    want = np.vstack([np.clip(x * 2, -32768, 32767), y]).astype("<i2")
    assert out.read_bytes() == want.tobytes()
    c = recording.open_recording(str(out))
    assert c.gain == 500 and c.bad_channels == (3, 5, 6, 7, 9) and c.n_samples == 110 and meta["concatenated"] == "one;two"
    with pytest.raises(FileExistsError):
        recording.write_concatenated(spark, [a, b], str(out))
