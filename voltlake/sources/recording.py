"""Recordings on disk: finding the files of one, its metadata and what follows from it, joining several into one."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions.scalars import sat_int16
from voltlake.operators.channels import common_gains
from voltlake.operators.timeshift import concatenated
from voltlake.sources import ini, raw

# Fixed value: the parts of a file name.
_NAME = re.compile(r"(?P<stem>[\w\-\.]+)\.imec(?P<probe>\d*)\.(?P<type>\w+)\.bin$")


@dataclass(frozen=True)
class Recording:
    """A file of samples, its metadata, and what follows from both; ranges are in volts, ``scale_uv`` is for the file's band."""

    path: str
    stem: str
    band: str
    probe: int | None
    n_channels: int
    n_samples: int
    fs: float | None
    gain: float | None
    range_v: tuple[float, float] | None
    scale_uv: float | None
    bad_channels: tuple[int, ...]
    sync_names: tuple[str, ...]
    meta: dict

    def samples(self, spark: SparkSession, chunk: int = 1 << 16) -> DataFrame:
        return raw.read_raw(spark, self.path, self.n_channels, chunk)


def find(where: str, band: str = "ap") -> list[str]:
    """Files of a band at a path, in a folder, or whose name begins with a stem, in order of name."""
    p = Path(where)
    if p.is_file():
        return [str(p)]
    folder, stem = (p, "") if p.is_dir() else (p.parent, p.name)
    return sorted(str(f) for f in folder.glob("*.bin") if f.name.startswith(stem) and re.search(rf"\.{band}(_CAR)?\.bin$", f.name))


def _whole(value: object) -> list[int]:
    out: list[int] = []
    for a, b in re.findall(r"(\d+)(?:\s*:\s*(\d+))?", str(value)):
        out += range(int(a), int(b or a) + 1)
    return out


def open_recording(where: str, bits: int = 10) -> Recording:
    """The one recording at a path, in a folder or of a stem: its fast band, or its slow one if there is no other.

    Raises if there is none or more than one, or if its metadata is missing.
    """
    for band in ("ap", "lf"):
        files = find(where, band)
        if len(files) > 1:
            raise ValueError(f"{where} is ambiguous: {', '.join(files)}")
        if files:
            break
    if not files:
        raise FileNotFoundError(where)
    path = Path(files[0])
    name = _NAME.search(path.name)
    text = path.with_suffix(".meta").read_text()
    meta = ini.parse(text)
    n = int(meta["nSavedChans"])
    gains = re.search(r"\)\(\d+ \d+ \d+ (\d+) (\d+)", str(meta.get("imroTbl", "")))
    gain = float(gains[1 if band == "ap" else 2]) if gains else None
    low, high = meta.get("imAiRangeMin"), meta.get("imAiRangeMax")
    span = (float(low), float(high)) if low is not None and high is not None else None
    scale = (span[1] - span[0]) / 2**bits / gain * 1e6 if span and gain else None
    names = re.split("[;,]", str(meta["syncBitNames"]).strip("[]'\"")) if meta.get("syncBitNames") is not None else []
    raw_bad = next((line.partition("=")[2] for line in text.splitlines() if line.strip().lstrip("~").startswith("badChannels")), "")
    fs = meta.get("imSampRate")
    return Recording(str(path), name["stem"] if name else path.stem, band, int(name["probe"]) if name and name["probe"] else None, n, path.stat().st_size // (2 * n), float(fs) if fs is not None else None, gain, span, scale, tuple(_whole(raw_bad)), tuple(x.strip() for x in names), meta)


def concatenate(samples: DataFrame, files: DataFrame) -> DataFrame:
    """(recording_id, cat_idx, file_ord, x): samples of all files of a recording one after the other, at their common gain.

    ``files`` has (recording_id, file_ord, samples_pre_shift, gain_x); a file's samples are multiplied by what its gain lacks to
    the common one, and clamped to 16 bits. Files without a gain, and samples beyond a file's length, are left out; a sample loaded twice counts once.
    """
    at = concatenated(files.select("recording_id", "file_ord", "samples_pre_shift").distinct())
    gains = common_gains(files.select("recording_id", "file_ord", "gain_x").distinct()).select("recording_id", "file_ord", "times")
    rows = samples.where("x is not null").dropDuplicates(["recording_id", "file_ord", "sample_idx"]).join(at, ["recording_id", "file_ord"]).join(gains, ["recording_id", "file_ord"])
    rows = rows.where("sample_idx between 1 and samples_pre_shift")
    return rows.select("recording_id", (F.col("sample_idx") + F.col("cat_start") - 1).alias("cat_idx"), "file_ord", F.transform("x", lambda v: _times(v)).alias("x"))


def _times(v: Column) -> Column:
    return sat_int16(v.cast("double") * F.col("times"))


def concatenated_metadata(recordings: list[Recording], gain: int) -> dict:
    """The metadata of a joined file: that of the first, with the common gain, the files' names and lengths, and the union of bad channels.

    Raises if rates or numbers of channels differ.
    """
    first = recordings[0]
    if any((r.fs, r.n_channels) != (first.fs, first.n_channels) for r in recordings):
        raise ValueError("recordings of different rates or channels")
    table = re.sub(r"(\(\d+ \d+ \d+ )\d+ ", rf"\g<1>{gain} ", str(first.meta.get("imroTbl", "")))
    bad = sorted({c for r in recordings for c in r.bad_channels})
    return {**first.meta, "imroTbl": table, "badChannels": bad, "concatenated": ";".join(r.stem for r in recordings), "concatenatedSamples": [r.n_samples for r in recordings], "concatenatedGains": [int(r.gain) for r in recordings]}


def write_concatenated(spark: SparkSession, recordings: list[Recording], path: str, dry_run: bool = False) -> dict:
    """Join recordings into a new file of samples and one of metadata, which mustn't exist; returns the metadata.

    With ``dry_run`` nothing is written.
    """
    gains = [int(r.gain) for r in recordings]
    files = spark.createDataFrame([(1, k + 1, r.n_samples, g) for k, (r, g) in enumerate(zip(recordings, gains))], "recording_id int, file_ord int, samples_pre_shift bigint, gain_x bigint")
    common = common_gains(files).agg(F.max("common_gain")).first()[0]
    meta = concatenated_metadata(recordings, common)
    if dry_run:
        return meta
    parts = None
    for k, r in enumerate(recordings):
        part = r.samples(spark).select(F.lit(1).alias("recording_id"), F.lit(k + 1).alias("file_ord"), "sample_idx", "x")
        parts = part if parts is None else parts.unionByName(part)
    with open(Path(path).with_suffix(".meta"), "x") as f:
        f.write(ini.render(meta))
    raw.write_raw(concatenate(parts, files), path, "cat_idx")
    return meta
