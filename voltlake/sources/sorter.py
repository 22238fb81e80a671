"""Folders that a spike sorter leaves: arrays side by side, labels, parameters; read into tables and written back."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.sources import ini, npy

# Files of a folder and the column each becomes; those that count from 0 move up by one.
SPIKE_FILES = {"spike_times": "spike_time", "spike_clusters": "cluster_id", "spike_templates": "template_id", "amplitudes": "amplitude", "pc_features": "pc_features", "template_features": "template_features"}
NEEDED = ("spike_times", "spike_clusters", "spike_templates")
FROM_ZERO = {"template_id"}
LABEL_FILES = (("cluster_groups.csv", "group"), ("cluster_group.tsv", "group"), ("cluster_KSLabel.tsv", "ks_label"))


def side_by_side(spark: SparkSession, files: dict[str, str], rows_each: int = 1 << 16) -> DataFrame:
    """(row_idx, one column a file): arrays of equally many rows joined by position; ``row_idx`` counts from 0.

    A task maps the same stretch of every file, so nothing is shuffled. The files lie where all executors reach them.
    """
    kinds, sizes = {}, set()
    for name, path in files.items():
        with open(path, "rb") as f:
            shape, dtype, _, _ = npy.parse_header(f.read(4096))
        sizes.add(shape[0] if shape else 1)
        deep = sum(1 for n in shape[1:] if True) if len(shape) > 2 or (len(shape) == 2 and shape[1] != 1) else 0
        one = "double" if dtype.kind == "f" else "bigint"
        kinds[name] = "array<" * deep + one + ">" * deep
    if len(sizes) > 1:
        raise ValueError(f"arrays of different lengths: {sorted(sizes)}")
    n = sizes.pop() if sizes else 0

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                columns = [pa.array(np.arange(lo, hi))]
                for name, path in files.items():
                    x = np.load(path, mmap_mode="r")[lo:hi]
                    x = np.asarray(x, np.float64 if x.dtype.kind == "f" else np.int64)
                    if "array" not in kinds[name]:
                        columns.append(pa.array(x.reshape(len(x))))
                        continue
                    out = pa.array(np.ascontiguousarray(x).ravel())
                    for size in x.shape[:0:-1]:
                        out = pa.ListArray.from_arrays(pa.array(np.arange(len(out) // size + 1, dtype=np.int32) * size), out)
                    columns.append(out)
                yield pa.RecordBatch.from_arrays(columns, ["row_idx", *files])

    plan = spark.createDataFrame([(lo, min(lo + rows_each, n)) for lo in range(0, n, rows_each)], "lo bigint, hi bigint")
    plan = plan.repartition(max(1, min(-(-n // rows_each), 10_000)))
    return plan.mapInArrow(load, "row_idx bigint, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))


def read_spikes(spark: SparkSession, folder: str, prefix: str = "", n_samples: int | None = None) -> DataFrame:
    """(spike_id from 1, spike_time, cluster_id, template_id from 1, amplitude, ...) of a folder; with ``prefix`` its cutoff spikes.

    Arrays that aren't there have no column. Spikes after ``n_samples`` are left out.
    """
    files = {c: os.path.join(folder, f"{prefix}{f}.npy") for f, c in SPIKE_FILES.items() if os.path.exists(os.path.join(folder, f"{prefix}{f}.npy"))}
    missing = [f for f in NEEDED if SPIKE_FILES[f] not in files]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(prefix + m for m in missing)}")
    rows = side_by_side(spark, files)
    rows = rows.select((F.col("row_idx") + 1).alias("spike_id"), *((F.col(c) + 1).alias(c) if c in FROM_ZERO else F.col(c) for c in files))
    return rows if n_samples is None else rows.where(F.col("spike_time") <= n_samples)


def read_labels(spark: SparkSession, folder: str, clusters: DataFrame) -> DataFrame:
    """(cluster_id, group, ks_label): labels of the given clusters; a later file goes before an earlier one, ``unsorted`` without any."""
    out = clusters.select("cluster_id").distinct()
    for name, column in LABEL_FILES:
        path = os.path.join(folder, name)
        if column not in out.columns:
            out = out.withColumn(column, F.lit(None).cast("string"))
        if os.path.exists(path):
            rows = spark.read.csv(path, sep="\t", header=True, schema="cluster_id bigint, _l string").dropDuplicates(["cluster_id"])
            out = out.join(rows, "cluster_id", "left").withColumn(column, F.coalesce("_l", column)).drop("_l")
    return out.withColumn("group", F.coalesce("group", F.lit("unsorted")))


def read_channels(spark: SparkSession, folder: str) -> DataFrame:
    """(channel_id from 1, pos_x, pos_y, shank): the channels a folder's arrays are over, in their order."""
    files = {"channel_id": os.path.join(folder, "channel_map.npy"), "p": os.path.join(folder, "channel_positions.npy")}
    shanks = os.path.join(folder, "channel_shanks.npy")
    rows = side_by_side(spark, files | ({"shank": shanks} if os.path.exists(shanks) else {}))
    shank = F.col("shank").cast("int") if "shank" in rows.columns else F.lit(1)
    return rows.select("row_idx", (F.col("channel_id") + 1).cast("int").alias("channel_id"), F.col("p")[0].alias("pos_x"), F.col("p")[1].alias("pos_y"), shank.alias("shank"))


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """(template_id from 1, channel_row, w): waveforms of all templates, one row a channel; leading samples that are zero everywhere go."""
    rows = side_by_side(spark, {"t": os.path.join(folder, "templates.npy")}).select((F.col("row_idx") + 1).alias("template_id"), F.posexplode("t").alias("at", "v"))
    used = rows.where(F.exists("v", lambda x: x != 0)).agg(F.min("at").alias("_first"))
    rows = rows.crossJoin(F.broadcast(used)).where("at >= coalesce(_first, 0)").select("template_id", "at", F.posexplode("v").alias("channel_row", "x"))
    lists = rows.groupBy("template_id", "channel_row").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("l"))
    return lists.select("template_id", "channel_row", F.col("l.x").alias("w"))


def read_folder(spark: SparkSession, folder: str, n_samples: int | None = None) -> dict[str, DataFrame | dict]:
    """The tables of a sorter's folder: params, spikes (cutoff ones marked), clusters, channels, templates, as far as they are there."""
    here = Path(folder)
    spikes = read_spikes(spark, folder, "", n_samples).withColumn("is_cutoff", F.lit(False))
    if (here / "cutoff_spike_times.npy").exists():
        more = read_spikes(spark, folder, "cutoff_", n_samples).withColumn("is_cutoff", F.lit(True))
        spikes = spikes.unionByName(more.withColumn("spike_id", -F.col("spike_id")), allowMissingColumns=True)
    out: dict[str, DataFrame | dict] = {"params": ini.parse((here / "params.py").read_text()) if (here / "params.py").exists() else {}, "spikes": spikes}
    out["clusters"] = read_labels(spark, folder, spikes)
    if (here / "channel_map.npy").exists():
        out["channels"] = read_channels(spark, folder)
    if (here / "templates.npy").exists():
        out["templates"] = read_templates(spark, folder)
    return out


def write_folder(spikes: DataFrame, clusters: DataFrame, params: dict, folder: str) -> int:
    """Write spikes in time order, labels and parameters as a sorter's folder that mustn't hold spikes yet; returns the number of spikes.

    Ids that were moved up by one on reading move down again.
    """
    here = Path(folder)
    if (here / "spike_times.npy").exists():
        raise FileExistsError(folder)
    here.mkdir(parents=True, exist_ok=True)
    kinds = {"spike_time": "<u8", "cluster_id": "<u4", "template_id": "<u4", "amplitude": "<f8", "pc_features": "<f4", "template_features": "<f4"}
    rows = spikes.withColumn("_o", F.struct("spike_time", "spike_id"))
    n = 0
    for name, column in SPIKE_FILES.items():
        if column in spikes.columns:
            value = F.col(column) - 1 if column in FROM_ZERO else F.col(column)
            n = npy.write_npy(rows.select("_o", value.alias("_v")), "_o", "_v", str(here / f"{name}.npy"), kinds[column])
    for column, name in (("group", "cluster_group.tsv"), ("ks_label", "cluster_KSLabel.tsv")):
        if column in clusters.columns:
            lines = [f"{r[0]}\t{r[1]}\n" for r in clusters.where(F.col(column).isNotNull()).select("cluster_id", column).orderBy("cluster_id").toLocalIterator()]
            (here / name).write_text(f"cluster_id\t{'group' if column == 'group' else 'KSLabel'}\n" + "".join(lines))
    (here / "params.py").write_text("".join(f"{k} = {v!r}\n" for k, v in params.items()))
    return n
