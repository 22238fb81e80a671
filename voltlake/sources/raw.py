"""Raw recordings: dense 16-bit samples by channels, read in chunks and written back."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


#: Samples of an Arrow batch.
BATCH = 4096


class _Chunk(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob.glob(options["path"])) or [options["path"]]
        self.channels = int(options["channels"])
        self.chunk = int(options.get("chunk", 1 << 16))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            n = os.path.getsize(p) // (2 * self.channels)
            out += [_Chunk(p, lo, min(self.chunk, n - lo)) for lo in range(0, n, self.chunk)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, first, count = partition.value
        x = np.memmap(path, "<i2", "r", offset=2 * self.channels * first, shape=(count, self.channels))
        for lo in range(0, count, BATCH):
            part = np.ascontiguousarray(x[lo : lo + BATCH])
            n = len(part)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.channels)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(first + lo + 1, first + lo + n + 1)), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], ["path", "sample_idx", "x"])


class RawSource(DataSource):
    """Format ``raw_int16``: (path, sample_idx from 1, x array of smallint), one partition a chunk.

    Options: path (may be a pattern), channels, chunk (samples a partition).
    """

    @classmethod
    def name(cls) -> str:
        return "raw_int16"

    def schema(self) -> str:
        return "path string, sample_idx bigint, x array<smallint>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_raw(spark: SparkSession, path: str, channels: int, chunk: int = 1 << 16) -> DataFrame:
    """Samples of one or several files."""
    spark.dataSource.register(RawSource)
    return spark.read.format("raw_int16").option("channels", channels).option("chunk", chunk).load(path)


def chunk_plan(n: int, chunk: int, before: int = 0, after: int = 0) -> pd.DataFrame:
    """Chunks with a halo: read [read_lo, read_hi], keep [keep_lo, keep_hi], counted from 1.

    What is kept covers 1 to ``n`` exactly once.
    """
    lo = np.arange(1, n + 1, chunk)
    hi = np.minimum(lo + chunk - 1, n)
    return pd.DataFrame({"chunk": np.arange(len(lo)), "read_lo": np.maximum(1, lo - before), "read_hi": np.minimum(n, hi + after), "keep_lo": lo, "keep_hi": hi})


def write_raw(df: DataFrame, path: str, order: str = "sample_idx", value: str = "x") -> int:
    """Write samples in order to a file that mustn't exist; returns their number."""
    n = 0
    with open(path, "xb") as f:
        for row in df.orderBy(order).select(value).toLocalIterator():
            f.write(np.asarray(row[0], "<i2").tobytes())
            n += 1
    return n


def read_labels(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(cluster_id, column) of a tab-separated table with one header line."""
    return spark.read.csv(path, sep="\t", header=True, schema=f"cluster_id bigint, {column} string")
