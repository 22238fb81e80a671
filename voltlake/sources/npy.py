"""NumPy array files as DataFrames, and back."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x93NUMPY"


def parse_header(head: bytes) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, whether in column order, and length of the header."""
    if head[:6] != MAGIC:
        raise ValueError("not a NumPy array file")
    size, at = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
    d = ast.literal_eval(head[at : at + size].decode("latin1"))
    return tuple(d["shape"]), np.dtype(d["descr"]), bool(d["fortran_order"]), at + size


def read_npy(spark: SparkSession, path: str, rows_each: int = 1 << 16) -> DataFrame:
    """(path, row_idx, v): rows along the first axis; ``row_idx`` counts from 0.

    Only headers are read to plan; then every stretch of rows is a task's own that maps the
    file. The files lie in a folder that all executors reach. Whole numbers widen to 64 bits.
    """
    import glob

    parts, kind = [], None
    for p in sorted(glob.glob(path)) or [path]:
        with open(p, "rb") as f:
            shape, dtype, _, _ = parse_header(f.read(4096))
        n = shape[0] if shape else 1
        one = "double" if dtype.kind == "f" else "boolean" if dtype.kind == "b" else "bigint"
        kind = kind or ("array<" * max(len(shape) - 1, 0) + one + ">" * max(len(shape) - 1, 0))
        parts += [(p, lo, min(lo + rows_each, n)) for lo in range(0, n, rows_each)]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, lo, hi in zip(b["path"], b["lo"], b["hi"]):
                x = np.atleast_1d(np.load(p, mmap_mode="r"))[lo:hi]
                x = x.astype(np.float64 if x.dtype.kind == "f" else bool if x.dtype.kind == "b" else np.int64)
                yield pd.DataFrame({"path": p, "row_idx": np.arange(lo, hi), "v": x.tolist()})

    plan = spark.createDataFrame(parts, "path string, lo bigint, hi bigint").repartition(max(1, min(len(parts), 10_000)))
    return plan.mapInPandas(load, f"path string, row_idx bigint, v {kind or 'bigint'}")


def write_npy(df: DataFrame, order: str, value: str, path: str, dtype: str) -> int:
    """Write one column in order to a file, stretch by stretch; returns the number of rows.

    The array is written little-endian in row order with a version 1.0 header. Rows pass through
    the driver one partition at a time.
    """
    n, rest = df.count(), None
    with open(path, "wb") as f:
        for row in df.orderBy(order).select(value).toLocalIterator():
            x = np.asarray(row[0], dtype=np.dtype(dtype).newbyteorder("<"))
            if rest is None:
                rest = x.shape
                np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(x.dtype), "fortran_order": False, "shape": (n, *rest)})
            f.write(x.tobytes())
        if rest is None:
            np.lib.format.write_array_header_1_0(f, {"descr": dtype, "fortran_order": False, "shape": (0,)})
    return n
