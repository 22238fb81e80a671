"""Percentiles of very large columns from mergeable digests with a deterministic rank error.

Values are quantized to a bounded ordered universe of ``2^DEPTH`` leaves, spaced evenly in
``sign(v) log(1 + |v| / UNIT)``. A digest is a set of counts on nodes of the dyadic tree above
the universe; a node's count is pushed into its parent while the two, with the sibling, hold no
more than ``n / k`` rows. At most ``n / k`` rows rest on any node that isn't a leaf, so a rank read from a
digest is off by at most ``DEPTH * n / k <= eps * n``. Digests of several days, partitions or
groups are combined by adding up their nodes; the bound stays the same.

Adding up is a grouped sum with a combiner in front of the shuffle, so the largest group costs
one task no more rows than its digest has nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depth of the tree, leaves per doubling, and the unit below which spacing turns linear.
DEPTH = 21
PER_OCTAVE = 512
UNIT = 1 / 64
MIDDLE = 1 << (DEPTH - 1)


def leaf(value: Column) -> Column:
    """The leaf of a number; infinities go to the ends, null and NaN give null."""
    v = value.cast("double")
    size = F.least(F.floor(F.log2(F.abs(v) / UNIT + 1) * PER_OCTAVE), F.lit(MIDDLE - 1))
    size = F.when(F.abs(v) == float("inf"), F.lit(MIDDLE - 1)).otherwise(size)
    return F.when(v.isNotNull() & ~F.isnan(v), F.lit(MIDDLE) + F.when(v < 0, -size).otherwise(size)).cast("long")


def leaf_value(leaves: np.ndarray) -> np.ndarray:
    """A value in the middle of each leaf; relative error at most ``2^(1 / (2 PER_OCTAVE)) - 1``."""
    at = leaves - MIDDLE
    return np.sign(at) * UNIT * (np.exp2((np.abs(at) + 0.5 * (at != 0)) / PER_OCTAVE) - 1)


def compress(row: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, one per ``row``, with small nodes pushed up; sorted by row.

    ``node`` numbers the tree from 1 at the root, ``limit`` is ``n / k`` of each row.
    """
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    light = limit[row] >= 1
    kept.append((row[~light], node[~light], count[~light]))
    row, node, count = row[light], node[light], count[light]
    level = np.frexp(node.astype(np.float64))[1] - 1
    up = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for d in range(DEPTH, -1, -1):
        own = level == d
        r, v, c = (np.concatenate([a, b[own]]) for a, b in zip(up, (row, node, count)))
        if not len(r):
            up = (r, v, c)
            continue
        key, at = np.unique((r << (DEPTH + 1)) + v, return_inverse=True)
        c = np.bincount(at, weights=c).astype(np.int64)
        r, v = key >> (DEPTH + 1), key & ((1 << (DEPTH + 1)) - 1)
        if d == 0:
            kept.append((r, v, c))
            break
        parent = level == d - 1
        above_key = (row[parent] << (DEPTH + 1)) + node[parent]
        above, where = np.unique(above_key, return_inverse=True)
        held = np.bincount(where, weights=count[parent], minlength=len(above)).astype(np.int64) if len(above) else np.empty(0, np.int64)
        pkey, at = np.unique((r << (DEPTH + 1)) + (v >> 1), return_inverse=True)
        total = np.bincount(at, weights=c).astype(np.int64)
        spot = np.minimum(np.searchsorted(above, pkey), max(len(above) - 1, 0))
        with_parent = total + (np.where(above[spot] == pkey, held[spot], 0) if len(above) else 0)
        push = (with_parent <= limit[pkey >> (DEPTH + 1)])[at]
        kept.append((r[~push], v[~push], c[~push]))
        up = (r[push], v[push] >> 1, c[push])
    row, node, count = (np.concatenate(x) for x in zip(*kept))
    order = np.argsort(row, kind="stable")
    return row[order], node[order], count[order]


def _flat(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, counts = b.column(at), b.column(at + 1)
    return np.repeat(np.arange(b.num_rows), nodes.value_lengths().to_numpy()), nodes.flatten().to_numpy(), counts.flatten().to_numpy()


def _digest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w = b.num_columns - 2
            row, node, count = _flat(b, w)
            n = np.bincount(row, weights=count, minlength=b.num_rows).astype(np.int64)
            row, node, count = compress(row, node, count, n // k)
            offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:w], pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(node)), pa.ListArray.from_arrays(offsets, pa.array(count))],
                [*b.schema.names[:w], "n", "nodes", "counts"],
            )

    return run


def nodes_per_eps(eps: float) -> int:
    """The digest's parameter k for a rank error of at most ``eps * n``."""
    return math.ceil(DEPTH / eps)


def _gathered(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows (keys, node, count) -> one compressed digest per group of keys."""
    summed = nodes.groupBy(*keys, "node").agg(F.sum("count").alias("count"))
    lists = summed.groupBy(*keys).agg(F.collect_list("node").alias("nodes"), F.collect_list("count").alias("counts"))
    kinds = "".join(f"{c} {lists.schema[c].dataType.simpleString()}, " for c in keys)
    return lists.mapInArrow(_digest(k), f"{kinds}n bigint, nodes array<bigint>, counts array<bigint>")


def digests(df: DataFrame, keys: list[str], value: str, eps: float = 0.005, distinct_by: str | None = None, first_of: str | None = None) -> DataFrame:
    """A digest of ``value`` per group: (*keys, n, nodes, counts).

    Null and NaN values are left out; null keys form groups of their own. With ``distinct_by``
    rows that agree in that id, in the keys and in the value's leaf count once; ``first_of``
    then names a key of which such rows may differ, the smallest is taken. Rows without an id
    count each. An empty table gives no digest.
    """
    rows = df.select(*(F.col(c).alias(c) for c in keys), leaf(F.col(value)).alias("_leaf"), *([F.col(distinct_by).alias("_id")] if distinct_by else []))
    rows = rows.where("_leaf is not null")
    if distinct_by:
        rows = rows.withColumn("_none", F.when(F.col("_id").isNull(), F.monotonically_increasing_id()))
        same = [c for c in keys if c != first_of]
        rows = rows.groupBy("_id", "_none", *same, "_leaf").agg(*([F.min(first_of).alias(first_of)] if first_of else [F.lit(1).alias("_one")]))
    counted = rows.select(*keys, (F.col("_leaf") + (1 << DEPTH)).alias("node"), F.lit(1).cast("long").alias("count"))
    return _gathered(counted, keys, nodes_per_eps(eps))


def combine(parts: DataFrame, keys: list[str], eps: float = 0.005) -> DataFrame:
    """Digests per group of ``keys``, a subset of the parts' keys, by adding up nodes."""
    pairs = F.arrays_zip("nodes", "counts")
    nodes = parts.select(*keys, F.explode(pairs).alias("x")).select(*keys, F.col("x.nodes").alias("node"), F.col("x.counts").alias("count"))
    return _gathered(nodes, keys, nodes_per_eps(eps))


def _read(probs: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w = b.num_columns - 3
            row, node, count = _flat(b, w + 1)
            n = b.column(w).to_numpy()
            depth = np.frexp(node.astype(np.float64))[1] - 1
            upper = ((node + 1) << (DEPTH - depth)) - 1
            order = np.lexsort((-depth, upper, row))
            row, upper, count = row[order], upper[order] - (1 << DEPTH), count[order]
            through = np.cumsum(count)
            before = np.cumsum(n) - n
            out = []
            for p in probs:
                rank = np.clip(np.ceil(p * n).astype(np.int64), 1, n)
                out.append(upper[np.searchsorted(through, before + rank)])
            yield pa.RecordBatch.from_arrays([*b.columns[: w + 1], *(pa.array(leaf_value(x)) for x in out), *(pa.array(x) for x in out)], [*b.schema.names[: w + 1], *(f"p{i}" for i in range(len(probs))), *(f"leaf{i}" for i in range(len(probs)))])

    return run


def percentiles(parts: DataFrame, keys: list[str], probs: dict[str, float], with_leaves: bool = False) -> DataFrame:
    """(*keys, n, one column per entry of ``probs``): values whose rank is within the bound.

    The rank of percentile p among n values is ``ceil(p n)``, at least 1.
    """
    kinds = "".join(f"{c} {parts.schema[c].dataType.simpleString()}, " for c in keys)
    schema = f"{kinds}n bigint, " + ", ".join([*(f"p{i} double" for i in range(len(probs))), *(f"leaf{i} bigint" for i in range(len(probs)))])
    read = parts.select(*keys, "n", "nodes", "counts").mapInArrow(_read(tuple(probs.values())), schema)
    out = read.select(*keys, "n", *(F.col(f"p{i}").alias(name) for i, name in enumerate(probs)), *([F.col(f"leaf{i}").alias(f"{name}_leaf") for i, name in enumerate(probs)] if with_leaves else []))
    return out
