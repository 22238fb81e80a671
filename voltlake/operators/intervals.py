"""Continuous periods and gaps of overlapping intervals, per entity.

The state of the aggregate is a sorted list of disjoint intervals. Lists are built where the
rows are read, then merged in a reduction tree: input batch -> (entity, block, salt) ->
(entity, block). A block is a fixed stretch of the index axis, so no list grows beyond what
fits in one stretch, whatever share of the rows an entity holds. What crosses a block's edge is
settled on one narrow summary row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import checkpoint

#: Width of a block in index units, and the fan-in of the tree's middle level.
BLOCK = 1 << 22
FAN = 16


def merge_disjoint(g: np.ndarray, s: np.ndarray, t: np.ndarray, touch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals of each group; intervals at most ``touch`` apart are one.

    The stable sort merges runs that are sorted already in linear time.
    """
    if not len(s):
        return g, s, t
    order = np.argsort(s, kind="stable")
    order = order[np.argsort(g[order], kind="stable")]
    g, s, t = g[order], s[order], t[order]
    stops, rank = np.unique(t, return_inverse=True)
    reach = stops[np.maximum.accumulate(rank + g * len(stops)) - g * len(stops)]
    first = np.ones(len(s), bool)
    first[1:] = (g[1:] != g[:-1]) | (s[1:] - touch > reach[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)
    return g[first], s[first], reach[last]


def _lists(g: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    offsets = pa.array(np.append(at, len(g)), pa.int32())
    return g[at], pa.ListArray.from_arrays(offsets, pa.array(s)), pa.ListArray.from_arrays(offsets, pa.array(t))


def _leaf(touch: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).dictionary_encode(null_encoding="encode")
            s = b.column(1).to_numpy(zero_copy_only=False)
            t = b.column(2).to_numpy(zero_copy_only=False)
            n = np.int64(len(keys.dictionary))
            blocks, at = np.unique(s // block, return_inverse=True)
            g = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64) + n * at
            g, starts, stops = _lists(*merge_disjoint(g, s, t, touch))
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(g % n)), pa.array(blocks[g // n]), starts, stops], ["entity", "block", "starts", "stops"])

    return run


def _node(touch: int, width: int):
    """Merge the partial lists gathered in each row; the first ``width`` columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s, t = b.column(width), b.column(width + 1)
            g = np.repeat(np.arange(b.num_rows), s.value_lengths().to_numpy())
            _, starts, stops = _lists(*merge_disjoint(g, s.flatten().to_numpy(), t.flatten().to_numpy(), touch))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], starts, stops], b.schema.names)

    return run


def disjoint_lists(df: DataFrame, entity: str, start: str, stop: str, touch: int = 1, block: int = BLOCK) -> DataFrame:
    """The aggregate's state: per entity and block of ``start`` the sorted disjoint intervals."""
    kind = df.schema[entity].dataType.simpleString()
    lists = "starts array<bigint>, stops array<bigint>"
    rows = df.select(F.col(entity).alias("entity"), F.col(start).cast("long").alias("s"), F.col(stop).cast("long").alias("t"))
    out = rows.where("s <> 0 and t <> 0 and t >= s").mapInArrow(_leaf(touch, block), f"entity {kind}, block bigint, {lists}")
    out = out.withColumn("salt", F.spark_partition_id() % FAN)
    for keys in (["entity", "block", "salt"], ["entity", "block"]):
        out = out.groupBy(*keys).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))
        out = out.mapInArrow(_node(touch, len(keys)), ", ".join(f"{c} {out.schema[c].dataType.simpleString()}" for c in keys) + f", {lists}")
    return out


def periods_and_gaps(df: DataFrame, entity: str, start: str, stop: str, touch: int = 1, block: int = BLOCK) -> DataFrame:
    """Continuous periods and the gaps between them: (entity, kind, idx_from, idx_to).

    ``start`` and ``stop`` are whole numbers, both ends included. A row counts as an interval
    unless an end is null or 0 or the stop lies before the start; repeated rows change nothing.
    Rows whose entity is null form an entity of their own. ``touch=1`` joins intervals where
    one begins right after another's end; ``touch=0`` joins only those that share a value.
    An empty table gives an empty result; columns not named are not read.
    """
    lists = checkpoint(disjoint_lists(df, entity, start, stop, touch, block))
    key = F.struct("entity", "block")
    by = Window.partitionBy("entity")
    along = by.orderBy("block")
    tops = lists.select(key.alias("k"), "entity", "block", F.element_at("stops", -1).alias("top"))
    tops = tops.select("k", F.max("top").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("top").over(by).alias("end"))
    # What earlier blocks reach swallows a prefix of this block's list.
    eaten = F.when(F.col("carry").isNull(), 0).otherwise(F.size(F.filter("starts", lambda x: x - touch <= F.col("carry"))))
    parts = _by_key(lists, tops).withColumn("n_eaten", eaten)
    parts = parts.select("entity", "block", "end", F.greatest("carry", F.when(F.col("n_eaten") > 0, F.element_at("stops", F.greatest(F.col("n_eaten"), F.lit(1))))).alias("reach"), *(F.slice(c, F.col("n_eaten") + 1, F.greatest(F.size(c) - F.col("n_eaten"), F.lit(0))).alias(c) for c in ("starts", "stops")))
    parts = parts.where(F.size("starts") > 0)
    edges = parts.select(key.alias("k"), F.lead("reach").over(along).alias("next_reach"), F.lead(F.element_at("starts", 1)).over(along).alias("next_start"))
    parts = _by_key(parts, edges)

    def shift(c: str, size: Column, tail: Column, at: int) -> Column:
        return F.concat(F.slice(c, at, F.greatest(size - 1, F.lit(0))), F.array(tail))

    n = F.size("starts")
    parts = parts.select("entity", "starts", shift("stops", n, F.coalesce("next_reach", "end"), 1).alias("stops"), shift("starts", n, F.col("next_start"), 2).alias("after"))
    rows = parts.select("entity", F.explode(F.arrays_zip("starts", "stops", "after")).alias("x"))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("x.starts").alias("idx_from"), F.col("x.stops").alias("idx_to")),
        F.struct(F.lit("gap").alias("kind"), (F.col("x.stops") + 1).alias("idx_from"), (F.col("x.after") - 1).alias("idx_to")),
    )
    return rows.select("entity", F.inline(both)).where("idx_to >= idx_from").select(F.col("entity").alias(entity), "kind", "idx_from", "idx_to")


def _by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equi-join of per-block rows on (entity, block), null entities included."""
    right = right.select(F.col("k.entity").alias("_e"), F.col("k.block").alias("_b"), *(c for c in right.columns if c != "k"))
    return left.join(right, left["entity"].eqNullSafe(right["_e"]) & (left["block"] == right["_b"])).drop("_e", "_b")
