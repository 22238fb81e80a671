"""Runs of equal consecutive events, collapsed into one event with count and duration.

Boundary interval lookup: events are laid out by entity and chunk of the order axis; within a
chunk the positions where a run starts are gathered into a sorted array, every event finds its
run by binary search in it, and the runs are aggregated. A run's pieces in neighbouring chunks
are stitched on the chunks' outermost runs alone, two narrow rows a chunk, so an entity with a
third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import checkpoint

#: Width of a chunk on the order axis.
CHUNK = 1 << 16


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys.., chunk, idx list, word list), sorted by idx -> one row per run in the chunk."""
    for b in batches:
        if not b.num_rows:
            continue
        k = b.num_columns - 2
        idx, word = b.column(k), b.column(k + 1)
        n = idx.value_lengths().to_numpy()
        row = np.repeat(np.arange(b.num_rows), n)
        at, words = idx.flatten().to_numpy(), word.flatten().to_numpy()
        change = np.ones(len(at), bool)
        change[1:] = (row[1:] != row[:-1]) | (words[1:] != words[:-1])
        starts = np.flatnonzero(change)
        run = np.searchsorted(starts, np.arange(len(at)), side="right") - 1
        count = np.bincount(run, minlength=len(starts))
        last = np.append(starts[1:], len(at)) - 1
        owner = row[starts]
        edge = np.ones(len(starts), bool)
        edge[1:-1] = (owner[1:-1] != owner[:-2]) | (owner[1:-1] != owner[2:])
        take = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [*(c.take(take) for c in b.columns[:k]), pa.array(at[starts]), pa.array(at[last]), pa.array(count.astype(np.int64)), pa.array(words[starts]), pa.array(edge)],
            [*b.schema.names[:k], "idx_first", "idx_last", "n_events", "word", "edge"],
        )


def collapse_runs(df: DataFrame, entity: list[str], order: str, word: Column, min_events: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Runs of equal ``word`` along ``order``: (*entity, idx_first, idx_last, n_events, word).

    ``order`` and ``word`` are whole numbers. Rows where either is null are left out and don't
    end a run, nor do missing order values; an order value that occurs several times counts
    once (the smallest word is taken if they differ). Null entities form one of their own.
    ``n_events`` counts distinct order values; runs with fewer than ``min_events`` are left
    out. Duration is ``idx_last - idx_first + 1``. An empty table gives an empty result.
    """
    names = [f"_k{i}" for i in range(len(entity))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(entity, names)), F.col(order).cast("long").alias("_i"), word.cast("long").alias("_w"))
    rows = rows.dropna(subset=["_i", "_w"]).withColumn("_chunk", F.floor(F.col("_i") / chunk))
    keys = [*names, "_chunk"]
    # One exchange serves both aggregations: the second's keys are those it is laid out by.
    rows = rows.repartition(*keys).groupBy(*keys, "_i").agg(F.min("_w").alias("_w"))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_w"))).alias("_e"))
    rows = rows.select(*keys, F.col("_e._i").alias("_i"), F.col("_e._w").alias("_w"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    pieces = rows.mapInArrow(_pieces, f"{kinds}, idx_first bigint, idx_last bigint, n_events bigint, word bigint, edge boolean")
    pieces = checkpoint(pieces.where(F.col("edge") | (F.col("n_events") >= min_events)))
    inner = pieces.where(~F.col("edge"))
    along = Window.partitionBy(*names).orderBy("idx_first")
    # An edge continues the one before it if the words agree and a chunk's boundary lies between.
    fresh = F.lag("word").over(along).isNull() | (F.lag("word").over(along) != F.col("word")) | (F.lag("_chunk").over(along) == F.col("_chunk"))
    edges = pieces.where("edge").withColumn("_new", fresh.cast("long"))
    edges = edges.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.groupBy(*names, "_run").agg(F.min("idx_first").alias("idx_first"), F.max("idx_last").alias("idx_last"), F.sum("n_events").alias("n_events"), F.first("word").alias("word"))
    out = ["idx_first", "idx_last", "n_events", "word"]
    runs = inner.select(*names, *out).unionByName(edges.select(*names, *out)).where(F.col("n_events") >= min_events)
    return runs.select(*(F.col(k).alias(c) for k, c in zip(names, entity)), *out)


# What a name list holds for a bit that has no name.
UNNAMED = ("", "-", "unused", "na")


def named_bits(meta: DataFrame, key: str = "syncBitNames") -> DataFrame:
    """(recording_id, mask): the bits that have a name, per recording that lists names."""
    named = F.lower(F.regexp_replace(F.trim("meta_key"), r"^~\s*", "")) == key.lower()
    lists = meta.where(named & (F.trim("meta_value") != "")).groupBy("recording_id").agg(F.min("meta_value").alias("v"))
    names = F.transform(F.split(F.regexp_replace("v", r"[\[\](){}]", ""), r"[;,]"), lambda x: F.lower(F.trim(x)))
    bit = F.transform(names, lambda x, i: F.when(x.isin(*UNNAMED) | (i > 15), F.lit(0)).otherwise(F.pow(F.lit(2), i).cast("int")))
    return lists.select("recording_id", F.aggregate(bit, F.lit(0), lambda a, x: a.bitwiseOR(x)).alias("mask"))


def sync_runs(samples: DataFrame, meta: DataFrame, min_events: int = 2) -> DataFrame:
    """Runs of sync words per recording, file and band that agree in all named bits.

    Without a list of names all 16 bits count; with a list that names none, all words agree.
    """
    masks = named_bits(meta).select(F.col("recording_id").alias("_r"), "mask")
    rows = samples.select("recording_id", "file_ord", "band", "sample_idx", "sync_raw").where("sync_raw is not null")
    rows = rows.join(masks, rows["recording_id"] == masks["_r"], "left")
    word = F.col("sync_raw").bitwiseAND(F.coalesce("mask", F.lit(0xFFFF)))
    return collapse_runs(rows, ["recording_id", "file_ord", "band"], "sample_idx", word, min_events)
