"""Time shifts, excision of gaps and concatenated files as interval maps.

A shift is a table (recording_id, ord, idx_start, idx_stop, shift_start): samples from
``idx_start`` to ``idx_stop`` move so that the first lands on ``shift_start``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.joins import interval_join
from voltlake.operators.trials import BUCKET


def excise_gaps(regions: DataFrame, strict: bool = True) -> DataFrame:
    """The shift that closes the gaps between regions (recording_id, idx_start, idx_stop).

    ``strict=False`` counts a region one sample short, so that neighbours overlap by one.
    """
    w = Window.partitionBy("recording_id").orderBy("idx_start")
    size = F.col("idx_stop") - F.col("idx_start") + (1 if strict else 0)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return regions.select("recording_id", F.row_number().over(w).alias("ord"), "idx_start", "idx_stop", (before + 1).alias("shift_start"))


def shift(times: DataFrame, spec: DataFrame, at: str) -> DataFrame:
    """Rows inside the spec's intervals with ``shifted``, their new index."""
    return interval_join(times, spec, ["recording_id"], at, "idx_start", "idx_stop", BUCKET).withColumn("shifted", F.col(at) - F.col("idx_start") + F.col("shift_start")).drop("idx_start", "idx_stop", "shift_start", "ord")


def unshift(times: DataFrame, spec: DataFrame, at: str) -> DataFrame:
    """Rows whose shifted index lies in the spec with ``source``, the index they came from."""
    inverse = spec.select("recording_id", "idx_start", "shift_start", (F.col("shift_start") + F.col("idx_stop") - F.col("idx_start")).alias("shift_stop"))
    return interval_join(times, inverse, ["recording_id"], at, "shift_start", "shift_stop", BUCKET).withColumn("source", F.col(at) - F.col("shift_start") + F.col("idx_start")).drop("idx_start", "shift_start", "shift_stop")


def constrain(spec: DataFrame, low: int, high: int) -> DataFrame:
    """The spec within [low, high]; a clipped beginning moves the landing place along."""
    cut = F.greatest(F.lit(low) - F.col("idx_start"), F.lit(0))
    return spec.where((F.col("idx_stop") >= low) & (F.col("idx_start") <= high)).withColumns({"shift_start": F.col("shift_start") + cut, "idx_stop": F.least("idx_stop", F.lit(high)), "idx_start": F.col("idx_start") + cut})


def to_text(rows: list[tuple[int, int, int]]) -> str:
    """A spec's rows as ``[a b c;d e f]``."""
    return "[" + ";".join(" ".join(map(str, r)) for r in rows) + "]"


def from_text(text: str) -> list[tuple[int, int, int]]:
    """The rows that ``to_text`` wrote."""
    return [tuple(int(x) for x in part.split()) for part in re.sub(r"[\[\]]", "", text).split(";") if part.strip()]


def concatenated(segments: DataFrame) -> DataFrame:
    """First and last sample of each file in the concatenation of its recording's files."""
    w = Window.partitionBy("recording_id").orderBy("file_ord")
    stop = F.sum("samples_pre_shift").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return segments.select("recording_id", "file_ord", "samples_pre_shift", (stop - F.col("samples_pre_shift") + 1).alias("cat_start"), stop.alias("cat_stop"))


def source_file(times: DataFrame, files: DataFrame, at: str) -> DataFrame:
    """Rows with the file their concatenated index falls in and the index within it."""
    w = files.select("recording_id", "file_ord", "cat_start", "cat_stop")
    held = interval_join(times, w, ["recording_id"], at, "cat_start", "cat_stop", 1 << 24)
    return held.withColumn("source_idx", F.col(at) - F.col("cat_start") + 1).drop("cat_start", "cat_stop")


def source_index(slots: DataFrame, spec: DataFrame, at: str, key: str) -> DataFrame:
    """Slots of the shifted axis with ``source_idx``, the sample that fills them: of several the later interval's, 0 if none."""
    inverse = spec.select("recording_id", "ord", F.col("idx_start").alias("_a"), "shift_start", (F.col("shift_start") + F.col("idx_stop") - F.col("idx_start")).alias("_stop"))
    held = interval_join(slots.select("recording_id", key, at), inverse, ["recording_id"], at, "shift_start", "_stop", BUCKET)
    best = held.groupBy(key).agg(F.max_by(F.col("_a") + F.col(at) - F.col("shift_start"), "ord").alias("source_idx"))
    return slots.join(best, key, "left").withColumn("source_idx", F.coalesce("source_idx", F.lit(0)))
