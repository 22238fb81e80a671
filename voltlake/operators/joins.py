"""Lookups, interval joins and band joins as equi-joins on buckets.

An interval is placed in every bucket it touches and a point in its own, so both join kinds run
as hash or sort-merge joins on (keys, bucket), spread by bucket as well as by key: a key that
holds a third of the rows is split along its time axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import small_side


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``table``; raises when a row's key is missing there."""
    found = table.withColumn("_found", F.lit(True))
    joined = df.join(found, keys, "left")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    return joined.withColumn("_found", F.when(F.col("_found"), True).otherwise(missing.cast("boolean"))).where("_found").drop("_found")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str, bucket: int, how: str = "inner") -> DataFrame:
    """Points with the intervals of the same keys that hold them, both ends included.

    ``how`` is inner, left_semi or left_anti. Rows with a null in a key or bound match nothing.
    """
    right = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    right = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    left = points.withColumn("_pb", F.floor(F.col(at) / bucket))
    on = (F.col("_pb") == F.col("_bucket")) & (F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(right, on, how).drop("_pb", "_bucket", *(f"_k_{k}" for k in keys))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, lo: int, hi: int) -> DataFrame:
    """Pairs of rows with equal keys and ``right.other - left.at`` in [lo, hi].

    Columns but the keys must have different names on both sides.
    """
    width = max(hi - lo, 1)
    near = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col(at) + lo) / width), F.floor((F.col(at) + hi) / width))))
    far = right.withColumn("_b", F.floor(F.col(other) / width))
    return near.join(far, [*keys, "_b"]).where((F.col(other) - F.col(at)).between(lo, hi)).drop("_b")


def discretize(df: DataFrame, windows: DataFrame, keys: list[str], at: str, bucket: int, order: str = "window_ord", key_of_row: str = "row_id") -> DataFrame:
    """Rows with the window that holds them; on a shared edge the later window wins.

    ``windows`` has (keys, window_ord, w_lo, w_hi). Rows outside of all windows have a null window.
    """
    held = interval_join(df, windows, keys, at, "w_lo", "w_hi", bucket)
    best = held.groupBy(key_of_row).agg(F.max_by(order, "w_lo").alias(order))
    return df.join(best, key_of_row, "left")


def nearest(df: DataFrame, k: int, key: str, coords: list[str]) -> DataFrame:
    """(key, other, rank, d2): the ``k`` nearest other rows, ties by key.

    For dimension tables of a bounded size, such as the few hundred channels of a probe.
    """
    a = df.where(F.col(coords[0]).isNotNull()).select(F.col(key), *coords)
    b = a.select(F.col(key).alias("other"), *(F.col(c).alias(f"_{c}") for c in coords))
    d2 = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in coords[1:]), (F.col(coords[0]) - F.col(f"_{coords[0]}")) ** 2)
    pairs = a.join(small_side(b, 10_000), F.col(key) != F.col("other")).withColumn("d2", d2)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("d2", "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "other", "rank", "d2")


def within_distance(df: DataFrame, reach: float, key: str, coords: list[str]) -> DataFrame:
    """(key, other, distance) of pairs strictly closer than ``reach``, a row and itself included."""
    a = df.where(F.col(coords[0]).isNotNull()).select(F.col(key), *coords).withColumn("_g", F.floor(F.col(coords[1]) / reach))
    b = a.select(F.col(key).alias("other"), *(F.col(c).alias(f"_{c}") for c in coords), F.col("_g").alias("_h"))
    a = a.withColumn("_h", F.explode(F.array(*(F.col("_g") + i for i in (-1, 0, 1)))))
    d2 = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in coords[1:]), (F.col(coords[0]) - F.col(f"_{coords[0]}")) ** 2)
    return a.join(b, "_h").withColumn("d2", d2).where(F.col("d2") < reach**2).select(key, "other", F.sqrt("d2").alias("distance"))


def _earlier(df: DataFrame, keys: list[str], value: Column, order: Column) -> DataFrame:
    """(keys, _c, _before): what ``value`` is last, by ``order``, in the chunks ``_c`` before; one row a chunk."""
    ends = df.groupBy(*keys, "_c").agg(F.max_by(value, order).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_c").alias("_d"), F.last("_last", ignorenulls=True).over(w).alias("_before"))


def _meet(df: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    on = F.col("_c") == F.col("_d")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(chunks, on).drop("_d", *(f"_k_{k}" for k in keys))


def with_previous(df: DataFrame, keys: list[str], at: str, ties: list[str], values: list[str], chunk: int) -> DataFrame:
    """``df`` with ``prev_<value>`` of the row before, by (``at``, ties) among rows of the same keys; null for the first.

    Only rows of one chunk of the axis ``at`` are sorted together; a chunk's first row takes the last of an earlier chunk. Rows with a
    null ``at`` are left out.
    """
    rows = df.where(F.col(at).isNotNull()).withColumn("_c", F.floor(F.col(at) / chunk))
    held = F.struct(*values)
    chunks = _earlier(rows, keys, held, F.struct(at, *ties))
    prev = F.lag(held).over(Window.partitionBy(*keys, "_c").orderBy(at, *ties))
    rows = _meet(rows.withColumn("_prev", prev), chunks, keys).withColumn("_prev", F.coalesce("_prev", "_before"))
    return rows.select(*df.columns, *(F.col("_prev")[v].alias(f"prev_{v}") for v in values))


def numbered(df: DataFrame, keys: list[str], at: str, ties: list[str], chunk: int, out: str) -> DataFrame:
    """``df`` with each row's place, from 1, by (``at``, ties) among rows of the same keys; sorted by chunks."""
    rows = df.where(F.col(at).isNotNull()).withColumn("_c", F.floor(F.col(at) / chunk))
    w = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_c").count()
    sizes = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_c").alias("_d"), F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_c").orderBy(at, *ties))
    return _meet(rows.withColumn("_n", place), sizes, keys).withColumn(out, F.col("_n") + F.col("_before")).drop("_n", "_before", "_c")


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, value: str, chunk: int = 1 << 23) -> DataFrame:
    """Points with ``value`` of the last mark at or before them, null before the first.

    Points and marks are sorted by chunks of the axis; a chunk begins with the last mark of the chunks before.
    """
    both = points.withColumn("_v", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_p", F.lit(1)).withColumn("_t", F.col(at))
    extra = marks.select(*keys, F.col(value).alias("_v"), F.col(mark).alias("_t")).withColumn("_p", F.lit(0))
    rows = both.unionByName(extra, allowMissingColumns=True).withColumn("_c", F.floor(F.col("_t") / chunk))
    chunks = _earlier(rows, keys, F.col("_v"), F.when(F.col("_v").isNotNull(), F.col("_t")))
    w = Window.partitionBy(*keys, "_c").orderBy("_t", "_p").rowsBetween(Window.unboundedPreceding, 0)
    out = _meet(rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w)), chunks, keys)
    return out.where("_p = 1").withColumn(value, F.coalesce("_v", "_before")).drop("_v", "_p", "_t", "_c", "_before")


def in_all(df: DataFrame, keys: list[str], part: str, member: str) -> DataFrame:
    """(*keys, member): members that stand in every part of their group."""
    rows = df.select(*keys, part, member).distinct()
    parts = rows.groupBy(*keys).agg(F.count_distinct(part).alias("_all"))
    return rows.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("_n")).join(parts, keys).where("_n = _all").select(*keys, member)


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of all parts with ``src``, the name of their part; columns that a part lacks are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("src", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
