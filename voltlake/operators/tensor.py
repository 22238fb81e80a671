"""Tensors in long form: one row per element with its subscripts; NaN counts as missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _v(value: str):
    return F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))


def reduce_dims(t: DataFrame, keep: list[str], value: str = "v") -> DataFrame:
    """Reductions over the dims that aren't kept."""
    v = _v(value)
    return t.groupBy(*keep).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("spread"), F.var_samp(v).alias("variance"), F.bool_and(v != 0).alias("all_set"), F.bool_or(v != 0).alias("any_set"))


def zscore(t: DataFrame, within: list[str], value: str = "v", soften: float = 0.0) -> DataFrame:
    """Elements less the mean over the standard deviation of their slice."""
    w = Window.partitionBy(*within)
    v = _v(value)
    return t.withColumn("z", F.try_divide(v - F.avg(v).over(w), F.stddev_samp(v).over(w) + soften))


def block_mean(t: DataFrame, sizes: dict[str, int], others: list[str], value: str = "v") -> DataFrame:
    """Means over tiles; the last tile may be smaller. Subscripts count from 1."""
    at = [(F.floor((F.col(d) - 1) / n) + 1).cast("int").alias(d) for d, n in sizes.items()]
    return t.groupBy(*others, *at).agg(F.avg(_v(value)).alias(value))


def arg_extreme(t: DataFrame, dim: str, keep: list[str], value: str = "v") -> DataFrame:
    """Place and value of the first smallest and first largest element along a dim."""
    v = _v(value)
    pick = t.where(v.isNotNull())
    return pick.groupBy(*keep).agg(F.min_by(dim, F.struct(v, F.col(dim))).alias("at_min"), F.min(v).alias("low"), F.max_by(dim, F.struct(v, -F.col(dim))).alias("at_max"), F.max(v).alias("high"))


def combine(t: DataFrame, weights: DataFrame, dim: str, keep: list[str], value: str = "v") -> DataFrame:
    """Weighted sums along a dim; ``weights`` has (new, dim, w)."""
    return t.join(weights, dim).groupBy(*keep, "new").agg(F.sum(_v(value) * F.col("w")).alias(value))


def running_extreme(t: DataFrame, dim: str, keep: list[str], value: str = "v", rising: bool = True) -> DataFrame:
    """The least non-decreasing (or largest non-increasing) envelope along a dim."""
    w = Window.partitionBy(*keep).orderBy(dim).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("envelope", (F.max if rising else F.min)(_v(value)).over(w))


def first_nonzero(t: DataFrame, dim: str, keep: list[str], n: int, value: str = "v", last: bool = False) -> DataFrame:
    """The first (or last) ``n`` places along a dim that aren't zero."""
    w = Window.partitionBy(*keep).orderBy(F.desc(dim) if last else F.asc(dim))
    return t.where(_v(value) != 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def closing(t: DataFrame, dim: str, keep: list[str], width: int, flag: str = "flag") -> DataFrame:
    """Gaps shorter than ``width`` in a run of flags closed (dilation, then erosion)."""
    w = Window.partitionBy(*keep).orderBy(dim)
    grown = t.withColumn("_g", F.max(F.col(flag).cast("int")).over(w.rowsBetween(-(width - 1), 0)))
    return grown.withColumn("closed", F.min("_g").over(w.rowsBetween(0, width - 1)) == 1).drop("_g")


def opening(t: DataFrame, dim: str, keep: list[str], width: int, flag: str = "flag") -> DataFrame:
    """Runs of flags shorter than ``width`` taken out (erosion, then dilation); beyond the ends no flag is set."""
    w = Window.partitionBy(*keep).orderBy(dim)
    back = w.rowsBetween(-(width - 1), 0)
    shrunk = t.withColumn("_s", F.when(F.count(F.lit(1)).over(back) == width, F.min(F.col(flag).cast("int")).over(back)).otherwise(0))
    return shrunk.withColumn("opened", F.max("_s").over(w.rowsBetween(0, width - 1)) == 1).drop("_s")


def ragged(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """(*keys, out): the values of each cell as a list in the given order; rows with a null or zero subscript belong to none.

    A cell is one row, so cells must be of a size that fits in one.
    """
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_l"))
    return lists.select(*keys, F.col("_l._v").alias(out))


def inflated(df: DataFrame, skeleton: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """The masked rows ``df`` on all places of ``skeleton``, with ``fill`` where there is none."""
    return skeleton.select(*keys).join(df, keys, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
