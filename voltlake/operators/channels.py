"""Channel maps: selection, order, spacing, converter banks, gains."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.scalars import gcd


def select_channels(channels: DataFrame, bad: DataFrame | None = None, which: str = "good") -> DataFrame:
    """Channels by kind: all, mapped, connected, reference, or good (connected and not bad)."""
    mapped = channels.where(~F.col("is_sync"))
    if which == "all":
        return channels
    if which == "mapped":
        return mapped
    if which == "reference":
        return mapped.where(~F.col("connected"))
    connected = mapped.where("connected")
    return connected if which == "connected" or bad is None else connected.join(bad, "channel_id", "left_anti")


def vertical_order(channels: DataFrame) -> DataFrame:
    """Channels with ``ord``: by depth from above, then across, then along."""
    placed = channels.where("pos_y is not null")
    return placed.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("pos_y"), "pos_x", "pos_z", "channel_id")))


def spacing(channels: DataFrame, axis: str) -> DataFrame:
    """Smallest distance between different coordinates on an axis."""
    at = channels.where(F.col(axis).isNotNull()).select(axis).distinct()
    step = F.col(axis) - F.lag(axis).over(Window.partitionBy(F.lit(1)).orderBy(axis))
    return at.select(step.alias("d")).agg(F.min("d").alias("spacing"))


def adc_bank(channel: Column, per_bank: int) -> Column:
    """Converter of a channel, counted from 1: even and odd channels take turns."""
    return (F.floor(channel / (2 * per_bank)) * 2 + channel % 2 + 1).cast("int")


def channel_name(channel: Column, is_sync: Column, padded: bool = False) -> Column:
    return F.when(is_sync, F.lit("sync")).otherwise(F.format_string("ch %03d" if padded else "ch %d", channel))


def scale_to_uv(rmin: Column, rmax: Column, bits: Column, gain: Column) -> Column:
    """Microvolts of one code; the range is in volts."""
    return F.try_divide(rmax - rmin, F.pow(F.lit(2.0), bits) * gain) * 1e6


def common_gain(gains: list[int]) -> int:
    """The gain to which all of ``gains`` can be raised by whole factors."""
    return reduce(math.lcm, set(gains), 1)


def common_gains(files: DataFrame) -> DataFrame:
    """(recording_id, file_ord, gain_x, common_gain, times): whole gains of files and the gain all can be raised to.

    Gains below 1 and null ones are left out. A recording has a handful of different gains.
    """
    rows = files.where("gain_x >= 1")
    lists = rows.groupBy("recording_id").agg(F.array_sort(F.collect_set("gain_x")).alias("g"))
    common = F.aggregate("g", F.lit(1).cast("long"), lambda a, b: (a / gcd(a, b)).cast("long") * b)
    joined = rows.join(lists.select("recording_id", common.alias("common_gain")), "recording_id")
    return joined.withColumn("times", F.expr("common_gain div gain_x"))


def bad_by_rms(rms: DataFrame, low: float, high: float) -> DataFrame:
    """Channels whose rms lies outside [low, high] µV."""
    return rms.where(~F.col("rms_uv").between(low, high))
