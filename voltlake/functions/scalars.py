"""Scalar and array expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sat_int16(c: Column) -> Column:
    """Round half away from zero and clamp to what 16 bits hold."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(c))).cast("short")


def ms_to_sample(ms: Column, fs: Column, start: Column) -> Column:
    """Sample of a time in ms after ``start``."""
    return (F.round(ms / 1000 * fs) + start).cast("long")


def sample_to_ms(idx: Column, fs: Column, start: Column) -> Column:
    """Time in ms of a sample after ``start``."""
    return (idx - start) / fs * 1000


def convert_sample(idx: Column, fs_from: Column | float, fs_to: Column | float) -> Column:
    """Index of the sample at another rate that is on when ``idx`` is, counted from 1."""
    return (F.floor((idx - 1).cast("double") * fs_to / fs_from) + 1).cast("long")


def bit(word: Column, number: int) -> Column:
    """Bit ``number``, counted from 1 at the lowest."""
    return F.shiftright(word, number - 1).bitwiseAND(1)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rescale(c: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Linear map of interval ``a`` onto interval ``b``."""
    return (c - a[0]) / (a[1] - a[0]) * (b[1] - b[0]) + b[0]


def signed_peak(values: Column) -> Column:
    """The extremum of an array that lies further from zero, positive on ties."""
    high, low = F.array_max(values), F.array_min(values)
    return F.when(high >= -low, high).otherwise(low)


def argmax(values: Column) -> Column:
    """Place, from 1, of the first largest element."""
    return F.array_position(values, F.array_max(values))


def argmin(values: Column) -> Column:
    """Place, from 1, of the first smallest element."""
    return F.array_position(values, F.array_min(values))


def trough_to_peak_ms(values: Column, fs: Column | float) -> Column:
    """Time from trough to peak of a waveform; null unless the peak comes after."""
    ms = (argmax(values) - argmin(values)) / fs * 1000
    return F.when(ms > 0, ms)


def value_range(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers (Euclid, on as many steps as 64 bits can need)."""
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")),
        lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), (acc["x"] % F.when(acc["y"] == 0, F.lit(1)).otherwise(acc["y"])).alias("y"))),
    )
    return pair["x"]
