"""Quantities recorded in different units, brought to common ones.

Conversions are edges of a graph whose nodes are (quantity, unit) and whose labels are affine
functions. All shortest compositions are worked out once, in exact fractions, every cycle is
checked for consistency, and the result is a small table that rows meet in an equi-join on
source unit and target unit. Decibels and counts of levels are affine in the logarithm of the
quantity; their nodes carry the curve that leads from the affine value to the plain one.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """``target = scale * source + offset``; the way back is implied."""

    source: str
    target: str
    scale: Fraction
    offset: Fraction = Fraction(0)


# The units in use, their spellings and the conversions between them.
EDGES = (
    Edge("V", "mV", Fraction(1000)),
    Edge("mV", "uV", Fraction(1000)),
    Edge("uV", "nV", Fraction(1000)),
    Edge("V", "uV", Fraction(1000000)),
    Edge("dB", "log10_factor", Fraction(1, 20)),
    Edge("B", "dB", Fraction(10)),
    Edge("B", "log10_factor", Fraction(1, 2)),
    Edge("factor", "factor", Fraction(1)),
    Edge("bits", "bits", Fraction(1)),
    Edge("levels", "levels", Fraction(1)),
)
#: Node whose value is a logarithm or power of another node's: (from, to, curve).
CURVES = (("log10_factor", "factor", "exp10"), ("levels", "bits", "log2"))
SPELLINGS = {
    "V": ("v", "volt", "volts"),
    "mV": ("mv", "millivolt", "millivolts"),
    "uV": ("uv", "microvolt", "microvolts"),
    "nV": ("nv", "nanovolt", "nanovolts"),
    "dB": ("db", "decibel", "decibels"),
    "factor": ("x", "times", "1", "v/v", "fold", ""),
}


class UnitGraph:
    """Shortest affine compositions between units, checked for cycles that disagree."""

    def __init__(self, edges: tuple[Edge, ...] = EDGES, curves: tuple[tuple[str, str, str], ...] = CURVES):
        self.steps: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
        for e in edges:
            if not e.scale:
                raise ValueError(f"{e.source} to {e.target} can't be undone")
            self.steps.setdefault(e.source, []).append((e.target, e.scale, e.offset))
            self.steps.setdefault(e.target, []).append((e.source, 1 / e.scale, -e.offset / e.scale))
        self.curves = curves
        self.paths = {u: self._from(u) for u in self.steps}
        for u, reached in self.paths.items():
            for v, (a, b) in reached.items():
                for w, c, d in self.steps[v]:
                    if reached[w] != (a * c, b * c + d):
                        raise ValueError(f"conversions from {u} to {w} disagree between paths")

    def _from(self, unit: str) -> dict[str, tuple[Fraction, Fraction]]:
        found, todo = {unit: (Fraction(1), Fraction(0))}, deque([unit])
        while todo:
            v = todo.popleft()
            for w, c, d in self.steps[v]:
                if w not in found:
                    a, b = found[v]
                    found[w] = (a * c, b * c + d)
                    todo.append(w)
        return found

    def rows(self) -> list[tuple[str, str, float, float, str]]:
        """(source, target, scale, offset, curve) of every conversion there is."""
        out = [(u, v, float(a), float(b), "") for u, reached in self.paths.items() for v, (a, b) in reached.items()]
        out += [(u, target, float(a), float(b), curve) for log, target, curve in self.curves for u, reached in self.paths.items() for v, (a, b) in reached.items() if v == log]
        return sorted(set(out))

    def table(self, spark: SparkSession) -> DataFrame:
        """The conversions as a table of a fixed few dozen rows."""
        return spark.createDataFrame(self.rows(), "unit_from string, unit_to string, scale double, shift double, curve string")


def unit_symbol(text: Column) -> Column:
    """The unit that ``text`` spells, null if it spells none."""
    bare = F.translate(F.regexp_replace(F.lower(text), r"[\s\-_]", ""), "µμ", "uu")
    out = F.lit(None).cast("string")
    for unit, names in SPELLINGS.items():
        out = F.when(bare.isin(*names), F.lit(unit)).otherwise(out)
    return out


def convert(df: DataFrame, value: str, unit: str, target: str, out: str, graph: UnitGraph | None = None) -> DataFrame:
    """``df`` with ``out``: ``value``, recorded in the unit named in column ``unit``, in ``target``.

    A null value or unit and a unit with no way to ``target`` give null; every row stays.
    The conversion table has a fixed size and is broadcast.
    """
    paths = (graph or UnitGraph()).table(df.sparkSession).where(F.col("unit_to") == target)
    paths = paths.select(*(F.col(c).alias(f"_{c}") for c in ("unit_from", "scale", "shift", "curve")))
    plain = F.col(value) * F.col("_scale") + F.col("_shift")
    curved = F.when(F.col("_curve") == "exp10", F.pow(F.lit(10.0), plain)).when(F.col("_curve") == "log2", F.log2(F.when(plain > 0, plain))).otherwise(plain)
    joined = df.join(F.broadcast(paths), F.col(unit) == F.col("_unit_from"), "left")
    return joined.withColumn(out, curved).drop("_unit_from", "_scale", "_shift", "_curve")


_VOLTS = r"(?:milli|micro|nano)?[\s-]?volts?|[mnuµμ]?v"
_AFTER = r"(?![a-z0-9])"


def unit_beside(text: Column, subject: str) -> Column:
    """The voltage unit that free ``text`` gives for a ``subject`` (a pattern), null if none.

    Only a unit that follows the subject with no digit between counts, so a measurement
    mentioned in the same note ("offset of 7.0 mV") isn't taken for it.
    """
    found = F.regexp_extract(F.lower(text), rf"(?:{subject})[^0-9;/.]*?(?<![a-z0-9/])({_VOLTS}){_AFTER}", 1)
    return unit_symbol(F.when(found != "", found))


def quantity_in_text(text: Column) -> tuple[Column, Column]:
    """Number and voltage unit of a ``text`` such as ``1 code = 0,39 uV`` or ``nV/bit: 7.8E+02``."""
    bare = F.regexp_replace(F.lower(text), r"^\s*(?:1|one|per)?\s*(?:code|lsb|bit)\s*[=:]\s*", "")
    number = F.regexp_extract(bare, r"([-+]?[0-9]+(?:[.,][0-9]+)?(?:e[-+]?[0-9]+)?)", 1)
    unit = F.regexp_extract(bare, rf"(?<![a-z])({_VOLTS}){_AFTER}", 1)
    return F.translate(F.when(number != "", number), ",", ".").try_cast("double"), unit_symbol(F.when(unit != "", unit))


#: What the operators below take for a mention of the ADC range, and of the gain, in a note.
RANGE_WORDS = r"range|limits?|min/max|rmin|rmax|full[- ]scale"
GAIN_IN_DB = r"(?:gain|amplifier|amplification)[^0-9;/.]*?(?<![a-z])(?:db|decibels?)(?![a-z0-9])"


def meta_value(meta: DataFrame, key: str) -> DataFrame:
    """(recording_id, value): a key's value per recording.

    A leading ``~`` and case of the key don't matter; null and blank values don't count; of
    several distinct values the first in order is taken, so doubled rows change nothing.
    """
    named = F.lower(F.regexp_replace(F.trim("meta_key"), r"^~\s*", "")) == key.lower()
    value = F.trim("meta_value")
    return meta.where(named & (value != "")).groupBy("recording_id").agg(F.min(value).alias("value"))


def segments_in_common_units(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """Each segment's ADC range (V), plain gain, bits and scale (nV per code), one row each.

    Adds ``rmin_v, rmax_v, gain_factor, bits, scale_nv_exact`` to the keys and
    the recorded numbers. The range's unit stands in ``range_unit``, else in ``note``, else beside the recording's
    ``imAiRangeMax`` (volts if that carries none, or is missing). The gain is a plain factor unless its unit or
    the note speaks of decibels. ``adc_bits`` above 64 are levels. A text in ``ap_scale`` gives the scale,
    else it is (rmax - rmin) / 2^bits / gain. Rows loaded twice count once. What can't be
    worked out is null; an empty table gives an empty result.
    """
    ai = meta_value(meta, "imAiRangeMax")
    ai = ai.select(F.col("recording_id").alias("_r"), F.coalesce(quantity_in_text(F.col("value"))[1], F.lit("V")).alias("_ai_unit"))
    df = segments.select("recording_id", "file_ord", "gain", "gain_unit", "adc_bits", "rmin", "rmax", "range_unit", "ap_scale", "note").distinct()
    df = df.join(ai, df["recording_id"] == ai["_r"], "left")
    number, unit = quantity_in_text(F.col("ap_scale"))
    in_db = (unit_symbol(F.col("gain_unit")) == "dB") | F.lower("note").rlike(GAIN_IN_DB)
    df = df.withColumns({
        "_range_unit": F.coalesce(unit_symbol(F.col("range_unit")), unit_beside(F.col("note"), RANGE_WORDS), F.col("_ai_unit"), F.lit("V")),
        "_gain_unit": F.when(F.coalesce(in_db, F.lit(False)), "dB").otherwise("factor"),
        "_bits_unit": F.when(F.col("adc_bits") > 64, "levels").otherwise("bits"),
        "_number": number,
        "_scale_unit": unit,
    })
    graph = UnitGraph()
    for value, unit_col, target, out in (("rmin", "_range_unit", "V", "rmin_v"), ("rmax", "_range_unit", "V", "rmax_v"), ("gain", "_gain_unit", "factor", "gain_factor"), ("adc_bits", "_bits_unit", "bits", "bits")):
        df = convert(df, value, unit_col, target, out, graph)
    df = convert(df, "_number", "_scale_unit", "nV", "_stated", graph)
    worked_out = F.try_divide(F.col("rmax_v") - F.col("rmin_v"), F.pow(F.lit(2.0), "bits") * F.col("gain_factor")) * 1e9
    return df.withColumn("scale_nv_exact", F.when(F.col("ap_scale").isNull(), worked_out).otherwise(F.col("_stated"))).select("recording_id", "file_ord", "gain", "rmin", "rmax", "adc_bits", "rmin_v", "rmax_v", "gain_factor", "bits", "scale_nv_exact")
