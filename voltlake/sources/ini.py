"""Metadata files of ``key=value`` lines, typed by their look."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$")


def typed(text: str) -> Any:
    """A value by its look: number, list of numbers, truth value, quoted or bare text, null."""
    t = text.strip()
    if not t or t.lower() in ("nan", "none"):
        return None
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    if t[0] == "{" and t[-1] == "}":
        return [typed(x) for x in re.split(r"[;,]", t[1:-1])]
    bare = t.strip("[]")
    parts = [x for x in re.split(";" if ";" in bare else "," if "," in bare else r"\s+", bare) if x.strip()]
    if parts and all(_NUMBER.match(x.strip()) for x in parts):
        numbers = [int(x) if re.fullmatch(r"\s*[-+]?\d+\s*", x) else float(x) for x in parts]
        return numbers[0] if len(numbers) == 1 and t[0] != "[" else numbers
    return t


def parse(text: str) -> dict[str, Any]:
    """Keys (without a leading ``~``) and typed values of a file's lines."""
    out: dict[str, Any] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in ";#[" and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip().lstrip("~")] = typed(value)
    return out


def render(values: dict[str, Any]) -> str:
    """The lines that ``parse`` reads back."""

    def one(v: Any) -> str:
        if v is None:
            return "NaN"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(one, v)) + "]"
        return str(v)

    return "".join(f"{k}={one(v)}\n" for k, v in values.items())


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """(file, meta_key, meta_value) of all files under a path, as text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line"))
    lines = lines.where(F.col("line").contains("=") & ~F.col("line").rlike(r"^[;#\[]"))
    return lines.select("file", F.regexp_replace(F.trim(F.substring_index("line", "=", 1)), "^~", "").alias("meta_key"), F.trim(F.expr("substring(line, locate('=', line) + 1)")).alias("meta_value"))


# Fixed value: how recordings are named.
_NAME = r"^([\w\-.]+?)\.imec(\d*)\.(\w+)\.bin$"


def recording_file(name: str) -> tuple[str, int | None, str] | None:
    """Stem, probe number and band of a recording's file name, None if it isn't one."""
    m = re.match(_NAME, name)
    return (m[1], int(m[2]) if m[2] else None, m[3]) if m else None


def recording_fields(meta: DataFrame) -> DataFrame:
    """Typed fields per recording from its (recording_id, meta_key, meta_value) rows.

    (n_channels, fs, gain_ap, gain_lf, highpass_hz, n_sync_names); the gains are the fourth and fifth number of the probe
    table's first channel. A leading ``~`` of a key doesn't matter, blank values don't count, of several distinct values the
    first in order is taken; what is missing or doesn't read as a number is null.
    """
    key, value = F.regexp_replace("meta_key", r"^[~ ]+", ""), F.trim("meta_value")
    of = lambda k: F.min(F.when(key == k, value))
    rows = meta.where(value != "").groupBy("recording_id").agg(*(of(k).alias(k) for k in ("nSavedChans", "imSampRate", "imroTbl", "imHpFlt", "syncBitNames")))
    gain = lambda i: F.regexp_extract("imroTbl", r"\)\(\d+ \d+ \d+ (\d+) (\d+)", i).try_cast("int")
    return rows.select(
        "recording_id",
        F.col("nSavedChans").try_cast("int").alias("n_channels"),
        F.col("imSampRate").try_cast("double").alias("fs"),
        gain(1).alias("gain_ap"),
        gain(2).alias("gain_lf"),
        F.regexp_extract("imHpFlt", r"(\d+)", 1).try_cast("double").alias("highpass_hz"),
        F.when(F.col("syncBitNames").isNotNull(), F.size(F.split("syncBitNames", "[;,]"))).cast("long").alias("n_sync_names"),
    )
