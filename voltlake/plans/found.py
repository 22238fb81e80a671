"""Queries over the data problems of the core: intervals, implausible readings, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.operators.intervals import periods_and_gaps
from voltlake.operators.outliers import faulty_traces, source_models
from voltlake.operators.units import UnitGraph, segments_in_common_units
from voltlake.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous covered periods of each recording's trials, and the gaps between them."""
    return periods_and_gaps(table(spark, sf_dir, "trials"), "recording_id", "trial_start", "trial_stop")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recording: number and length of its periods, and length of its gaps."""
    found = p1_found(spark, sf_dir).withColumn("n", F.col("idx_to") - F.col("idx_from") + 1)
    period = F.col("kind") == "period"
    return found.groupBy("recording_id").agg(
        F.count_if(period).alias("n_periods"),
        F.sum(F.when(period, F.col("n"))).alias("covered"),
        F.coalesce(F.sum(F.when(~period, F.col("n"))), F.lit(0)).alias("uncovered"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with a spike, a stuck stretch or an impossible code, but for bad channels."""
    found = faulty_traces(table(spark, sf_dir, "snippets"), table(spark, sf_dir, "recording_meta"))
    return found.select("snippet_id", "channel_id")


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usual level and robust spread of every channel in every recording."""
    return source_models(table(spark, sf_dir, "snippets")).select("recording_id", "channel_id", "n_readings", F.round("level", 6).alias("level"), F.round("spread", 6).alias("spread"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADC range, gain, bits and scale of every complete segment in common units."""
    df = segments_in_common_units(table(spark, sf_dir, "concat_segments"), table(spark, sf_dir, "recording_meta"))
    df = df.dropna(subset=["gain", "rmin", "rmax", "adc_bits"])

    def whole(x):
        return F.round(F.round(x, 6)).cast("long")

    return df.select(
        "recording_id",
        "file_ord",
        whole(F.col("rmin_v") * 1e6).alias("rmin_uv"),
        whole(F.col("rmax_v") * 1e6).alias("rmax_uv"),
        whole(F.col("gain_factor")).alias("gain_x"),
        whole(F.col("bits")).cast("int").alias("bits"),
        whole(F.col("scale_nv_exact")).alias("scale_nv"),
    ).distinct()


def p3_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's shortest compositions between voltage units."""
    paths = UnitGraph().table(spark).where(F.col("unit_from").isin("V", "mV", "uV", "nV") & (F.col("curve") == ""))
    return paths.select("unit_from", "unit_to", F.round("scale", 9).alias("scale"))


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p2_sources, p3_found, p3_conversions)}

_P1 = """
WITH iv AS (
  SELECT DISTINCT recording_id, trial_start AS s, trial_stop AS t FROM trials
  WHERE trial_start <> 0 AND trial_stop <> 0 AND trial_stop >= trial_start),
m AS (SELECT *, max(t) OVER (PARTITION BY recording_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, t) AS isle FROM m),
p AS (SELECT recording_id, isle, min(s) AS a, max(t) AS b FROM i GROUP BY 1, 2),
n AS (SELECT *, lead(a) OVER (PARTITION BY recording_id ORDER BY a) AS nx FROM p),
found AS (
  SELECT recording_id, 'period' AS kind, a AS idx_from, b AS idx_to FROM n
  UNION ALL SELECT recording_id, 'gap', b + 1, nx - 1 FROM n WHERE nx IS NOT NULL)
"""

_P3_UNIT = "lower(replace(replace(regexp_replace({}, '[ _-]', '', 'g'), 'µ', 'u'), 'μ', 'u'))"
_P3_UV = "CASE WHEN {u} IN ('v','volt','volts') THEN 1e6 WHEN {u} IN ('mv','millivolt','millivolts') THEN 1e3 WHEN {u} IN ('nv','nanovolt','nanovolts') THEN 1e-3 WHEN {u} IN ('uv','microvolt','microvolts') THEN 1 END"

_P2 = """
WITH s AS (SELECT DISTINCT ON (snippet_id) snippet_id, recording_id, adc_bits, channel_ids, data FROM snippets WHERE valid AND data IS NOT NULL ORDER BY snippet_id),
tr AS (SELECT snippet_id, recording_id, adc_bits, unnest(channel_ids) AS channel_id, unnest(data) AS x FROM s),
r AS (SELECT recording_id, channel_id, unnest(x)::DOUBLE AS v FROM tr),
med AS (SELECT recording_id, channel_id, count(*) AS n_readings, median(v) AS level FROM r GROUP BY 1, 2),
sp AS (SELECT recording_id, channel_id, 1.4826 * median(abs(v - level)) AS spread FROM r JOIN med USING (recording_id, channel_id) GROUP BY 1, 2)
"""

#: The segments with range factor, plain gain and bits, as a row of table ``c`` each.
SEGMENTS_SQL = f"""
WITH ai AS (
  SELECT recording_id, {_P3_UNIT.format("coalesce(nullif(regexp_extract(min(trim(meta_value)), '[a-zA-Zµμ]+$'), ''), 'V')")} AS u
  FROM recording_meta WHERE ltrim(meta_key, '~ ') = 'imAiRangeMax' AND trim(meta_value) <> '' GROUP BY recording_id),
seg AS (SELECT DISTINCT recording_id, file_ord, gain, gain_unit, adc_bits, rmin, rmax, range_unit, ap_scale, note FROM concat_segments
  WHERE gain IS NOT NULL AND rmin IS NOT NULL AND rmax IS NOT NULL AND adc_bits IS NOT NULL),
a AS (SELECT seg.*, coalesce({_P3_UNIT.format("trim(range_unit)")},
    {_P3_UNIT.format("nullif(regexp_extract(note, '(?:range unit = |min/max noted as |input range is written in |rmin and rmax: |ai limits in |full-scale limits, |range columns carry |limits typed over from the rig sheet .)([a-zA-Zµμ-]+)', 1), '')")},
    ai.u, 'v') AS ru,
    CASE WHEN lower(trim(gain_unit)) IN ('db', 'decibel', 'decibels') OR regexp_matches(note, '(gain is in dB|gain column: decibel|gain .dB.|amplifier setting logged as decibel)') THEN pow(10, gain / 20) ELSE gain END AS g,
    CASE WHEN adc_bits > 64 THEN log2(adc_bits) ELSE adc_bits END AS b,
    CAST(replace(regexp_extract(regexp_replace(ap_scale, '^1 code = ', ''), '[0-9]+[.,]?[0-9]*(?:[eE][-+]?[0-9]+)?'), ',', '.') AS DOUBLE) AS num,
    {_P3_UNIT.format("regexp_extract(replace(replace(regexp_replace(regexp_replace(ap_scale, '^1 code = ', ''), '[0-9][0-9.,]*([eE][-+]?[0-9]+)?', ''), 'per code', ''), ' ', ''), '([a-zA-Zµμ]*[vV](?:olts?)?)', 1)")} AS su
  FROM seg LEFT JOIN ai USING (recording_id)),
c AS (SELECT *, {_P3_UV.format(u="ru")} AS f, {_P3_UV.format(u="su")} AS sf FROM a)
"""

ORACLES = {
    "p2_found": _P2
    + """, bad AS (
  SELECT recording_id, unnest(range(least(a, b), greatest(a, b) + 1)) AS channel_id FROM (
    SELECT recording_id, CAST(string_split(e, ':')[1] AS INT) AS a, CAST(string_split(e, ':')[-1] AS INT) AS b FROM (
      SELECT recording_id, unnest(regexp_extract_all(meta_value, '[0-9]+(:[0-9]+)?')) AS e FROM recording_meta WHERE ltrim(meta_key, '~ ') = 'badChannels'))),
j AS (SELECT tr.*, level, spread FROM tr JOIN med USING (recording_id, channel_id) JOIN sp USING (recording_id, channel_id)
  ANTI JOIN bad USING (recording_id, channel_id))
SELECT DISTINCT snippet_id, channel_id FROM j
WHERE list_min(x) < -pow(2, adc_bits - 1) OR list_max(x) > pow(2, adc_bits - 1) - 1
  OR greatest(list_max(x) - level, level - list_min(x)) > 10 * spread
  OR len([1 FOR i IN range(1, len(x) - 12) IF list_max(x[i:i+13]) - list_min(x[i:i+13]) <= 1]) > 0""",
    "p2_sources": _P2 + "SELECT recording_id, channel_id, n_readings, round(level, 6) AS level, round(spread, 6) AS spread FROM med JOIN sp USING (recording_id, channel_id)",
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_coverage": _P1
    + """SELECT recording_id, count(*) FILTER (kind = 'period') AS n_periods,
      CAST(sum(idx_to - idx_from + 1) FILTER (kind = 'period') AS BIGINT) AS covered,
      CAST(coalesce(sum(idx_to - idx_from + 1) FILTER (kind = 'gap'), 0) AS BIGINT) AS uncovered
      FROM found GROUP BY 1""",
    "p3_found": SEGMENTS_SQL
    + """
SELECT recording_id, file_ord, CAST(round(round(rmin * f, 6)) AS BIGINT) AS rmin_uv, CAST(round(round(rmax * f, 6)) AS BIGINT) AS rmax_uv,
  CAST(round(g) AS BIGINT) AS gain_x, CAST(round(b) AS INT) AS bits,
  CAST(round(round(CASE WHEN ap_scale IS NULL THEN (rmax - rmin) * f * 1000 / pow(2, b) / g ELSE num * sf * 1000 END, 6)) AS BIGINT) AS scale_nv
FROM c""",
    "p3_conversions": """
WITH u(unit, e) AS (VALUES ('V', 0), ('mV', 3), ('uV', 6), ('nV', 9))
SELECT a.unit AS unit_from, b.unit AS unit_to, round(pow(10.0::DOUBLE, b.e - a.e), 9) AS scale FROM u a, u b""",
}
