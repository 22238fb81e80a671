"""Queries of the llm operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import density_peaks as dp
from voltlake.llm import mixing, quantiles, residue, tiling
from voltlake.llm.runs import sync_runs
from voltlake.runtime import checkpoint, table

PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
EPS = 0.005
#: Bound below which no node of a group of up to 10^10 rows is merged.
EPS_WHOLE = 1e-9


def amplitude_digests(spikes: DataFrame) -> DataFrame:
    """Digests of ``spike_amplitude`` per recording, cluster, probe and day of loading."""
    rows = spikes.withColumn("day", F.to_date("loaded_at"))
    return quantiles.digests(rows, ["recording_id", "cluster_id", "probe_id", "day"], "spike_amplitude", EPS, "spike_id", "day")


def _p4(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    daily = amplitude_digests(table(spark, sf_dir, "spikes"))
    return quantiles.percentiles(quantiles.combine(daily, keys, EPS), keys, PROBS, with_leaves=True)


def p4_cluster_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of spike amplitudes per recording and cluster, combined over days."""
    return _p4(spark, sf_dir, ["recording_id", "cluster_id"]).select("recording_id", "cluster_id", "n", *PROBS)


def p4_probe_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of spike amplitudes per probe, combined over recordings, clusters and days."""
    return _p4(spark, sf_dir, ["probe_id"]).select("probe_id", "n", *PROBS)


def p4_probe_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per probe and percentile the leaf of the universe it lies in, by digests that hold every leaf: exact but for the leaf's width."""
    rows = table(spark, sf_dir, "spikes").withColumn("day", F.to_date("loaded_at"))
    daily = quantiles.digests(rows, ["probe_id", "day"], "spike_amplitude", EPS_WHOLE, "spike_id", "day")
    found = quantiles.percentiles(quantiles.combine(daily, ["probe_id"], EPS_WHOLE), ["probe_id"], PROBS, with_leaves=True)
    return found.select("probe_id", "n", *(F.col(f"{k}_leaf").alias(k) for k in PROBS))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more sync words that agree in all named bits."""
    runs = sync_runs(table(spark, sf_dir, "samples"), table(spark, sf_dir, "recording_meta"))
    return runs.select("recording_id", "file_ord", "band", "idx_first", "idx_last", F.col("n_events").alias("n_words"))


#: Cell width, reach and kernel in feature units, and what a doubling of amplitude weighs.
P6_WIDTH, P6_REACH, P6_KERNEL, P6_OCTAVE = 2.0, 6.0, 2.5, 0.5


def _spike_space() -> list:
    parts = [F.get(F.get(F.col("pc_features"), F.lit(i)), F.lit(j)) for i in range(2) for j in range(3)]
    return [*parts, F.log2(F.when(F.col("amplitude") > 0, F.col("amplitude"))) * P6_OCTAVE]


def _p6(spikes: DataFrame) -> tuple[DataFrame, DataFrame]:
    labels = checkpoint(dp.density_peaks(spikes, "spike_id", _spike_space(), P6_WIDTH, P6_REACH, P6_KERNEL))
    return labels, dp.describe_groups(spikes, "spike_id", _spike_space(), P6_WIDTH, labels)


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of similar spikes across recordings and clusters: size, centre, most typical spikes; strays in one row."""
    return _p6(table(spark, sf_dir, "spikes"))[1]


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every spike."""
    spikes = table(spark, sf_dir, "spikes")
    return dp.members(spikes, "spike_id", _spike_space(), P6_WIDTH, *_p6(spikes))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item."""
    found = tiling.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))
    return found.where(F.col("n_words") >= tiling.MIN_WORDS).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked: number of documents concerned and longest passage, in words."""
    found = tiling.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items")).where(F.col("n_words") >= tiling.MIN_WORDS)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and an item that leaked, whole or in parts moved about: longest passage, share covered."""
    found = tiling.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))
    return found.select("doc_id", "item_id", "n_words", F.round("coverage", 4).alias("coverage"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return mixing.use_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of tokens per source."""
    return mixing.report(*mixing.use_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p8_word_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source how often its documents are used on average if sizes are counted in words between blanks."""
    docs = table(spark, sf_dir, "documents").select(mixing.source_name(F.col("source")).alias("source"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1)).cast("long").alias("n_tokens"))
    return mixing.rates(docs, table(spark, sf_dir, "mix_targets")).withColumn("rate", F.round("rate", 6))


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture, one row for each use of a document."""
    return mixing.copies(p8_mix(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with unfilled placeholders or filler, and error pages."""
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the classifier on hosts it wasn't trained on."""
    return residue.validate(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p4_cluster_percentiles, p4_probe_percentiles, p4_probe_leaves, p5_found, p6_groups, p6_members, p7_found, p7_items, p7_coverage, p8_mix, p8_shares, p8_word_rates, p8_copies, p9_found, p9_validation)}

ORACLES = {
    "p8_word_rates": r"""
WITH d AS (SELECT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS s, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\S+'))) AS BIGINT) AS n_tokens FROM documents GROUP BY 1),
b AS (SELECT coalesce(s, source) AS source, coalesce(n_docs, 0) AS n_docs, coalesce(n_tokens, 0) AS n_tokens, coalesce(target_share, 0.0::DOUBLE) AS target_share, coalesce(max_repeats, 0) AS max_repeats FROM d FULL JOIN mix_targets ON s = source),
r AS (SELECT *, CASE WHEN n_tokens > 0 AND target_share > 0 THEN max_repeats * n_tokens / target_share END AS room FROM b), w AS (SELECT *, min(room) OVER () AS total FROM r)
SELECT source, n_docs, n_tokens, target_share, max_repeats, round(CASE WHEN room IS NULL THEN 0.0::DOUBLE ELSE least(target_share * total / n_tokens, max_repeats::DOUBLE) END, 6) AS rate FROM w""",
    "p4_probe_leaves": """
WITH s AS (SELECT spike_id, probe_id, min(spike_amplitude) AS v FROM spikes WHERE spike_amplitude IS NOT NULL AND NOT isnan(spike_amplitude) GROUP BY 1, 2),
l AS (SELECT probe_id, 1048576 + CASE WHEN v < 0 THEN -1 ELSE 1 END * least(CAST(floor(log2(abs(v) * 64 + 1) * 512) AS BIGINT), 1048575) AS leaf FROM s)
SELECT probe_id, count(*) AS n, """
    + ", ".join(f"quantile_disc(leaf, {p}) AS {k}" for k, p in PROBS.items())
    + " FROM l GROUP BY 1",
    "p5_found": """
WITH names AS (
  SELECT recording_id, string_split_regex(min(meta_value), '[;,]') AS l FROM recording_meta
  WHERE ltrim(meta_key, '~ ') = 'syncBitNames' AND trim(meta_value) <> '' GROUP BY 1),
mask AS (
  SELECT recording_id, list_sum([CASE WHEN lower(trim(l[i])) IN ('', '-', 'unused', 'na') OR i > 16 THEN 0 ELSE 1 << (i - 1) END FOR i IN range(1, len(l) + 1)]) AS m FROM names),
w AS (
  SELECT s.recording_id, file_ord, band, sample_idx, min(sync_raw & CAST(coalesce(m, 65535) AS INT)) AS w
  FROM samples s LEFT JOIN mask USING (recording_id) WHERE sync_raw IS NOT NULL AND sample_idx IS NOT NULL GROUP BY ALL),
c AS (SELECT *, CASE WHEN w = lag(w) OVER (PARTITION BY recording_id, file_ord, band ORDER BY sample_idx) THEN 0 ELSE 1 END AS f FROM w),
r AS (SELECT *, sum(f) OVER (PARTITION BY recording_id, file_ord, band ORDER BY sample_idx) AS run FROM c)
SELECT recording_id, file_ord, band, min(sample_idx) AS idx_first, max(sample_idx) AS idx_last, count(*) AS n_words
FROM r GROUP BY recording_id, file_ord, band, run HAVING count(*) >= 2""",
}
