"""Queries over spikes, trials, channels, files and snippets, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions import scalars
from voltlake.operators import channels as ch
from voltlake.operators import curation, joins, signal, templates, tensor, timeshift
from voltlake.operators import spikes as sp
from voltlake.operators import trials as tr
from voltlake.operators import waveforms as wf
from voltlake.operators.outliers import bad_channels
from voltlake.operators.units import segments_in_common_units
from voltlake.plans import found
from voltlake.runtime import table
from voltlake.sources import ini

FS = 30000.0
BIN = 30_000_000
SPIKE = ["spike_id", "recording_id", "probe_id", "spike_time", "cluster_id", "template_id", "amplitude", "spike_amplitude", "is_cutoff"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_SP = "sp AS (SELECT DISTINCT spike_id, recording_id, probe_id, spike_time, cluster_id, template_id, amplitude, spike_amplitude, is_cutoff FROM spikes)"
_TR = "tr AS (SELECT DISTINCT recording_id, trial_id, condition_id, trial_start, trial_stop, fs FROM trials WHERE trial_start > 0 AND trial_stop >= trial_start)"
_SEG = "seg AS (SELECT DISTINCT recording_id, file_ord, file_name, acq_source, samples_pre_shift, gain, gain_unit, multiplier, adc_bits FROM concat_segments)"
_SN = "sn AS (SELECT DISTINCT ON (snippet_id) snippet_id, recording_id, cluster_id, sample_idx, scale_to_uv::DOUBLE AS scale, channel_ids, data FROM snippets WHERE valid AND data IS NOT NULL ORDER BY snippet_id)"
_TC = f"{_SN}, tc AS (SELECT snippet_id, recording_id, cluster_id, scale, unnest(channel_ids) AS channel_id, unnest(data) AS x FROM sn)"
_BAD = "bad AS (SELECT recording_id, unnest(range(least(a, b), greatest(a, b) + 1)) AS channel_id FROM (SELECT recording_id, CAST(string_split(e, ':')[1] AS INT) AS a, CAST(string_split(e, ':')[-1] AS INT) AS b FROM (SELECT recording_id, unnest(regexp_extract_all(meta_value, '[0-9]+(:[0-9]+)?')) AS e FROM recording_meta WHERE ltrim(meta_key, '~ ') = 'badChannels')))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _spikes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each spike once, with ``columns`` beside its id and recording, or with all that aren't features."""
    wanted = [c for c in SPIKE if c in {"spike_id", "recording_id", *columns}] if columns else SPIKE
    return table(spark, d, "spikes").select(*wanted).distinct()


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return tr.valid_trials(table(spark, d, "trials"))


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return wf.traces(table(spark, d, "snippets"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concat_segments").select("recording_id", "file_ord", "samples_pre_shift").distinct()


@query(f"WITH {_SP} SELECT recording_id, cluster_id, count(*) FILTER (NOT is_cutoff) AS n_spikes, count(*) FILTER (is_cutoff) AS n_cutoff, count(*) AS n_all FROM sp GROUP BY 1, 2")
def agg01_cluster_counts(spark, d):
    """Spikes and cutoff spikes per cluster."""
    return sp.cluster_counts(_spikes(spark, d, "cluster_id", "is_cutoff"))


@query(f"""WITH {_SP}, per AS (SELECT recording_id, cluster_id, count(*) AS n, max(spike_time) AS last FROM sp GROUP BY 1, 2),
r AS (SELECT *, max(last) OVER (PARTITION BY recording_id) / 30000.0 AS seconds FROM per)
SELECT recording_id, CAST(sum(n) AS BIGINT) AS n_spikes, count(*) AS n_clusters, round(max(seconds)::DOUBLE, 6) AS seconds, count(*) FILTER (n / seconds > 0.05) AS n_fast,
CAST(coalesce(sum(n) FILTER (n / seconds > 0.05), 0) AS BIGINT) AS spikes_fast FROM r GROUP BY 1""")
def agg02_basic_stats(spark, d):
    """Per recording: spikes, clusters, seconds, clusters above a rate."""
    return sp.basic_stats(_spikes(spark, d, "cluster_id", "spike_time"), FS, 0.05).withColumn("seconds", F.round("seconds", 6))


@query(f"WITH {_SP} SELECT recording_id, cluster_id, CAST(floor(spike_time / {BIN}) AS BIGINT) AS bin, count(*) AS n FROM sp GROUP BY 1, 2, 3")
def agg07_binned_counts(spark, d):
    """Spikes per cluster and bin of time."""
    return sp.binned_counts(_spikes(spark, d, "cluster_id", "spike_time"), BIN)


@query(f"""WITH {_SP}, b AS (SELECT recording_id, cluster_id, count(*) AS n, max(max(spike_time)) OVER (PARTITION BY recording_id) AS last FROM sp GROUP BY 1, 2)
SELECT recording_id, cluster_id, round(n / (last / 30000.0)::DOUBLE, 9) AS mean_rate FROM b""")
def agg08_mean_rate(spark, d):
    """Mean firing rate of each cluster over its recording."""
    rows = _spikes(spark, d, "cluster_id", "spike_time").groupBy(*sp.KEY).agg(F.count(F.lit(1)).alias("n"), F.max("spike_time").alias("t"))
    last = rows.groupBy("recording_id").agg(F.max("t").alias("last"))
    return rows.join(last, "recording_id").select(*sp.KEY, F.round(F.col("n") / (F.col("last") / FS), 9).alias("mean_rate"))


@query(f"""WITH {_SP}, b AS (SELECT recording_id, cluster_id, CAST(floor(spike_time / {BIN}) AS BIGINT) AS bin FROM sp GROUP BY ALL HAVING count(*) >= 5),
l AS (SELECT *, bin - lag(bin) OVER (PARTITION BY recording_id, cluster_id ORDER BY bin) AS step FROM b)
SELECT recording_id, cluster_id, min(bin) AS first_bin, max(bin) AS last_bin, CAST(sum(CASE WHEN step = 2 THEN 2 ELSE 1 END) AS BIGINT) AS n_valid,
round(sum(CASE WHEN step = 2 THEN 2 ELSE 1 END) / (max(bin) - min(bin) + 1)::DOUBLE, 9) AS share FROM l GROUP BY 1, 2""")
def agg09_valid_span(spark, d):
    """Valid time span of each cluster."""
    return sp.valid_span(sp.binned_counts(_spikes(spark, d, "cluster_id", "spike_time"), BIN)).withColumn("share", F.round("share", 9))


@query(f"""WITH {_SP} SELECT a.recording_id, a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, CAST(round((b.spike_time - a.spike_time) / 60000.0) AS INT) AS bin, count(*) AS n
FROM sp a JOIN sp b ON a.recording_id = b.recording_id AND a.cluster_id <> b.cluster_id AND abs(b.spike_time - a.spike_time) < 600000 GROUP BY ALL""")
def agg10_ccg(spark, d):
    """Cross-correlograms of all pairs of clusters of every recording."""
    rows = _spikes(spark, d, "cluster_id", "spike_time")
    return sp.correlogram(rows, rows, 60_000, 10, same=False).where("cluster_a <> cluster_b")


@query(f"""WITH {_SP} SELECT a.recording_id, a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, CAST(round((b.spike_time - a.spike_time) / 60000.0) AS INT) AS bin, count(*) AS n
FROM sp a JOIN sp b ON a.recording_id = b.recording_id AND a.cluster_id = b.cluster_id AND a.spike_id <> b.spike_id AND abs(b.spike_time - a.spike_time) < 600000 GROUP BY ALL""")
def agg10_acg(spark, d):
    """Autocorrelogram of every cluster."""
    rows = _spikes(spark, d, "cluster_id", "spike_time")
    return sp.correlogram(rows, rows, 60_000, 10, same=True)


@query(f"WITH {_SP}, {_TR} SELECT spike_id, trial_id FROM sp JOIN tr ON sp.recording_id = tr.recording_id AND spike_time BETWEEN trial_start AND trial_stop")
def jn02_segment(spark, d):
    """Spikes with each trial that holds them."""
    return tr.segment(_spikes(spark, d, "spike_time").select("spike_id", "recording_id", "spike_time"), _trials(spark, d).select("recording_id", "trial_id", "trial_start", "trial_stop")).select("spike_id", "trial_id")


@query(f"""WITH {_SP}, {_TR}, e AS (SELECT *, coalesce(lead(trial_start) OVER (PARTITION BY recording_id ORDER BY trial_start, trial_id) - 1, trial_stop) AS hi FROM tr)
SELECT spike_id, trial_id FROM sp JOIN e ON sp.recording_id = e.recording_id AND spike_time BETWEEN trial_start AND hi""")
def jn02_segment_adjacent(spark, d):
    """Spikes with the trial last begun."""
    return tr.segment_adjacent(_spikes(spark, d, "spike_time").select("spike_id", "recording_id", "spike_time"), _trials(spark, d)).select("spike_id", "trial_id")


@query(f"""WITH {_SP}, {_TR}, c AS (SELECT DISTINCT recording_id, cluster_id FROM sp),
n AS (SELECT sp.recording_id, trial_id, cluster_id, count(*) AS n FROM sp JOIN tr ON sp.recording_id = tr.recording_id AND spike_time BETWEEN trial_start AND trial_stop GROUP BY ALL)
SELECT recording_id, trial_id, cluster_id, coalesce(n, 0) AS n FROM tr JOIN c USING (recording_id) LEFT JOIN n USING (recording_id, trial_id, cluster_id)""")
def agg03_trial_cluster_counts(spark, d):
    """Spikes per trial and cluster, zeros kept."""
    s = _spikes(spark, d, "cluster_id", "spike_time")
    return tr.trial_cluster_counts(s, _trials(spark, d), sp.clusters_of(s))


_RATES = f"""WITH {_SP}, {_TR}, c AS (SELECT DISTINCT recording_id, cluster_id FROM sp),
n AS (SELECT sp.recording_id, trial_id, cluster_id, count(*) AS n FROM sp JOIN tr ON sp.recording_id = tr.recording_id AND spike_time BETWEEN trial_start AND trial_stop GROUP BY ALL),
g AS (SELECT recording_id, trial_id, cluster_id, condition_id, coalesce(n, 0) / nullif((trial_stop - trial_start) / fs, 0) AS rate FROM tr JOIN c USING (recording_id) LEFT JOIN n USING (recording_id, trial_id, cluster_id))"""


@query(_RATES + "SELECT recording_id, trial_id, cluster_id, round(rate, 6) AS rate FROM g WHERE rate > 0")
def agg04_firing_rates(spark, d):
    """Firing rates per trial and cluster where there are spikes."""
    t = _trials(spark, d)
    return tr.firing_rates(agg03_trial_cluster_counts(spark, d), t).where("rate > 0").select("recording_id", "trial_id", "cluster_id", F.round("rate", 6).alias("rate"))


@query(_RATES + """, m AS (SELECT *, min(trial_id) FILTER (rate > 0) OVER w AS a, max(trial_id) FILTER (rate > 0) OVER w AS b FROM g WINDOW w AS (PARTITION BY recording_id, cluster_id))
SELECT recording_id, condition_id, cluster_id, round(avg(rate), 6) AS mean_rate, count(*) AS n_trials FROM m WHERE trial_id BETWEEN a AND b GROUP BY 1, 2, 3""")
def agg05_condition_rates(spark, d):
    """Mean rates per condition between the first and last trial with spikes."""
    rates = tr.firing_rates(agg03_trial_cluster_counts(spark, d), _trials(spark, d))
    return tr.condition_rates(rates).withColumn("mean_rate", F.round("mean_rate", 6))


@query(f"WITH {_SP}, {_TR} SELECT spike_id FROM sp SEMI JOIN tr ON sp.recording_id = tr.recording_id AND spike_time BETWEEN trial_start AND trial_stop")
def flt06_in_trials(spark, d):
    """Spikes inside any trial."""
    return tr.in_trials(_spikes(spark, d, "spike_time"), _trials(spark, d)).select("spike_id")


@query(f"WITH {_TR} SELECT recording_id, trial_id, trial_start + CAST(round(100 * fs / 1000) AS BIGINT) AS trial_start, trial_start + CAST(round(500 * fs / 1000) AS BIGINT) AS trial_stop FROM tr")
def flt04_narrow(spark, d):
    """Trials cut to 100 to 500 ms after their start."""
    return tr.narrow(_trials(spark, d), 100, 500).select("recording_id", "trial_id", "trial_start", "trial_stop")


@query(f"WITH {_TR} SELECT recording_id, trial_id, trial_start, least(trial_stop, trial_start + CAST(floor(fs * 1.5) AS BIGINT)) AS trial_stop FROM tr")
def flt05_truncate(spark, d):
    """Trials of at most 1.5 s."""
    return tr.truncate(_trials(spark, d), 1.5).select("recording_id", "trial_id", "trial_start", "trial_stop")


_REG = f"""{_TR}, m AS (SELECT *, max(trial_stop) OVER (PARTITION BY recording_id ORDER BY trial_start, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tr),
f AS (SELECT *, sum(CASE WHEN reach IS NULL OR trial_start - reach > fs * 2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY trial_start, trial_id ROWS UNBOUNDED PRECEDING) AS region FROM m),
reg AS (SELECT recording_id, CAST(region AS BIGINT) AS region, min(trial_start) AS idx_start, max(trial_stop) AS idx_stop, min(trial_id) AS first_trial, max(trial_id) AS last_trial, count(*) AS n_trials FROM f GROUP BY 1, 2)"""


@query(f"WITH {_REG} SELECT * FROM reg")
def win02_active_regions(spark, d):
    """Stretches of trials without a pause of more than 2 s."""
    return tr.active_regions(_trials(spark, d), 2.0)


_SPEC = f"""{_REG}, spec AS (SELECT recording_id, row_number() OVER w AS ord, idx_start, idx_stop, CAST(coalesce(sum(idx_stop - idx_start + 1) OVER (PARTITION BY recording_id ORDER BY idx_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS shift_start FROM reg WINDOW w AS (PARTITION BY recording_id ORDER BY idx_start))"""


def _spec(spark, d):
    return timeshift.excise_gaps(tr.active_regions(_trials(spark, d), 2.0))


@query(f"WITH {_SPEC} SELECT * FROM spec")
def win03_excise(spark, d):
    """The shift that closes the gaps between active regions."""
    return _spec(spark, d)


@query(f"WITH {_SP}, {_SPEC} SELECT spike_id, spike_time - idx_start + shift_start AS shifted FROM sp JOIN spec ON sp.recording_id = spec.recording_id AND spike_time BETWEEN idx_start AND idx_stop")
def jn09_shift(spark, d):
    """Spike times with the gaps between active regions cut out."""
    return timeshift.shift(_spikes(spark, d, "spike_time").select("spike_id", "recording_id", "spike_time"), _spec(spark, d), "spike_time").select("spike_id", "shifted")


@query(f"WITH {_SP}, {_SPEC} SELECT spike_id, spike_time AS source FROM sp JOIN spec ON sp.recording_id = spec.recording_id AND spike_time BETWEEN idx_start AND idx_stop")
def jn09_round_trip(spark, d):
    """Shifted spike times brought back."""
    moved = timeshift.shift(_spikes(spark, d, "spike_time").select("spike_id", "recording_id", "spike_time"), _spec(spark, d), "spike_time")
    return timeshift.unshift(moved.select("spike_id", "recording_id", "shifted"), _spec(spark, d), "shifted").select("spike_id", "source")


@query(f"WITH {_SPEC} SELECT recording_id, ord, greatest(idx_start, 100000) AS idx_start, least(idx_stop, 5000000) AS idx_stop, shift_start + greatest(100000 - idx_start, 0) AS shift_start FROM spec WHERE idx_stop >= 100000 AND idx_start <= 5000000")
def flt10_constrain(spark, d):
    """The shift within a window of samples."""
    return timeshift.constrain(_spec(spark, d), 100_000, 5_000_000).select("recording_id", "ord", "idx_start", "idx_stop", "shift_start")


_CAT = f"{_SEG}, f AS (SELECT DISTINCT recording_id, file_ord, samples_pre_shift FROM seg), cat AS (SELECT recording_id, file_ord, samples_pre_shift, CAST(sum(samples_pre_shift) OVER (PARTITION BY recording_id ORDER BY file_ord) AS BIGINT) AS cat_stop FROM f)"


@query(f"WITH {_CAT} SELECT recording_id, file_ord, samples_pre_shift, cat_stop - samples_pre_shift + 1 AS cat_start, cat_stop FROM cat")
def win03_concatenated(spark, d):
    """First and last sample of each file in its recording's concatenation."""
    return timeshift.concatenated(_files(spark, d))


@query(f"WITH {_SP}, {_CAT} SELECT spike_id, file_ord, spike_time - (cat_stop - samples_pre_shift + 1) + 1 AS source_idx FROM sp JOIN cat ON sp.recording_id = cat.recording_id AND spike_time BETWEEN cat_stop - samples_pre_shift + 1 AND cat_stop")
def jn08_source_file(spark, d):
    """The file a spike stems from and its index there."""
    return timeshift.source_file(_spikes(spark, d, "spike_time").select("spike_id", "recording_id", "spike_time"), timeshift.concatenated(_files(spark, d)), "spike_time").select("spike_id", "file_ord", "source_idx")


@query(f"WITH {_SP} SELECT spike_id, CAST(floor((spike_time - 1) * 2500.0::DOUBLE / 30000.0::DOUBLE) + 1 AS BIGINT) AS idx_lf FROM sp")
def jn17_sample_rate(spark, d):
    """Spike times in samples of the slow band."""
    return _spikes(spark, d, "spike_time").select("spike_id", scalars.convert_sample(F.col("spike_time"), FS, 2500.0).alias("idx_lf"))


_WIN = "win AS (SELECT recording_id, window_ord, w_lo, w_hi FROM (VALUES (1, 1, 20000000), (2, 20000000, 40000000), (3, 50000000, 60000000)) v(window_ord, w_lo, w_hi), (SELECT DISTINCT recording_id FROM sp))"


def _windows(spark, s):
    w = spark.createDataFrame([(1, 1, 20_000_000), (2, 20_000_000, 40_000_000), (3, 50_000_000, 60_000_000)], "window_ord int, w_lo bigint, w_hi bigint")
    return s.select("recording_id").distinct().withColumn("_x", F.lit(1)).join(F.broadcast(w.withColumn("_x", F.lit(1))), "_x").drop("_x")


@query(f"WITH {_SP}, {_WIN} SELECT spike_id, max(window_ord) AS window_ord FROM sp LEFT JOIN win ON sp.recording_id = win.recording_id AND spike_time BETWEEN w_lo AND w_hi GROUP BY 1")
def jn04_discretize(spark, d):
    """The window each spike falls in; the later one on a shared edge."""
    s = _spikes(spark, d, "spike_time").select("spike_id", "recording_id", "spike_time")
    return joins.discretize(s, _windows(spark, s), ["recording_id"], "spike_time", 1 << 22, key_of_row="spike_id").select("spike_id", "window_ord")


@query(f"WITH {_SP}, {_WIN} SELECT sp.recording_id, cluster_id, window_ord, count(*) AS n FROM sp JOIN win ON sp.recording_id = win.recording_id AND spike_time BETWEEN w_lo AND w_hi GROUP BY ALL")
def agg11_window_counts(spark, d):
    """Spikes per window and cluster."""
    s = _spikes(spark, d, "cluster_id", "spike_time")
    return joins.interval_join(s, _windows(spark, s), ["recording_id"], "spike_time", "w_lo", "w_hi", 1 << 22).groupBy(*sp.KEY, "window_ord").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SP}, {_WIN} SELECT spike_id FROM sp ANTI JOIN win ON sp.recording_id = win.recording_id AND spike_time BETWEEN w_lo AND w_hi UNION ALL SELECT spike_id FROM sp WHERE is_cutoff AND spike_time < 20000000")
def set02_splice(spark, d):
    """Spikes with windows replaced by a second sorting."""
    s = _spikes(spark, d, "spike_time", "is_cutoff")
    return sp.splice(s, s.where("is_cutoff and spike_time < 20000000"), _windows(spark, s).drop("window_ord")).select("spike_id")


@query(f"""WITH {_SP}, l AS (SELECT recording_id, cluster_id, spike_id, spike_time, lead(spike_id) OVER w AS next_id, lead(spike_time) OVER w - spike_time AS lag FROM sp WINDOW w AS (PARTITION BY recording_id, cluster_id ORDER BY spike_time, spike_id))
SELECT recording_id, cluster_id, spike_id, spike_time, next_id, lag FROM l WHERE lag BETWEEN 0 AND 50000""")
def win01_auto_lag(spark, d):
    """Consecutive spikes of a cluster with a short lag."""
    return sp.auto_lags(_spikes(spark, d, "cluster_id", "spike_time"), 0, 50_000)


@query(f"WITH {_SP} SELECT a.recording_id, a.cluster_id, a.spike_id AS id_a, b.spike_id AS id_b, b.spike_time - a.spike_time AS lag FROM sp a JOIN sp b ON a.recording_id = b.recording_id AND b.cluster_id = a.cluster_id + 1 AND b.spike_time - a.spike_time BETWEEN 10000 AND 110000")
def jn06_pair_lag(spark, d):
    """Spikes of the next cluster at a lag of about two seconds to the spikes of each cluster."""
    s = _spikes(spark, d, "cluster_id", "spike_time")
    return sp.pair_lags(s, s.withColumn("cluster_id", F.col("cluster_id") - 1), 60_000, 50_000, sp.KEY)


@query(f"""WITH {_SP}, n AS (SELECT a.recording_id, a.spike_id, b.cluster_id, min(abs(b.spike_time - a.spike_time)) AS d FROM sp a JOIN sp b ON a.recording_id = b.recording_id AND b.cluster_id IN (a.cluster_id + 1, a.cluster_id + 2) AND abs(b.spike_time - a.spike_time) <= 300000 GROUP BY ALL)
SELECT recording_id, spike_id, max(d) AS width FROM n GROUP BY 1, 2 HAVING count(*) = 2""")
def jn07_cover(spark, d):
    """Tightest windows around the spikes of each cluster that hold spikes of the next two clusters."""
    s = _spikes(spark, d, "cluster_id", "spike_time")
    others = s.select("recording_id", "spike_time", F.col("cluster_id").alias("member"), F.explode(F.array(F.col("cluster_id") - 1, F.col("cluster_id") - 2)).alias("cluster_id"))
    return sp.cover(s, others, 2, 300_000)


@query(f"""WITH {_SP}, u AS (SELECT recording_id, cluster_id, template_id, count(*) AS n FROM sp WHERE template_id IS NOT NULL GROUP BY ALL)
SELECT recording_id, cluster_id, template_id, n, round(n / sum(n) OVER (PARTITION BY recording_id, cluster_id)::DOUBLE, 9) AS share, CAST(row_number() OVER (PARTITION BY recording_id, cluster_id ORDER BY n DESC, template_id) AS INT) AS rank FROM u""")
def agg12_template_use(spark, d):
    """Templates a cluster uses, by use."""
    return sp.template_use(_spikes(spark, d, "cluster_id", "template_id")).withColumn("share", F.round("share", 9))


@query(f"WITH {_SP} SELECT template_id, round(avg(amplitude), 6) AS mean_amplitude, count(*) AS n FROM sp GROUP BY 1")
def agg13_template_amplitude(spark, d):
    """Mean amplitude of each template."""
    return _spikes(spark, d, "template_id", "amplitude").groupBy("template_id").agg(F.round(F.avg("amplitude"), 6).alias("mean_amplitude"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SP} SELECT recording_id, cluster_id, spike_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, cluster_id ORDER BY amplitude DESC NULLS LAST, spike_id) AS rank FROM sp) WHERE rank <= 5")
def top06_largest(spark, d):
    """The five largest spikes of each cluster."""
    return sp.sample_per_cluster(_spikes(spark, d, "cluster_id", "amplitude", "spike_time"), 5, "largest").select(*sp.KEY, "spike_id", "rank")


@query(f"""WITH {_SP}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY spike_time, spike_id) AS INT) AS ord FROM sp) SELECT spike_id, ord FROM s""")
def top01_sorted(spark, d):
    """Spikes numbered in time order within their recording."""
    return joins.numbered(_spikes(spark, d, "spike_time"), ["recording_id"], "spike_time", ["spike_id"], BIN, "ord").select("spike_id", F.col("ord").cast("int").alias("ord"))


_PAIRS = "pr AS (SELECT DISTINCT recording_id, cluster_id AS a, cluster_id + 1 AS b FROM sp WHERE cluster_id % 4 < 2)"


def _pairs(spark, d):
    return sp.clusters_of(_spikes(spark, d, "cluster_id")).where("cluster_id % 4 < 2").select("recording_id", F.col("cluster_id").alias("a"), (F.col("cluster_id") + 1).alias("b"))


_MERGES = f"""{_SP}, {_PAIRS}, e AS (SELECT recording_id, a, b FROM pr UNION SELECT recording_id, b, a FROM pr),
reach AS (SELECT recording_id, a AS cluster_id, a AS t FROM e UNION SELECT recording_id, a, b FROM e UNION SELECT r.recording_id, r.cluster_id, e.b FROM reach r JOIN e ON r.recording_id = e.recording_id AND r.t = e.a),
mg AS (SELECT recording_id, cluster_id, min(t) AS new_id FROM reach GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_MERGES} SELECT * FROM mg")
def cur01_merge_sets(spark, d):
    """Merge sets of overlapping pairs of clusters."""
    return curation.merge_sets(_pairs(spark, d))


@query(f"WITH RECURSIVE {_MERGES} SELECT spike_id, coalesce(new_id, sp.cluster_id) AS cluster_id, sp.cluster_id AS cluster_before FROM sp LEFT JOIN mg ON sp.recording_id = mg.recording_id AND sp.cluster_id = mg.cluster_id")
def cur03_apply_merges(spark, d):
    """Spikes with merged cluster ids."""
    return curation.apply_merges(_spikes(spark, d, "cluster_id"), curation.merge_sets(_pairs(spark, d))).select("spike_id", "cluster_id", "cluster_before")


def _ratings(spark, d):
    return sp.clusters_of(_spikes(spark, d, "cluster_id")).select(*sp.KEY, (F.col("cluster_id") % 5).cast("int").alias("rating"), (F.col("cluster_id") % 2 == 0).alias("include_cutoff"))


_RT = "rt AS (SELECT DISTINCT recording_id, cluster_id, CAST(cluster_id % 5 AS INT) AS rating, cluster_id % 2 = 0 AS include_cutoff FROM sp)"


@query(f"WITH RECURSIVE {_MERGES}, {_RT} SELECT rt.recording_id, coalesce(new_id, rt.cluster_id) AS cluster_id, max(rating) AS rating, bool_or(include_cutoff) AS include_cutoff FROM rt LEFT JOIN mg ON rt.recording_id = mg.recording_id AND rt.cluster_id = mg.cluster_id GROUP BY 1, 2")
def cur04_merge_ratings(spark, d):
    """Ratings after merges."""
    return curation.merge_ratings(_ratings(spark, d), curation.merge_sets(_pairs(spark, d)))


@query(f"WITH {_SP}, {_RT} SELECT rating, count(*) AS n FROM rt GROUP BY 1")
def agg16_rating_counts(spark, d):
    """Clusters by rating."""
    return curation.rating_counts(_ratings(spark, d))


@query(f"WITH {_SP}, {_RT} SELECT recording_id, cluster_id, rating FROM rt WHERE rating IN (3, 4) AND cluster_id % 3 <> 0")
def flt12_usable(spark, d):
    """Clusters rated well and usable in both subgroups."""
    flags = sp.clusters_of(_spikes(spark, d, "cluster_id")).select(*sp.KEY, F.explode(F.array(F.lit(1), F.lit(2))).alias("subgroup")).withColumn("usable", F.col("cluster_id") % 3 != 0)
    return curation.usable(flags, _ratings(spark, d), [3, 4], [1, 2])


@query(f"WITH {_BAD} SELECT r.recording_id, c.channel_id FROM (SELECT DISTINCT recording_id FROM recording_meta) r, channels c WHERE NOT is_sync AND connected AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.recording_id = r.recording_id AND bad.channel_id = c.channel_id)")
def flt07_good_channels(spark, d):
    """Connected channels that a recording doesn't list as bad."""
    meta = table(spark, d, "recording_meta")
    good = ch.select_channels(table(spark, d, "channels"), which="connected").agg(F.collect_set("channel_id").alias("all"))
    recs = meta.select("recording_id").distinct().join(bad_channels(meta), "recording_id", "left").join(F.broadcast(good.withColumn("_x", F.lit(1))), F.lit(1) == F.col("_x"))
    return recs.select("recording_id", F.explode(F.array_except("all", F.coalesce("bad", F.array().cast("array<int>")))).alias("channel_id"))


@query("SELECT channel_id, CAST(row_number() OVER (ORDER BY pos_y DESC, pos_x, pos_z, channel_id) AS INT) AS ord FROM channels WHERE pos_y IS NOT NULL")
def top02_vertical(spark, d):
    """Channels from the top down."""
    return ch.vertical_order(table(spark, d, "channels")).select("channel_id", "ord")


@query("""WITH p AS (SELECT a.channel_id, b.channel_id AS other, pow(a.pos_x - b.pos_x, 2) + pow(a.pos_y - b.pos_y, 2) + pow(a.pos_z - b.pos_z, 2) AS d2 FROM channels a JOIN channels b ON a.channel_id <> b.channel_id WHERE a.pos_x IS NOT NULL AND b.pos_x IS NOT NULL)
SELECT channel_id, other, CAST(rank AS INT) AS rank, d2 FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY d2, other) AS rank FROM p) WHERE rank <= 8""")
def jn12_nearest_channels(spark, d):
    """The eight channels nearest to each."""
    return joins.nearest(table(spark, d, "channels"), 8, "channel_id", ["pos_x", "pos_y", "pos_z"])


@query("SELECT a.channel_id, b.channel_id AS other, round(sqrt(pow(a.pos_x - b.pos_x, 2) + pow(a.pos_y - b.pos_y, 2) + pow(a.pos_z - b.pos_z, 2)), 6) AS distance FROM channels a JOIN channels b ON pow(a.pos_x - b.pos_x, 2) + pow(a.pos_y - b.pos_y, 2) + pow(a.pos_z - b.pos_z, 2) < 10000")
def jn13_proximity(spark, d):
    """Channels closer than 100 µm to each other."""
    return joins.within_distance(table(spark, d, "channels"), 100.0, "channel_id", ["pos_x", "pos_y", "pos_z"]).withColumn("distance", F.round("distance", 6))


@query("SELECT channel_id, CAST(floor(channel_id / 24) * 2 + channel_id % 2 + 1 AS INT) AS bank, CASE WHEN is_sync THEN 'sync' ELSE 'ch ' || lpad(channel_id::VARCHAR, 3, '0') END AS name FROM channels")
def fn03_banks_and_names(spark, d):
    """Converter bank and name of each channel."""
    c = table(spark, d, "channels")
    return c.select("channel_id", ch.adc_bank(F.col("channel_id"), 12).alias("bank"), ch.channel_name(F.col("channel_id"), F.col("is_sync"), True).alias("name"))


@query("SELECT min(s) AS spacing FROM (SELECT pos_y - lag(pos_y) OVER (ORDER BY pos_y) AS s FROM (SELECT DISTINCT pos_y FROM channels WHERE pos_y IS NOT NULL))")
def fn04_spacing(spark, d):
    """Vertical distance between rows of channels."""
    return ch.spacing(table(spark, d, "channels"), "pos_y")


@query(found.SEGMENTS_SQL + "SELECT recording_id, file_ord, round((rmax - rmin) * f / pow(2, b) / g, 6) AS scale_uv FROM c")
def fn01_scales(spark, d):
    """Microvolts of one code of every complete file, from range, bits and gain."""
    u = segments_in_common_units(table(spark, d, "concat_segments"), table(spark, d, "recording_meta")).dropna(subset=["gain", "rmin", "rmax", "adc_bits"])
    return u.select("recording_id", "file_ord", F.round(ch.scale_to_uv(F.col("rmin_v"), F.col("rmax_v"), F.col("bits"), F.col("gain_factor")), 6).alias("scale_uv"))


@query("SELECT sync_raw & 65535 AS word, " + ", ".join(f"(sync_raw >> {i}) & 1 AS bit{i + 1}" for i in range(4)) + ", count(*) AS n FROM (SELECT DISTINCT recording_id, file_ord, band, sample_idx, sync_raw FROM samples WHERE sync_raw IS NOT NULL) GROUP BY ALL")
def flt15_sync_bits(spark, d):
    """Bits of the sync words and how often each word stands."""
    rows = table(spark, d, "samples").where("sync_raw is not null").select("recording_id", "file_ord", "band", "sample_idx", "sync_raw").distinct()
    return rows.groupBy(F.col("sync_raw").alias("word")).agg(F.count(F.lit(1)).alias("n")).select("word", *(scalars.bit(F.col("word"), i).alias(f"bit{i}") for i in range(1, 5)), "n")


@query("""WITH s AS (SELECT DISTINCT recording_id, file_ord, band, sample_idx, sync_raw FROM samples WHERE sync_raw IS NOT NULL),
l AS (SELECT *, (sync_raw & 1) - lag(sync_raw & 1) OVER (PARTITION BY recording_id, file_ord, band ORDER BY sample_idx) AS step FROM s)
SELECT recording_id, file_ord, band, sample_idx FROM l WHERE step = 1""")
def win05_rising_edges(spark, d):
    """Samples where the lowest sync bit comes on."""
    rows = table(spark, d, "samples").where("sync_raw is not null").select("recording_id", "file_ord", "band", "sample_idx", "sync_raw").distinct()
    rows = rows.withColumn("bit1", scalars.bit(F.col("sync_raw"), 1)).drop("sync_raw")
    rows = joins.with_previous(rows, ["recording_id", "file_ord", "band"], "sample_idx", [], ["bit1"], 1 << 16)
    return rows.where("bit1 - prev_bit1 = 1").select("recording_id", "file_ord", "band", "sample_idx")


@query(f"""WITH {_TC}, r AS (SELECT cluster_id, recording_id, channel_id, t, x[t]::DOUBLE * scale AS v FROM tc, range(1, 41) g(t))
SELECT recording_id, cluster_id, channel_id, CAST(t AS INT) AS t, round(avg(v), 7) AS mean_uv, count(v) AS n, round(CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) END, 7) AS sem_uv FROM r GROUP BY 1, 2, 3, 4""")
def agg18_mean_waveforms(spark, d):
    """Mean waveforms and standard errors per cluster, channel and time."""
    return wf.mean_waveforms(_traces(spark, d), ["recording_id", "cluster_id"]).withColumns({"mean_uv": F.round("mean_uv", 7), "sem_uv": F.round("sem_uv", 7)})


@query(f"""WITH {_TC} SELECT snippet_id, channel_id, list_max(x) - list_min(x) AS vrange, CASE WHEN list_max(x) >= -list_min(x) THEN list_max(x) ELSE list_min(x) END AS peak,
CASE WHEN list_position(x, list_max(x)) > list_position(x, list_min(x)) THEN round((list_position(x, list_max(x)) - list_position(x, list_min(x))) / 30.0::DOUBLE, 6) END AS ttp_ms FROM tc""")
def fn09_waveform_shape(spark, d):
    """Range, signed peak and trough-to-peak time of every trace."""
    x = F.col("x")
    return _traces(spark, d).select("snippet_id", "channel_id", scalars.value_range(x).alias("vrange"), scalars.signed_peak(x).alias("peak"), F.round(scalars.trough_to_peak_ms(x, FS), 6).alias("ttp_ms"))


@query(f"""WITH {_TC}, r AS (SELECT snippet_id, channel_id, (list_max(x) - list_min(x))::DOUBLE AS r FROM tc), m AS (SELECT *, max(r) OVER (PARTITION BY snippet_id) AS top FROM r)
SELECT snippet_id, round(sum(r * pos_x) / nullif(sum(r), 0), 4) AS pos_x, round(sum(r * pos_y) / nullif(sum(r), 0), 4) AS pos_y, count(*) AS n_channels FROM m JOIN channels USING (channel_id) WHERE r >= 0.1 * top GROUP BY 1""")
def sig11_centroids(spark, d):
    """Where each snippet's waveform is centred on the probe."""
    return wf.centroids(_traces(spark, d), table(spark, d, "channels")).withColumns({c: F.round(c, 4) for c in ("pos_x", "pos_y")})


@query(f"""WITH {_TC}, r AS (SELECT snippet_id, channel_id, greatest(abs(list_max(x)), abs(list_min(x))) AS r FROM tc), m AS (SELECT *, max(r) OVER (PARTITION BY snippet_id) AS top FROM r),
p AS (SELECT snippet_id, pos_x, pos_y FROM m JOIN channels USING (channel_id) WHERE r >= 0.5 * top)
SELECT a.snippet_id, max(sqrt(pow(a.pos_x - b.pos_x, 2) + pow(a.pos_y - b.pos_y, 2))) < 30 AS localized FROM p a JOIN p b USING (snippet_id) GROUP BY 1""")
def sig12_localized(spark, d):
    """Whether the channels with at least half of a snippet's peak lie within 30 µm."""
    return wf.localized(_traces(spark, d), table(spark, d, "channels"), reach=30.0)


_RMS = f"""{_TC}, r AS (SELECT recording_id, channel_id, scale, x, list_avg([v::DOUBLE FOR v IN x]) AS m FROM tc),
rms AS (SELECT recording_id, channel_id, sqrt(sum(list_sum([pow(v::DOUBLE - m, 2) FOR v IN x]) * scale * scale) / sum(len(x))) AS rms_uv FROM r GROUP BY 1, 2)"""


@query(f"WITH {_RMS} SELECT recording_id, channel_id, round(rms_uv, 3) AS rms_uv FROM rms")
def agg15_rms(spark, d):
    """Root mean square of every channel of every recording."""
    return wf.rms_by_channel(_traces(spark, d)).withColumn("rms_uv", F.round("rms_uv", 3))


@query(f"WITH {_RMS} SELECT recording_id, channel_id FROM rms WHERE NOT rms_uv BETWEEN 3 AND 1000")
def flt08_bad_by_rms(spark, d):
    """Channels with an rms outside of what is usual."""
    return ch.bad_by_rms(wf.rms_by_channel(_traces(spark, d)), 3, 1000).select("recording_id", "channel_id")


@query("SELECT DISTINCT snippet_id, window_lo + 9 AS window_lo, window_lo + 29 AS window_hi, len(data[1][10:30]) AS n, data[1][10] + 0 AS first_reading FROM snippets WHERE valid AND data IS NOT NULL")
def flt09_select_window(spark, d):
    """Snippets cut to their middle readings."""
    rows = wf.select_window(table(spark, d, "snippets").where("valid and data is not null"), 10, 30)
    return rows.select("snippet_id", "window_lo", "window_hi", F.size(F.col("data")[0]).alias("n"), (F.col("data")[0][0] + F.lit(0.0).cast("float")).alias("first_reading")).distinct()


@query(f"WITH {_SP} SELECT spike_id, false AS is_cutoff FROM sp")
def set01_accept_cutoff(spark, d):
    """Cutoff spikes taken in."""
    return sp.accept_cutoff(_spikes(spark, d, "is_cutoff")).select("spike_id", "is_cutoff")


@query(f"WITH {_SP} SELECT spike_id, cluster_id FROM sp WHERE NOT is_cutoff AND cluster_id IN (0, 2, 4)")
def flt02_mask_clusters(spark, d):
    """Spikes of some clusters, without cutoff spikes."""
    return _spikes(spark, d, "cluster_id", "is_cutoff").where("not is_cutoff and cluster_id in (0, 2, 4)").select("spike_id", "cluster_id")


_LONG = f"{_TC}, long AS (SELECT snippet_id, recording_id, channel_id, t, x[t]::DOUBLE AS v FROM tc, range(1, 41) g(t))"


def _long(spark, d):
    return wf.readings(_traces(spark, d))


@query(f"WITH {_LONG} SELECT recording_id, channel_id, count(v) AS n, sum(v) AS total, round(avg(v), 6) AS mean, min(v) + 0 AS low, max(v) + 0 AS high, max(v) - min(v) AS spread, round(var_samp(v), 4) AS variance, bool_and(v <> 0) AS all_set, bool_or(v <> 0) AS any_set FROM long GROUP BY 1, 2")
def agg21_reduce(spark, d):
    """Reductions of all readings of a channel."""
    r = tensor.reduce_dims(_long(spark, d), ["recording_id", "channel_id"])
    return r.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4), "low": F.col("low") + 0, "high": F.col("high") + 0})


@query(f"WITH {_LONG}, z AS (SELECT snippet_id, channel_id, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z FROM long WINDOW w AS (PARTITION BY snippet_id, channel_id)) SELECT snippet_id, channel_id, round(max(z), 6) AS z_max FROM z GROUP BY 1, 2")
def fn08_zscore(spark, d):
    """Largest z-score within each trace."""
    return tensor.zscore(_long(spark, d), ["snippet_id", "channel_id"]).groupBy("snippet_id", "channel_id").agg(F.round(F.max("z"), 6).alias("z_max"))


@query(f"WITH {_LONG} SELECT snippet_id, channel_id, CAST(floor((t - 1) / 8) + 1 AS INT) AS t, round(avg(v), 6) AS v FROM long GROUP BY 1, 2, 3")
def agg22_block_mean(spark, d):
    """Means of eight readings at a time."""
    return tensor.block_mean(_long(spark, d), {"t": 8}, ["snippet_id", "channel_id"]).withColumn("v", F.round("v", 6))


@query(f"WITH {_TC} SELECT snippet_id, channel_id, CAST(list_position(x, list_min(x)) AS INT) AS at_min, list_min(x)::DOUBLE + 0 AS low, CAST(list_position(x, list_max(x)) AS INT) AS at_max, list_max(x)::DOUBLE + 0 AS high FROM tc")
def agg23_arg_extreme(spark, d):
    """Place of the first smallest and largest reading of each trace."""
    return tensor.arg_extreme(_long(spark, d), "t", ["snippet_id", "channel_id"]).withColumns({"low": F.col("low") + 0, "high": F.col("high") + 0})


@query(f"WITH {_LONG} SELECT snippet_id, channel_id, sum(v * CASE WHEN t <= 20 THEN -1 ELSE 1 END) + 0 AS v FROM long GROUP BY 1, 2")
def sig15_combine(spark, d):
    """Second half of each trace less the first."""
    weights = F.broadcast(spark.range(1, 41).select(F.col("id").cast("int").alias("t"), F.lit(1).alias("new"), F.when(F.col("id") <= 20, -1.0).otherwise(1.0).alias("w")))
    return tensor.combine(_long(spark, d), weights, "t", ["snippet_id", "channel_id"]).select("snippet_id", "channel_id", (F.col("v") + 0).alias("v"))


@query(f"WITH {_LONG}, e AS (SELECT snippet_id, channel_id, max(v) OVER (PARTITION BY snippet_id, channel_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS e FROM long) SELECT snippet_id, channel_id, count(DISTINCT e) AS n_steps FROM e GROUP BY 1, 2")
def win06_envelope(spark, d):
    """Steps of the non-decreasing envelope of each trace."""
    return tensor.running_extreme(_long(spark, d), "t", ["snippet_id", "channel_id"]).groupBy("snippet_id", "channel_id").agg(F.count_distinct(F.col("envelope") + 0).alias("n_steps"))


@query("""WITH s AS (SELECT DISTINCT ON (recording_id, file_ord, band, sample_idx) recording_id, file_ord, band, sample_idx, x FROM samples WHERE sample_idx IS NOT NULL AND x IS NOT NULL ORDER BY recording_id, file_ord, band, sample_idx),
u AS (SELECT recording_id, file_ord, band, sample_idx, (sample_idx - 1) // 65536 AS chunk, unnest(range(1, len(x) + 1)) AS c, unnest(x)::DOUBLE AS v FROM s),
m AS (SELECT recording_id, file_ord, band, chunk, c, round(median(v)) AS cm FROM u GROUP BY ALL),
p AS (SELECT u.*, greatest(-32768, least(32767, round(v - cm))) AS q FROM u JOIN m USING (recording_id, file_ord, band, chunk, c)),
k AS (SELECT recording_id, file_ord, band, sample_idx, round(median(q)) AS sm FROM p GROUP BY ALL)
SELECT recording_id, file_ord, band, sample_idx, list(CAST(greatest(-32768, least(32767, round(q - sm))) AS SMALLINT) ORDER BY c) AS x FROM p JOIN k USING (recording_id, file_ord, band, sample_idx) GROUP BY ALL""")
def sig01_common_average(spark, d):
    """Samples of both bands less the medians of their chunk."""
    rows = table(spark, d, "samples").select("recording_id", "file_ord", "band", "sample_idx", "x")
    return signal.transform_chunks(rows, ["recording_id", "file_ord", "band"], [signal.common_average], 1 << 16)


def _events(spark, d):
    return table(spark, d, "events").withColumn("second", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01', date_trunc('second', ts))"))


@query("SELECT user_id, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 86400 AS BIGINT) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_daily_events(spark, d):
    """Events and their value per user and day."""
    return _events(spark, d).groupBy("user_id", F.floor(F.col("second") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_PC = [(i, j) for i in range(2) for j in range(3)]


def _features(spark, d):
    rows = table(spark, d, "spikes").select("spike_id", "recording_id", "cluster_id", "spike_time", "pc_features").dropDuplicates(["spike_id"])
    return rows, [F.get(F.get("pc_features", F.lit(i)), F.lit(j)) for i, j in _PC]


_CEN = """ft AS (SELECT DISTINCT ON (spike_id) spike_id, recording_id, cluster_id, spike_time, pc_features AS p FROM spikes WHERE pc_features IS NOT NULL ORDER BY spike_id),
cen AS (SELECT recording_id, cluster_id, avg(p[1][1]::DOUBLE) AS a, avg(p[1][2]::DOUBLE) AS b, avg(p[1][3]::DOUBLE) AS c, avg(p[2][1]::DOUBLE) AS d, avg(p[2][2]::DOUBLE) AS e, avg(p[2][3]::DOUBLE) AS f FROM ft GROUP BY 1, 2),
pd AS (SELECT x.recording_id, x.cluster_id, y.cluster_id AS other, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) + pow(x.d - y.d, 2) + pow(x.e - y.e, 2) + pow(x.f - y.f, 2)) AS distance FROM cen x JOIN cen y ON x.recording_id = y.recording_id AND x.cluster_id <> y.cluster_id)"""


@query(f"WITH {_CEN} SELECT recording_id, cluster_id, other, round(distance, 5) AS distance FROM pd WHERE cluster_id < other")
def sig20_cluster_distances(spark, d):
    """Distances between the feature centroids of a recording's clusters."""
    rows, f = _features(spark, d)
    return templates.distances(templates.feature_centroids(rows, ["recording_id", "cluster_id"], f), ["recording_id"], "cluster_id").withColumn("distance", F.round("distance", 5))


@query(f"WITH {_CEN} SELECT recording_id, cluster_id, other, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, cluster_id ORDER BY distance, other) AS rank FROM pd) WHERE rank <= 3")
def top03_similar_clusters(spark, d):
    """The three clusters nearest to each."""
    rows, f = _features(spark, d)
    pairs = templates.distances(templates.feature_centroids(rows, ["recording_id", "cluster_id"], f), ["recording_id"], "cluster_id")
    return templates.most_similar(pairs, ["recording_id"], "cluster_id", 3).select("recording_id", "cluster_id", "other", "rank")


@query(f"""WITH {_CEN}, b AS (SELECT recording_id, cluster_id, CAST(floor(spike_time / {BIN}) AS BIGINT) AS bin, avg(p[1][1]::DOUBLE) AS a, avg(p[1][2]::DOUBLE) AS b, avg(p[1][3]::DOUBLE) AS c, avg(p[2][1]::DOUBLE) AS d, avg(p[2][2]::DOUBLE) AS e, avg(p[2][3]::DOUBLE) AS f FROM ft GROUP BY 1, 2, 3)
SELECT x.recording_id, x.cluster_id, round(max(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) + pow(x.d - y.d, 2) + pow(x.e - y.e, 2) + pow(x.f - y.f, 2))), 5) AS drift
FROM b x JOIN b y ON x.recording_id = y.recording_id AND x.cluster_id = y.cluster_id AND x.bin < y.bin GROUP BY 1, 2""")
def agg24_drift_distance(spark, d):
    """How far a cluster's centroid wanders between stretches of time."""
    rows, f = _features(spark, d)
    parts = templates.feature_centroids(rows.withColumn("bin", F.floor(F.col("spike_time") / BIN)), ["recording_id", "cluster_id", "bin"], f)
    return templates.drift_distance(templates.distances(parts, ["recording_id", "cluster_id"], "bin"), ["recording_id", "cluster_id"]).withColumn("drift", F.round("drift", 5))


_SW = "sw AS (SELECT DISTINCT snippet_id AS window_id, recording_id, sample_idx + window_lo AS w_lo, sample_idx + window_hi AS w_hi FROM snippets)"


def _snippet_windows(spark, d):
    return table(spark, d, "snippets").select(F.col("snippet_id").alias("window_id"), "recording_id", (F.col("sample_idx") + F.col("window_lo")).alias("w_lo"), (F.col("sample_idx") + F.col("window_hi")).alias("w_hi")).distinct()


@query(f"WITH {_SP}, {_SW} SELECT window_id, spike_id FROM sp JOIN sw ON sp.recording_id = sw.recording_id AND spike_time BETWEEN w_lo - 20000 AND w_hi + 20000")
def jn11_overlap(spark, d):
    """Spikes whose surroundings touch a snippet's window."""
    return templates.overlapping(_spikes(spark, d, "spike_time"), _snippet_windows(spark, d), 20_000, 20_000).select("window_id", "spike_id")


@query(f"""WITH {_SP}, {_CAT}, sm AS (SELECT DISTINCT recording_id, file_ord, band, sample_idx, x FROM samples),
ap AS (SELECT sm.recording_id, sm.file_ord, sample_idx + cat_stop - samples_pre_shift AS idx, x FROM sm JOIN cat ON sm.recording_id = cat.recording_id AND sm.file_ord = cat.file_ord WHERE band = 'ap'),
lf AS (SELECT spike_id, sp.recording_id, file_ord, CAST(floor((spike_time - (cat_stop - samples_pre_shift) - 1) * 2500.0::DOUBLE / 30000.0::DOUBLE) + 1 AS BIGINT) AS idx FROM sp JOIN cat ON sp.recording_id = cat.recording_id AND spike_time BETWEEN cat_stop - samples_pre_shift + 1 AND cat_stop)
SELECT spike_id AS request_id, 'ap' AS band, file_ord, idx - spike_time AS "offset", x[1] AS x1 FROM sp JOIN ap ON sp.recording_id = ap.recording_id AND idx - spike_time BETWEEN -60 AND 60
UNION ALL SELECT spike_id, 'lf', lf.file_ord, sample_idx - idx, x[1] FROM lf JOIN sm ON lf.recording_id = sm.recording_id AND lf.file_ord = sm.file_ord AND band = 'lf' AND sample_idx - idx BETWEEN -60 AND 60""")
def sig06_snippet_samples(spark, d):
    """Samples of every file and both bands around each spike, with the file they stem from.

    In the fast band a window goes on in the next file of the concatenation; in the slow band it is that
    of the spike's own file, around the sample on at the spike.
    """
    s = table(spark, d, "samples").select("recording_id", "file_ord", "band", "sample_idx", "x").distinct()
    files = timeshift.concatenated(_files(spark, d))
    rows = _spikes(spark, d, "spike_time").select("recording_id", F.col("spike_id").alias("request_id"), "spike_time")
    fast = s.where("band = 'ap'").join(files, ["recording_id", "file_ord"]).select("recording_id", (F.col("sample_idx") + F.col("cat_start") - 1).alias("sample_idx"), F.struct("file_ord", "x").alias("x"))
    ap = templates.snippet_samples(rows.withColumn("at", F.col("spike_time")), fast, ["recording_id"], -60, 60).select("request_id", F.lit("ap").alias("band"), "x.file_ord", "offset", F.col("x.x")[0].alias("x1"))
    at = timeshift.source_file(rows, files, "spike_time").withColumn("at", scalars.convert_sample(F.col("source_idx"), FS, 2500.0))
    lf = templates.snippet_samples(at, s.where("band = 'lf'"), ["recording_id", "file_ord"], -60, 60).select("request_id", F.lit("lf").alias("band"), "file_ord", "offset", F.col("x")[0].alias("x1"))
    return ap.unionByName(lf)


@query(f"WITH {_SP} SELECT spike_id, CAST(floor((spike_time - 1) / 2000000) AS INT) AS batch FROM sp")
def jn10_batches(spark, d):
    """The batch last begun at each spike."""
    s = _spikes(spark, d, "spike_time").select("spike_id", "recording_id", "spike_time")
    last = s.groupBy("recording_id").agg(F.max("spike_time").alias("last"))
    marks = last.select("recording_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 2_000_000).cast("int"))).alias("batch")).withColumn("start", F.col("batch").cast("long") * 2_000_000 + 1)
    return joins.as_of(s, marks, ["recording_id"], "spike_time", "start", "batch").select("spike_id", "batch")


@query()
def sig16_components(spark, d):
    """Principal components of the spike features."""
    rows, f = _features(spark, d)
    _, comps, share = templates.principal_components(rows, f, 3)
    return spark.createDataFrame([(i + 1, [float(x) for x in c], float(s)) for i, (c, s) in enumerate(zip(comps, share))], "component int, weights array<double>, share double")


@query("""WITH s AS (SELECT DISTINCT recording_id, file_ord, gain, CASE WHEN lower(trim(gain_unit)) IN ('db', 'decibel', 'decibels') OR regexp_matches(note, '(gain is in dB|gain column: decibel|gain .dB.|amplifier setting logged as decibel)') THEN pow(10, gain / 20) ELSE gain END AS g FROM concat_segments WHERE gain > 0),
f AS (SELECT DISTINCT recording_id, file_ord, CAST(round(round(g, 6)) AS BIGINT) AS gain_x FROM s WHERE round(round(g, 6)) >= 1),
c AS (SELECT recording_id, CAST(list_reduce(list_sort(list_distinct(list(gain_x))), lambda a, b: lcm(a, b)) AS BIGINT) AS common_gain FROM f GROUP BY 1)
SELECT recording_id, file_ord, gain_x, common_gain, common_gain // gain_x AS times FROM f JOIN c USING (recording_id)""")
def fn06_common_gain(spark, d):
    """The gain to which all files of a recording can be raised, and each file's multiplier."""
    units = segments_in_common_units(table(spark, d, "concat_segments"), table(spark, d, "recording_meta"))
    return ch.common_gains(units.select("recording_id", "file_ord", F.round(F.round("gain_factor", 6)).cast("long").alias("gain_x")).distinct())


@query("""WITH m AS (SELECT DISTINCT recording_id, ltrim(meta_key, '~ ') AS k, trim(meta_value) AS v FROM recording_meta WHERE trim(meta_value) <> ''),
w AS (SELECT recording_id, min(v) FILTER (k = 'nSavedChans') AS n, min(v) FILTER (k = 'imSampRate') AS fs, min(v) FILTER (k = 'imroTbl') AS t, min(v) FILTER (k = 'imHpFlt') AS hp, min(v) FILTER (k = 'syncBitNames') AS y FROM m GROUP BY 1)
SELECT recording_id, TRY_CAST(n AS INT) AS n_channels, TRY_CAST(fs AS DOUBLE) AS fs, TRY_CAST(regexp_extract(t, '\\)\\(\\d+ \\d+ \\d+ (\\d+) (\\d+)', 1) AS INT) AS gain_ap, TRY_CAST(regexp_extract(t, '\\)\\(\\d+ \\d+ \\d+ (\\d+) (\\d+)', 2) AS INT) AS gain_lf,
TRY_CAST(regexp_extract(hp, '\\d+') AS DOUBLE) AS highpass_hz, len(string_split_regex(y, '[;,]')) AS n_sync_names FROM w""")
def src04_metadata(spark, d):
    """Typed fields of every recording's metadata."""
    return ini.recording_fields(table(spark, d, "recording_meta"))
