"""Queries over templates, places of spikes, drift and duplicates, each with the SQL it must agree with."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from voltlake.functions import scalars
from voltlake.operators import curation, drift, joins, metrics, signal, templates, tensor, timeshift
from voltlake.operators import spikes as sp
from voltlake.operators import trials as tr
from voltlake.operators import waveforms as wf
from voltlake.operators.units import segments_in_common_units
from voltlake.plans import reference as ref
from voltlake.plans.reference import BIN, _SP, _TC, _TR, _spikes, _traces, _trials
from voltlake.runtime import checkpoint, table
from voltlake.sources import recording
from voltlake.streaming import binned

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_W = f"""{_TC}, tt AS (SELECT recording_id, CAST(cluster_id AS INT) AS template_id, channel_id, t, avg(x[t]::DOUBLE * scale) AS v FROM tc, range(1, 41) g(t) WHERE NOT isnan(x[t]) GROUP BY ALL),
tw AS (SELECT recording_id, template_id, channel_id, max(v) - min(v) AS r, greatest(abs(max(v)), abs(min(v))) AS p, list_position(list(v ORDER BY t), max(v)) AS tmax, list_position(list(v ORDER BY t), min(v)) AS tmin FROM tt GROUP BY 1, 2, 3),
am AS (SELECT recording_id, template_id, max(r) AS amplitude, arg_max(channel_id, row(r, -channel_id)) AS channel_id, arg_max(tmax - tmin, row(r, -channel_id)) AS ttp FROM tw GROUP BY 1, 2)"""
_PL = f"""{_W}, tl AS (SELECT *, max(r) OVER (PARTITION BY recording_id, template_id) AS top FROM tw),
pl AS (SELECT recording_id, template_id, sum(r * pos_x) / nullif(sum(r), 0) AS x, sum(r * pos_y) / nullif(sum(r), 0) AS y FROM tl JOIN channels USING (channel_id) WHERE r >= 0.1 * top GROUP BY 1, 2)"""
_NEAR = """cn AS (SELECT a.channel_id AS peak, b.channel_id, row_number() OVER (PARTITION BY a.channel_id ORDER BY CASE WHEN a.channel_id = b.channel_id THEN -1 ELSE pow(a.pos_x - b.pos_x, 2) + pow(a.pos_y - b.pos_y, 2) + pow(a.pos_z - b.pos_z, 2) END, b.channel_id) AS rank FROM channels a JOIN channels b ON a.pos_x IS NOT NULL AND b.pos_x IS NOT NULL),
bc AS (SELECT recording_id, template_id, cn.channel_id, rank FROM am JOIN cn ON am.channel_id = cn.peak WHERE rank <= 24)"""
_USE = "us AS (SELECT recording_id, cluster_id, template_id, n, n / sum(n) OVER (PARTITION BY recording_id, cluster_id) AS share, row_number() OVER (PARTITION BY recording_id, cluster_id ORDER BY n DESC, template_id) AS rank FROM (SELECT recording_id, cluster_id, template_id, count(*) AS n FROM sp WHERE template_id IS NOT NULL GROUP BY ALL))"
_DEEP = f"""{_SP}, {_W}, {_NEAR}, ft AS (SELECT spike_id, any_value(pc_features) AS pc FROM spikes GROUP BY 1),
s2 AS (SELECT recording_id, template_id, max(pos_x) FILTER (rank = 1) AS x1, max(pos_x) FILTER (rank = 2) AS x2, max(pos_y) FILTER (rank = 1) AS y1, max(pos_y) FILTER (rank = 2) AS y2 FROM bc JOIN channels USING (channel_id) WHERE rank <= 2 GROUP BY 1, 2),
q AS (SELECT sp.*, pow(greatest(pc[1][1]::DOUBLE, 0), 2) AS q1, pow(greatest(pc[2][1]::DOUBLE, 0), 2) AS q2, sp.amplitude * am.amplitude AS uv, x1, x2, y1, y2 FROM sp JOIN ft USING (spike_id) LEFT JOIN am ON sp.recording_id = am.recording_id AND sp.template_id = am.template_id LEFT JOIN s2 ON sp.recording_id = s2.recording_id AND sp.template_id = s2.template_id),
dp AS (SELECT *, (q1 * x1 + q2 * x2) / nullif(q1 + q2, 0) AS x, (q1 * y1 + q2 * y2) / nullif(q1 + q2, 0) AS y FROM q)"""


def _templates(spark, d):
    """Mean waveforms as templates; checkpointed, since several steps of a query read them and they are few."""
    return checkpoint(metrics.from_means(wf.mean_waveforms(_traces(spark, d), ["recording_id", "cluster_id"]).where("not isnan(mean_uv)")))


def _use(spark, d):
    return sp.template_use(_spikes(spark, d, "cluster_id", "template_id"))


def _deep(spark, d):
    """Spikes once each, with the place and amplitude that their features and template give."""
    first = [F.get(F.get("pc_features", F.lit(c)), F.lit(0)).alias(f"_p{c}") for c in range(2)]
    rows = table(spark, d, "spikes").select("spike_id", "recording_id", "cluster_id", "template_id", "spike_time", "amplitude", *first).dropDuplicates(["spike_id"])
    rows = rows.withColumn("pc_features", F.array(F.array("_p0"), F.array("_p1"))).drop("_p0", "_p1")
    t, c = _templates(spark, d), table(spark, d, "channels")
    return metrics.spike_places(rows, metrics.best_channels(t, c, 2), c, metrics.amplitudes(t)).drop("pc_features")


@query(f"WITH {_W} SELECT recording_id, template_id, round(amplitude, 5) AS amplitude, channel_id, round(CASE WHEN ttp > 0 THEN ttp / 30.0::DOUBLE END, 5) AS ttp_ms FROM am")
def agg13_template_size(spark, d):
    """Amplitude, peak channel and trough-to-peak time of every template."""
    return metrics.amplitudes(_templates(spark, d)).withColumns({"amplitude": F.round("amplitude", 5), "ttp_ms": F.round("ttp_ms", 5)})


@query(f"""WITH {_SP}, {_W}, {_USE}, c AS (SELECT recording_id, cluster_id, sum(n * ttp / 30.0::DOUBLE) / sum(n) AS ttp_ms FROM us JOIN am USING (recording_id, template_id) WHERE ttp > 0 GROUP BY 1, 2),
a AS (SELECT recording_id, cluster_id, avg(spike_amplitude) AS mean_uv FROM sp WHERE NOT isnan(spike_amplitude) GROUP BY 1, 2)
SELECT recording_id, cluster_id, round(mean_uv, 5) AS mean_uv, round(ttp_ms, 5) AS ttp_ms FROM a LEFT JOIN c USING (recording_id, cluster_id)""")
def agg13_cluster_shape(spark, d):
    """Mean amplitude of each cluster's spikes and trough-to-peak time weighted by its templates' use."""
    mean = _spikes(spark, d, "cluster_id", "spike_amplitude").where("not isnan(spike_amplitude)").groupBy(*sp.KEY).agg(F.round(F.avg("spike_amplitude"), 5).alias("mean_uv"))
    shape = metrics.cluster_shape(_use(spark, d), metrics.amplitudes(_templates(spark, d))).withColumn("ttp_ms", F.round("ttp_ms", 5))
    return mean.join(shape, sp.KEY, "left")


@query(f"WITH {_PL} SELECT recording_id, template_id, round(x, 4) AS x, round(y, 4) AS y FROM pl")
def sig11_template_places(spark, d):
    """Where each template is centred on the probe."""
    return metrics.places(_templates(spark, d), table(spark, d, "channels")).withColumns({c: F.round(c, 4) for c in "xy"})


@query(f"""WITH {_SP}, {_W}, {_USE}, tl AS (SELECT *, max(p) OVER (PARTITION BY recording_id, template_id) AS top FROM tw), big AS (SELECT recording_id, template_id, pos_x, pos_y FROM tl JOIN channels USING (channel_id) WHERE p >= 0.5 * top),
lo AS (SELECT recording_id, template_id, max(sqrt(pow(a.pos_x - b.pos_x, 2) + pow(a.pos_y - b.pos_y, 2))) < 30 AS localized FROM big a JOIN big b USING (recording_id, template_id) GROUP BY 1, 2)
SELECT recording_id, cluster_id, coalesce(bool_and(localized), true) AS localized FROM us LEFT JOIN lo USING (recording_id, template_id) GROUP BY 1, 2""")
def agg14_all_localized(spark, d):
    """Clusters all of whose templates are localized."""
    return metrics.all_localized(_use(spark, d), metrics.localized(_templates(spark, d), table(spark, d, "channels"), reach=30.0))


@query(f"WITH {_W}, {_NEAR} SELECT recording_id, template_id, channel_id, CAST(rank AS INT) AS rank FROM bc")
def top04_best_channels(spark, d):
    """The 24 best channels of each template."""
    return metrics.best_channels(_templates(spark, d), table(spark, d, "channels")).select("recording_id", "template_id", "channel_id", "rank")


@query(f"WITH {_W}, {_NEAR} SELECT recording_id, channel_id, template_id, CAST(rank AS INT) AS rank FROM (SELECT bc.recording_id, bc.channel_id, bc.template_id, row_number() OVER (PARTITION BY bc.recording_id, bc.channel_id ORDER BY amplitude DESC, bc.template_id) AS rank FROM bc JOIN am USING (recording_id, template_id)) WHERE rank <= 3")
def top05_templates_on_channel(spark, d):
    """The three largest templates on each channel."""
    t = _templates(spark, d)
    return metrics.on_channels(metrics.best_channels(t, table(spark, d, "channels")), metrics.amplitudes(t), 3)


@query(f"""WITH {_W}, ms AS (SELECT recording_id, channel_id, greatest(sqrt(avg(v * v)), 1e-6) AS rms FROM tt GROUP BY 1, 2),
un AS (SELECT recording_id, template_id, channel_id, max(v / rms * rms) - min(v / rms * rms) AS r FROM tt JOIN ms USING (recording_id, channel_id) GROUP BY 1, 2, 3)
SELECT recording_id, template_id, round(max(r), 5) AS amplitude FROM un GROUP BY 1, 2""")
def sig10_unwhiten(spark, d):
    """Amplitudes of templates whitened by their channels' root mean square and brought back by the inverse matrix."""
    t = _templates(spark, d)
    ss = F.aggregate("w", F.lit(0.0), lambda a, v: a + v * v)
    rms = t.groupBy("recording_id", "channel_id").agg(F.greatest(F.sqrt(F.sum(ss) / F.sum(F.size("w"))), F.lit(1e-6)).alias("f"))
    white = t.join(rms, ["recording_id", "channel_id"]).select("recording_id", "template_id", "channel_id", F.transform("w", lambda v: v / F.col("f")).alias("w"))
    back = metrics.unwhitened(white, rms.select("recording_id", "channel_id", F.col("channel_id").alias("to_channel"), "f"))
    return metrics.amplitudes(back).select("recording_id", "template_id", F.round("amplitude", 5).alias("amplitude"))


@query(f"WITH {_DEEP} SELECT spike_id, round(uv, 4) AS uv, round(x, 4) AS x, round(y, 4) AS y FROM dp")
def sig13_spike_places(spark, d):
    """Amplitude and place of every spike from its features and template."""
    return _deep(spark, d).select("spike_id", *(F.round(c, 4).alias(c) for c in ("uv", "x", "y")))


_SIM = f"""{_W}, nr AS (SELECT recording_id, template_id, sqrt(sum(v * v)) AS nrm FROM tt GROUP BY 1, 2),
cc AS (SELECT a.recording_id, a.template_id, b.template_id AS other, b.t - a.t AS lag, sum(a.v * b.v) AS c FROM tt a JOIN tt b ON a.recording_id = b.recording_id AND a.channel_id = b.channel_id AND a.template_id <> b.template_id AND b.t - a.t BETWEEN -6 AND 6 GROUP BY ALL),
sc AS (SELECT cc.recording_id, cc.template_id, other, lag, c / nullif(x.nrm * y.nrm, 0) AS s FROM cc JOIN nr x ON cc.recording_id = x.recording_id AND cc.template_id = x.template_id JOIN nr y ON cc.recording_id = y.recording_id AND cc.other = y.template_id),
bs AS (SELECT recording_id, template_id, other, coalesce(least(greatest(s, 0), 1), 0) AS similarity, CASE WHEN coalesce(least(greatest(s, 0), 1), 0) < 0.1 THEN 0 ELSE lag END AS lag FROM sc QUALIFY row_number() OVER (PARTITION BY recording_id, template_id, other ORDER BY round(s, 9) DESC NULLS LAST, abs(lag), lag) = 1)"""


@query(f"WITH {_SIM} SELECT recording_id, template_id, other, round(similarity, 5) AS similarity, CAST(lag AS INT) AS lag FROM bs")
def sig14_similarity(spark, d):
    """Similarity of templates over lags of up to six samples."""
    return metrics.similarity(_templates(spark, d), 6).withColumn("similarity", F.round("similarity", 5))


@query(f"WITH {_SP}, {_SIM}, {_USE}, s AS (SELECT recording_id, template_id, other, similarity FROM bs UNION ALL SELECT DISTINCT recording_id, template_id, template_id, 1.0::DOUBLE FROM us) SELECT a.recording_id, a.cluster_id, b.cluster_id AS other_cluster, round(sum(a.share * similarity * b.share), 5) AS similarity FROM us a JOIN s ON a.recording_id = s.recording_id AND a.template_id = s.template_id JOIN us b ON b.recording_id = s.recording_id AND b.template_id = s.other WHERE a.cluster_id < b.cluster_id GROUP BY ALL")
def sig14_cluster_similarity(spark, d):
    """Similarity of clusters by the templates they use."""
    return metrics.cluster_similarity(_use(spark, d), metrics.similarity(_templates(spark, d), 6)).withColumn("similarity", F.round("similarity", 5))


@query(f"WITH {_SIM} SELECT recording_id, template_id, other, CAST(lag AS INT) AS lag, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, template_id ORDER BY round(similarity, 9) DESC, other) AS rank FROM bs WHERE similarity >= 0.2) WHERE rank <= 3")
def top03_similar_templates(spark, d):
    """The three templates most similar to each, with the lag."""
    return metrics.most_similar(metrics.similarity(_templates(spark, d), 6), 3, 0.2).select("recording_id", "template_id", "other", "lag", "rank")


@query(f"""WITH {_SP}, {_W}, {_USE}, sc AS (SELECT recording_id, template_id, avg(amplitude) AS scale FROM sp WHERE template_id IS NOT NULL GROUP BY 1, 2)
SELECT us.recording_id, cluster_id, us.template_id, channel_id, round(r * abs(scale), 4) AS vrange FROM us JOIN tw ON us.recording_id = tw.recording_id AND us.template_id = tw.template_id JOIN sc ON us.recording_id = sc.recording_id AND us.template_id = sc.template_id WHERE rank = 1""")
def sig21_cluster_templates(spark, d):
    """Range on each channel of the scaled template that a cluster uses most."""
    scale = _spikes(spark, d, "template_id", "amplitude").where("template_id is not null").groupBy("recording_id", "template_id").agg(F.avg("amplitude").alias("scale"))
    rows = metrics.cluster_templates(_use(spark, d), _templates(spark, d), scale)
    return rows.select("recording_id", "cluster_id", "template_id", "channel_id", F.round(F.array_max("w") - F.array_min("w"), 4).alias("vrange"))


_DUP = f"""{_SP}, {_PL}, sx AS (SELECT sp.*, x, y FROM sp LEFT JOIN pl ON sp.recording_id = pl.recording_id AND sp.template_id = pl.template_id),
o AS (SELECT *, CASE WHEN spike_time - lag(spike_time) OVER w < 3000 THEN 0 ELSE 1 END AS f FROM sx WINDOW w AS (PARTITION BY recording_id ORDER BY spike_time, spike_id)),
i AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY spike_time, spike_id) AS isle FROM o),
k AS (SELECT recording_id, isle, list({{'t': spike_time, 'i': spike_id, 'x': x, 'y': y}} ORDER BY spike_time, spike_id) AS s FROM i GROUP BY 1, 2 HAVING count(*) > 1),
g AS (SELECT recording_id, isle, s, 2 AS k, [s[1]] AS live, CAST(NULL AS BIGINT) AS spike_id, CAST(NULL AS BIGINT) AS of_spike FROM k
  UNION ALL SELECT recording_id, isle, s, k + 1, CASE WHEN hit IS NULL THEN list_append(live, s[k]) ELSE live END, s[k].i, hit FROM
  (SELECT *, list_filter(live, lambda l: s[k].t - l.t < 3000 AND sqrt(pow(s[k].x - l.x, 2) + pow(s[k].y - l.y, 2)) < 50)[-1].i AS hit FROM g WHERE k <= len(s))),
du AS (SELECT recording_id, spike_id, of_spike FROM g WHERE of_spike IS NOT NULL)"""


def _duplicates(spark, d):
    places = metrics.places(_templates(spark, d), table(spark, d, "channels"))
    rows = _spikes(spark, d, "spike_time", "template_id").join(places, ["recording_id", "template_id"], "left")
    return sp.duplicates(rows, 3000, 50.0)


@query(f"WITH RECURSIVE {_DUP} SELECT recording_id, spike_id, of_spike FROM du")
def dup01_duplicates(spark, d):
    """Spikes that duplicate an earlier one of a near template within 3000 samples, greedily in time order."""
    return _duplicates(spark, d)


@query(f"WITH RECURSIVE {_DUP}, n AS (SELECT du.recording_id, a.template_id AS a, b.template_id AS b, count(*) AS n FROM du JOIN sp b ON du.recording_id = b.recording_id AND du.spike_id = b.spike_id JOIN sp a ON du.recording_id = a.recording_id AND du.of_spike = a.spike_id GROUP BY ALL), al AS (SELECT recording_id, template_id AS b, count(*) AS whole FROM sp GROUP BY 1, 2) SELECT n.recording_id, a, b, n, round(n / whole, 6) AS share FROM n JOIN al USING (recording_id, b)")
def agg17_template_duplicates(spark, d):
    """Duplicates by pair of templates."""
    return metrics.duplicate_counts(_duplicates(spark, d), _spikes(spark, d, "template_id"), "template_id").withColumn("share", F.round("share", 6))


@query(f"WITH RECURSIVE {_DUP}, n AS (SELECT du.recording_id, a.cluster_id AS a, b.cluster_id AS b, count(*) AS n FROM du JOIN sp b ON du.recording_id = b.recording_id AND du.spike_id = b.spike_id JOIN sp a ON du.recording_id = a.recording_id AND du.of_spike = a.spike_id GROUP BY ALL), al AS (SELECT recording_id, cluster_id AS b, count(*) AS whole FROM sp GROUP BY 1, 2) SELECT n.recording_id, a, b, n, round(n / whole, 6) AS share FROM n JOIN al USING (recording_id, b)")
def agg17_cluster_duplicates(spark, d):
    """Duplicates by pair of clusters."""
    return metrics.duplicate_counts(_duplicates(spark, d), _spikes(spark, d, "cluster_id"), "cluster_id").withColumn("share", F.round("share", 6))


#: Deviations above which lies a tenth of normal amplitudes, as the error function's inverse of 2 (0.9 - 0.5) gives it.
LARGE = 0.9061938024368232
_HIST = f"""{_DEEP}, bd AS (SELECT recording_id, avg(uv) + {LARGE} * stddev_samp(uv) AS bound FROM dp WHERE y IS NOT NULL AND uv IS NOT NULL GROUP BY 1),
hist AS (SELECT dp.recording_id, CAST(ceil(spike_time / 3000000) AS BIGINT) AS time_bin, CAST(floor(y / 5) AS BIGINT) AS depth_bin, sum(uv) AS weight, count(*) AS n FROM dp JOIN bd ON dp.recording_id = bd.recording_id WHERE y IS NOT NULL AND uv > bound GROUP BY ALL)"""


def _hist(spark, d):
    spikes = checkpoint(_deep(spark, d).select("recording_id", "spike_time", "uv", "y"))
    return checkpoint(drift.depth_histogram(drift.large_spikes(spikes, LARGE), 5.0, 3_000_000))


@query(f"WITH {_HIST} SELECT recording_id, time_bin, depth_bin, round(weight, 3) AS weight, n FROM hist")
def sig18_depth_histogram(spark, d):
    """Amplitude of large spikes by depth and stretch of time."""
    return _hist(spark, d).withColumn("weight", F.round("weight", 3))


@query(f"""WITH {_HIST}, tb AS (SELECT DISTINCT recording_id, time_bin FROM hist), md AS (SELECT recording_id, time_bin AS tm FROM tb QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY time_bin) = floor((count(*) OVER (PARTITION BY recording_id) + 1) / 2)),
rf AS (SELECT recording_id, depth_bin AS d, weight AS w FROM hist JOIN md USING (recording_id) WHERE time_bin = tm),
sc AS (SELECT recording_id, time_bin, depth_bin - d AS shift, sum(weight * w) AS score FROM hist JOIN rf USING (recording_id) WHERE abs(depth_bin - d) <= 6 GROUP BY ALL),
bt AS (SELECT recording_id, time_bin, shift FROM sc QUALIFY row_number() OVER (PARTITION BY recording_id, time_bin ORDER BY round(score, 6) DESC, abs(shift), shift DESC) = 1)
SELECT recording_id, time_bin, (shift - first_value(shift) OVER (PARTITION BY recording_id ORDER BY time_bin)) * 5.0::DOUBLE AS offset_um FROM bt""")
def sig18_offsets(spark, d):
    """Shift of each stretch's depth histogram against the middle one, relative to the first."""
    return drift.offsets(_hist(spark, d), 5.0, 6)


@query(f"""WITH {_DEEP}, u AS (SELECT recording_id, cluster_id, quantile_disc(CAST(round(y / 0.1) AS BIGINT), 0.5) AS u FROM dp WHERE y IS NOT NULL GROUP BY 1, 2),
p AS (SELECT recording_id, cluster_id, CAST(floor(spike_time / {BIN}) AS BIGINT) AS time_bin, quantile_disc(CAST(round(y / 0.1) AS BIGINT), 0.5) AS p, count(*) AS n FROM dp WHERE y IS NOT NULL GROUP BY 1, 2, 3)
SELECT recording_id, cluster_id, time_bin, round(p * 0.1::DOUBLE, 3) AS depth, round(u * 0.1::DOUBLE, 3) AS usual, n FROM p JOIN u USING (recording_id, cluster_id) WHERE abs(p * 0.1::DOUBLE - u * 0.1::DOUBLE) > 1 AND n > 3""")
def sig19_depth_jumps(spark, d):
    """Stretches in which a cluster's median depth is off its usual one."""
    return drift.depth_jumps(_deep(spark, d), BIN, 1.0, 3).withColumns({"depth": F.round("depth", 3), "usual": F.round("usual", 3)})


_TRACE = f"""{_DEEP}, tx AS (SELECT recording_id, cluster_id, CAST(floor(spike_time / {BIN // 10}) AS BIGINT) AS time_bin, count(*) AS n, avg(y) AS depth FROM dp WHERE y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
trc AS (SELECT *, coalesce(time_bin - lag(time_bin) OVER (PARTITION BY recording_id, cluster_id ORDER BY time_bin) - 1 > 3, false) AS after_gap FROM tx)"""


def _trace(spark, d):
    return drift.depth_trace(_deep(spark, d), BIN // 10, 2, 3)


@query(f"WITH {_TRACE} SELECT recording_id, cluster_id, time_bin, n, round(depth, 4) AS depth, after_gap FROM trc")
def win07_depth_trace(spark, d):
    """Mean depth of each cluster over time, with gaps."""
    return _trace(spark, d).withColumn("depth", F.round("depth", 4))


@query(f"""WITH {_TRACE}, gr AS (SELECT recording_id, cluster_id, unnest(range(min(time_bin), max(time_bin) + 1)) AS time_bin FROM trc GROUP BY 1, 2),
fl AS (SELECT gr.*, last_value(depth IGNORE NULLS) OVER (PARTITION BY recording_id, cluster_id ORDER BY time_bin) AS depth FROM gr LEFT JOIN trc USING (recording_id, cluster_id, time_bin))
SELECT recording_id, cluster_id, time_bin, round(depth, 4) AS depth, round(depth - first_value(depth) OVER (PARTITION BY recording_id, cluster_id ORDER BY time_bin), 4) AS shift FROM fl""")
def win09_filled_shifts(spark, d):
    """Depths of all stretches of a cluster, missing ones from the one before, and shift from the first."""
    return drift.filled_shifts(_trace(spark, d)).withColumns({"depth": F.round("depth", 4), "shift": F.round("shift", 4)})


@query(f"""WITH {_SP}, c AS (SELECT * FROM sp WHERE spike_amplitude IS NOT NULL AND NOT isnan(spike_amplitude)),
q AS (SELECT recording_id, quantile_disc(CAST(round(spike_amplitude / 0.01) AS BIGINT), 0.1) * 0.01::DOUBLE AS a, quantile_disc(CAST(round(spike_amplitude / 0.01) AS BIGINT), 0.9) * 0.01::DOUBLE AS b FROM c GROUP BY 1)
SELECT recording_id, CAST(greatest(1, least(20, floor((spike_amplitude - a) / (b - a) * 20) + 1)) AS INT) AS color_bin, count(*) AS n FROM c JOIN q USING (recording_id) GROUP BY 1, 2""")
def vis02_amplitude_bins(spark, d):
    """Spikes by the colour bin of their amplitude."""
    return drift.amplitude_bins(_spikes(spark, d, "spike_amplitude"), 0.1, 0.9, 20).groupBy("recording_id", "color_bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SP}, {_TR}, n AS (SELECT tr.recording_id, trial_id, cluster_id, count(*) AS n FROM tr JOIN sp ON sp.recording_id = tr.recording_id AND spike_time BETWEEN trial_start AND least(trial_stop, trial_start + CAST(floor(fs * 0.5) AS BIGINT)) GROUP BY ALL)
SELECT recording_id, trial_id, cluster_id, n, n / 0.5::DOUBLE AS rate FROM n""")
def agg06_stability(spark, d):
    """Rate of each cluster in the first 500 ms of each trial with spikes there."""
    rows = tr.segment(_spikes(spark, d, "cluster_id", "spike_time"), tr.truncate(_trials(spark, d), 0.5)).groupBy("recording_id", "trial_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rate", F.col("n") / 0.5)


@query(f"WITH {ref._SPEC}, {_SP} SELECT spike_id, coalesce(max_by(idx_start + spike_time - shift_start, ord), 0) AS source_idx FROM sp LEFT JOIN spec ON sp.recording_id = spec.recording_id AND spike_time BETWEEN shift_start AND shift_start + idx_stop - idx_start GROUP BY 1")
def win04_source_index(spark, d):
    """For output slots, the times of spikes, the sample that fills them; the later interval wins, 0 is unfilled."""
    return timeshift.source_index(_spikes(spark, d, "spike_time"), ref._spec(spark, d), "spike_time", "spike_id").select("spike_id", "source_idx")


@query(f"WITH {_TR} SELECT recording_id, trial_id FROM tr WHERE trial_id BETWEEN 3 AND 20 AND condition_id IS NOT NULL")
def flt03_trial_range(spark, d):
    """Trials 3 to 20 of each recording that have a condition."""
    return tr.pick(_trials(spark, d), first=3, last=20).where("condition_id is not null").select("recording_id", "trial_id")


@query(f"""WITH {_SP}, l AS (SELECT recording_id, cluster_id, spike_time - lag(spike_time) OVER (PARTITION BY recording_id, cluster_id ORDER BY spike_time, spike_id) AS d FROM sp),
c AS (SELECT recording_id, cluster_id, count(*) AS n, count(*) FILTER (d < 3000) / count(*)::DOUBLE AS v FROM l GROUP BY 1, 2)
SELECT recording_id, cluster_id, CASE WHEN n < 20 THEN 'unsorted' WHEN v < 0.05 THEN 'good' WHEN v < 0.2 THEN 'mua' ELSE 'noise' END AS label FROM c""")
def flt11_groups(spark, d):
    """Clusters with spikes by group, from the share of lags that are too short."""
    return sp.groups_by_lags(_spikes(spark, d, "cluster_id", "spike_time"), 3000, 20, 0.05, 0.2)


@query("SELECT recording_id, file_ord, sample_idx, list_transform(any_value(x), lambda v: round(v * 0.78125::DOUBLE, 5)) AS uv FROM samples WHERE band = 'lf' AND x IS NOT NULL AND sample_idx BETWEEN 101 AND 400 GROUP BY 1, 2, 3")
def flt14_window_uv(spark, d):
    """Slow-band samples 101 to 400 of each file in microvolts."""
    return signal.read_window(table(spark, d, "samples").where("band = 'lf'").select("recording_id", "file_ord", "sample_idx", "x"), ["recording_id", "file_ord"], 101, 400, 0.78125)


@query("""WITH m AS (SELECT recording_id, file_ord, unnest(channel_ids) AS c FROM (SELECT DISTINCT s.recording_id, f.file_ord, s.channel_ids FROM snippets s JOIN (SELECT DISTINCT recording_id, file_ord FROM concat_segments) f ON s.recording_id = f.recording_id AND s.snippet_id % 3 = f.file_ord % 3)),
n AS (SELECT recording_id, count(DISTINCT file_ord) AS files FROM m GROUP BY 1), c AS (SELECT recording_id, c, count(DISTINCT file_ord) AS k FROM m GROUP BY 1, 2)
SELECT recording_id, c AS channel_id FROM c JOIN n USING (recording_id) WHERE k = files""")
def set03_common_channels(spark, d):
    """Channels that all parts of a recording's snippets share, parts being dealt to files by number."""
    files = table(spark, d, "concat_segments").select("recording_id", "file_ord").distinct()
    parts = table(spark, d, "snippets").select("recording_id", "snippet_id", "channel_ids").distinct().join(files, "recording_id").where("snippet_id % 3 = file_ord % 3")
    return joins.in_all(parts.select("recording_id", "file_ord", F.explode("channel_ids").alias("channel_id")), ["recording_id"], "file_ord", "channel_id")


@query(f"WITH {_SP}, {_TR}, u AS (SELECT recording_id, spike_time AS pos, 'spike' AS src FROM sp UNION ALL SELECT recording_id, trial_start, 'start' FROM tr UNION ALL SELECT recording_id, trial_stop, 'stop' FROM tr) SELECT recording_id, CAST(floor(pos / {BIN}) AS BIGINT) AS bin, src, count(*) AS n FROM u GROUP BY ALL")
def set06_with_origin(spark, d):
    """Spikes, starts and stops on one axis with their origin, counted by stretch."""
    t = _trials(spark, d)
    rows = joins.stacked({"spike": _spikes(spark, d, "spike_time").select("recording_id", F.col("spike_time").alias("at")), "start": t.select("recording_id", F.col("trial_start").alias("at")), "stop": t.select("recording_id", F.col("trial_stop").alias("at"))})
    return rows.groupBy("recording_id", F.floor(F.col("at") / BIN).alias("bin"), "src").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SP}, c AS (SELECT DISTINCT recording_id, cluster_id FROM sp), r AS (SELECT recording_id, CAST(template_id AS BIGINT) AS cluster_id, count(*) AS n FROM sp WHERE template_id IS NOT NULL GROUP BY 1, 2) SELECT recording_id, cluster_id, CASE WHEN n >= 100 THEN 3 WHEN n >= 10 THEN 2 WHEN n IS NOT NULL THEN 1 ELSE 0 END AS rating FROM c LEFT JOIN r USING (recording_id, cluster_id)")
def jn16_realign_ratings(spark, d):
    """Ratings of templates by use, realigned to the clusters: missing ones get 0, extra ones go."""
    s = _spikes(spark, d, "cluster_id", "template_id")
    n = F.count(F.lit(1))
    rated = s.where("template_id is not null").groupBy("recording_id", F.col("template_id").cast("long").alias("cluster_id")).agg(F.when(n >= 100, 3).when(n >= 10, 2).otherwise(1).alias("rating"))
    return curation.realign(rated, sp.clusters_of(s), {"rating": 0})


@query(f"WITH {_SP} SELECT recording_id, cluster_id, list(spike_id ORDER BY spike_time, spike_id) AS spikes FROM sp WHERE is_cutoff GROUP BY 1, 2")
def agg20_ragged(spark, d):
    """Cutoff spikes of each cluster as a list in time order."""
    return tensor.ragged(_spikes(spark, d, "cluster_id", "spike_time", "is_cutoff").where("is_cutoff"), sp.KEY, ["spike_time", "spike_id"], "spike_id", "spikes")


@query(f"""WITH {_TC}, r AS (SELECT recording_id, cluster_id, channel_id, t, x[t]::DOUBLE * scale AS v FROM tc, range(1, 41) g(t)), m AS (SELECT *, median(v) OVER (PARTITION BY recording_id, cluster_id, channel_id, t) AS med FROM r)
SELECT recording_id, cluster_id, channel_id, CAST(t AS INT) AS t, round(any_value(med), 5) AS med, round(median(abs(v - med)), 5) AS mad FROM m GROUP BY 1, 2, 3, 4""")
def vis05_median_waveforms(spark, d):
    """Median and median deviation of each cluster's waveforms."""
    return wf.median_waveforms(_traces(spark, d), ["recording_id", "cluster_id"]).withColumns({c: F.round(c, 5) for c in ("med", "mad")})


@query(f"WITH {_SP}, {ref._SW} SELECT window_id, spike_id, cluster_id, spike_time - w_lo AS at FROM sp JOIN sw ON sp.recording_id = sw.recording_id AND spike_time BETWEEN w_lo AND w_hi")
def vis06_overlay(spark, d):
    """Clusters of the spikes inside each snippet's window and where in it they fall."""
    rows = joins.interval_join(_spikes(spark, d, "cluster_id", "spike_time"), ref._snippet_windows(spark, d), ["recording_id"], "spike_time", "w_lo", "w_hi", tr.BUCKET)
    return rows.select("window_id", "spike_id", "cluster_id", (F.col("spike_time") - F.col("w_lo")).alias("at"))


@query(f"WITH {_SP}, {_TR} SELECT DISTINCT spike_id, round(spike_time / 30000.0::DOUBLE, 6) AS seconds, amplitude FROM sp SEMI JOIN tr ON sp.recording_id = tr.recording_id AND spike_time BETWEEN trial_start AND trial_stop WHERE NOT is_cutoff")
def vis04_amplitude_in_trials(spark, d):
    """Amplitude over time of the spikes inside trials, cutoff ones left out."""
    rows = tr.in_trials(_spikes(spark, d, "spike_time", "amplitude", "is_cutoff").where("not is_cutoff"), _trials(spark, d))
    return rows.select("spike_id", F.round(F.col("spike_time") / 30000.0, 6).alias("seconds"), "amplitude")


@query(f"WITH {ref._SPEC} SELECT tr.recording_id, trial_id, trial_start - idx_start + shift_start AS at FROM tr JOIN spec ON tr.recording_id = spec.recording_id AND trial_start BETWEEN idx_start AND idx_stop")
def vis08_trial_ticks(spark, d):
    """Starts of trials on the axis with gaps cut out."""
    moved = timeshift.shift(_trials(spark, d).select("recording_id", "trial_id", "trial_start"), ref._spec(spark, d), "trial_start")
    return moved.select("recording_id", "trial_id", F.col("shifted").alias("at"))


@query(ref._RATES + "SELECT recording_id, trial_id, cluster_id, round(avg(rate) OVER (PARTITION BY recording_id, cluster_id, condition_id ORDER BY trial_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS rate FROM g WHERE condition_id IS NOT NULL")
def vis09_smoothed_rates(spark, d):
    """Rates per condition smoothed over five trials."""
    rates = tr.firing_rates(ref.agg03_trial_cluster_counts(spark, d), _trials(spark, d)).where("condition_id is not null")
    return tr.smoothed(rates, 2).select("recording_id", "trial_id", "cluster_id", F.round("smooth", 6).alias("rate"))


@query("SELECT recording_id, file_ord, band, min(sample_idx) AS first, max(sample_idx) AS last, count(*) AS n, CAST(bit_or(sync_raw & 65535) AS INT) AS ever_on FROM (SELECT DISTINCT recording_id, file_ord, band, sample_idx, sync_raw FROM samples WHERE sync_raw IS NOT NULL) GROUP BY 1, 2, 3")
def src08_sync_scan(spark, d):
    """Extent of the sync words of every file and band, and the bits that are ever on."""
    rows = table(spark, d, "samples").where("sync_raw is not null").select("recording_id", "file_ord", "band", "sample_idx", "sync_raw").distinct()
    word = F.col("sync_raw").bitwiseAND(65535)
    return rows.groupBy("recording_id", "file_ord", "band").agg(F.min("sample_idx").alias("first"), F.max("sample_idx").alias("last"), F.count(F.lit(1)).alias("n"), F.bit_or(word).alias("ever_on"))


@query(f"WITH {_SP}, {_W}, {ref._SW}, n AS (SELECT window_id, channel_id, spike_time + t - 14 AS sample_idx, amplitude * v AS v FROM sp JOIN sw ON sp.recording_id = sw.recording_id AND spike_time BETWEEN w_lo - 26 AND w_hi + 13 JOIN tt ON sp.recording_id = tt.recording_id AND sp.template_id = tt.template_id WHERE spike_time + t - 14 BETWEEN w_lo AND w_hi) SELECT window_id, channel_id, sample_idx, round(sum(v), 4) AS v FROM n GROUP BY 1, 2, 3")
def sig08_reconstruct(spark, d):
    """What the spikes' scaled templates add up to on every channel inside the snippets' windows."""
    s = _spikes(spark, d, "spike_time", "template_id", "amplitude")
    return templates.reconstruct(s, ref._snippet_windows(spark, d), _templates(spark, d), 13, 26).withColumn("v", F.round("v", 4))


@query(f"""WITH {_TC}, b AS (SELECT recording_id, cluster_id, channel_id, scale, x, list_avg([v::DOUBLE FOR v IN x[1:10]]) AS m FROM tc), r AS (SELECT recording_id, cluster_id, channel_id, t, (x[t]::DOUBLE - m) * scale AS v FROM b, range(1, 41) g(t))
SELECT recording_id, cluster_id, channel_id, CAST(t AS INT) AS t, round(avg(v), 7) + 0 AS mean_uv FROM r GROUP BY 1, 2, 3, 4""")
def sig07_waveforms(spark, d):
    """Mean waveforms of clusters, each trace less the mean of its first ten readings."""
    means = wf.mean_waveforms(wf.centred(_traces(spark, d), 10), ["recording_id", "cluster_id"])
    return means.select("recording_id", "cluster_id", "channel_id", "t", (F.round("mean_uv", 7) + 0.0).alias("mean_uv"))


_BATCH = f"""{_TC}, bt AS (SELECT recording_id, CAST(cluster_id * 1000 + sample_idx // {BIN} AS INT) AS template_id, channel_id, t, avg(x[t]::DOUBLE * scale) AS v FROM (SELECT tc.*, sn.sample_idx FROM tc JOIN sn USING (snippet_id)) q, range(1, 41) g(t) GROUP BY ALL),
br AS (SELECT recording_id, template_id, channel_id, max(v) - min(v) AS r FROM bt GROUP BY 1, 2, 3), bl AS (SELECT *, max(r) OVER (PARTITION BY recording_id, template_id) AS top FROM br),
bp AS (SELECT recording_id, template_id, any_value(top) AS amplitude, sum(r * pos_x) / nullif(sum(r), 0) AS x, sum(r * pos_y) / nullif(sum(r), 0) AS y FROM bl JOIN channels USING (channel_id) WHERE r >= 0.1 * top GROUP BY 1, 2),
bn AS (SELECT recording_id, CAST(cluster_id * 1000 + sample_idx // {BIN} AS INT) AS template_id, count(*) AS n FROM sn GROUP BY 1, 2)"""


@query(f"WITH {_BATCH} SELECT recording_id, template_id // 1000 AS cluster_id, template_id % 1000 AS batch, n, round(amplitude, 4) AS amplitude, round(x, 4) AS x, round(y, 4) AS y FROM bp JOIN bn USING (recording_id, template_id)")
def sig17_batch_metrics(spark, d):
    """Per cluster and stretch of time: snippets, amplitude and place of their mean waveform."""
    rows = _traces(spark, d).withColumn("cluster_id", (F.col("cluster_id") * 1000 + F.floor(F.col("sample_idx") / BIN)).cast("int"))
    t = metrics.from_means(wf.mean_waveforms(rows, ["recording_id", "cluster_id"]))
    n = rows.groupBy("recording_id", F.col("cluster_id").alias("template_id")).agg(F.count_distinct("snippet_id").alias("n"))
    found = metrics.amplitudes(t).select(*metrics.TEMPLATE, F.round("amplitude", 4).alias("amplitude")).join(metrics.places(t, table(spark, d, "channels")), metrics.TEMPLATE).join(n, metrics.TEMPLATE)
    return found.select("recording_id", F.floor(F.col("template_id") / 1000).cast("int").alias("cluster_id"), (F.col("template_id") % 1000).alias("batch"), "n", "amplitude", *(F.round(c, 4).alias(c) for c in "xy"))


@query(f"WITH RECURSIVE {ref._MERGES}, st AS (SELECT recording_id, new_id, list_sort(list(cluster_id)) AS l FROM mg GROUP BY 1, 2 HAVING count(*) > 1) SELECT mg.recording_id, cluster_id, mg.new_id, list_filter(l, lambda c: c <> cluster_id) AS partners FROM mg JOIN st ON mg.recording_id = st.recording_id AND mg.new_id = st.new_id")
def cur02_partners(spark, d):
    """For each cluster of a merge set the others of the set."""
    return curation.merge_partners(curation.merge_sets(ref._pairs(spark, d)))


@query(f"WITH {_SP}, {ref._RT}, ch AS (SELECT recording_id, CAST(template_id AS BIGINT) AS cluster_id, CAST(least(count(*), 9) AS INT) AS rating FROM sp WHERE template_id IS NOT NULL GROUP BY 1, 2) SELECT recording_id, cluster_id, coalesce(ch.rating, rt.rating) AS rating, include_cutoff FROM rt FULL JOIN ch USING (recording_id, cluster_id)")
def cur05_upsert(spark, d):
    """Ratings with those of templates, by use, written over."""
    use = _spikes(spark, d, "template_id").where("template_id is not null").groupBy("recording_id", F.col("template_id").cast("long").alias("cluster_id")).agg(F.least(F.count(F.lit(1)), F.lit(9)).cast("int").alias("rating"))
    return curation.upsert(ref._ratings(spark, d), use)


@query(f"""WITH RECURSIVE {_DUP}, {ref._PAIRS}, e AS (SELECT recording_id, a, b FROM pr UNION SELECT recording_id, b, a FROM pr),
reach AS (SELECT recording_id, a AS cluster_id, a AS t FROM e UNION SELECT recording_id, a, b FROM e UNION SELECT r.recording_id, r.cluster_id, e.b FROM reach r JOIN e ON r.recording_id = e.recording_id AND r.t = e.a),
mg AS (SELECT recording_id, cluster_id, min(t) AS new_id FROM reach GROUP BY 1, 2), {ref._RT},
fin AS (SELECT rt.recording_id, coalesce(new_id, rt.cluster_id) AS cluster_id, max(rating) AS rating FROM rt LEFT JOIN mg ON rt.recording_id = mg.recording_id AND rt.cluster_id = mg.cluster_id GROUP BY 1, 2)
SELECT sp.spike_id, coalesce(new_id, sp.cluster_id) AS cluster_id FROM sp LEFT JOIN mg ON sp.recording_id = mg.recording_id AND sp.cluster_id = mg.cluster_id JOIN fin ON fin.recording_id = sp.recording_id AND fin.cluster_id = coalesce(new_id, sp.cluster_id) AND fin.rating >= 3 ANTI JOIN du ON du.recording_id = sp.recording_id AND du.spike_id = sp.spike_id""")
def cur06_resort(spark, d):
    """The whole partial re-sort: cutoff spikes taken in, clusters merged, well rated ones kept, duplicates out."""
    s = _spikes(spark, d, "cluster_id", "is_cutoff")
    return curation.resort(sp.accept_cutoff(s), curation.merge_sets(ref._pairs(spark, d)), ref._ratings(spark, d), [3, 4], _duplicates(spark, d)).select("spike_id", "cluster_id")


@query("""WITH s AS (SELECT DISTINCT recording_id, file_ord, samples_pre_shift, CASE WHEN lower(trim(gain_unit)) IN ('db', 'decibel', 'decibels') OR regexp_matches(note, '(gain is in dB|gain column: decibel|gain .dB.|amplifier setting logged as decibel)') THEN pow(10, gain / 20) ELSE gain END AS g FROM concat_segments),
f AS (SELECT DISTINCT recording_id, file_ord, CAST(round(round(g, 6)) AS BIGINT) AS gain_x FROM s WHERE g > 0 AND round(round(g, 6)) >= 1),
c AS (SELECT recording_id, CAST(list_reduce(list_sort(list_distinct(list(gain_x))), lambda a, b: lcm(a, b)) AS BIGINT) AS cg FROM f GROUP BY 1),
z AS (SELECT recording_id, file_ord, samples_pre_shift AS n, sum(samples_pre_shift) OVER (PARTITION BY recording_id ORDER BY file_ord) - samples_pre_shift AS before FROM (SELECT DISTINCT recording_id, file_ord, samples_pre_shift FROM s)),
m AS (SELECT DISTINCT ON (recording_id, file_ord, sample_idx) recording_id, file_ord, sample_idx, x FROM samples WHERE band = 'ap' AND x IS NOT NULL ORDER BY recording_id, file_ord, sample_idx)
SELECT recording_id, CAST(sample_idx + before AS BIGINT) AS cat_idx, file_ord, [CAST(greatest(-32768, least(32767, v::BIGINT * (cg // gain_x))) AS SMALLINT) FOR v IN x] AS x FROM m JOIN z USING (recording_id, file_ord) JOIN f USING (recording_id, file_ord) JOIN c USING (recording_id) WHERE sample_idx BETWEEN 1 AND n""")
def snk02_concatenate(spark, d):
    """Fast-band samples of all files of each recording on one axis, at the recording's common gain."""
    units = segments_in_common_units(table(spark, d, "concat_segments"), table(spark, d, "recording_meta")).where("gain > 0")
    gains = units.select("recording_id", "file_ord", F.round(F.round("gain_factor", 6)).cast("long").alias("gain_x")).distinct()
    files = table(spark, d, "concat_segments").select("recording_id", "file_ord", "samples_pre_shift").distinct().join(gains, ["recording_id", "file_ord"], "left")
    return recording.concatenate(table(spark, d, "samples").where("band = 'ap'").select("recording_id", "file_ord", "sample_idx", "x"), files)


@query(f"WITH {_TC}, m AS (SELECT snippet_id, channel_id, x, list_median([v::DOUBLE FOR v IN x]) AS med FROM tc), r AS (SELECT snippet_id, channel_id, [v::DOUBLE - med FOR v IN x] AS x FROM m), t AS (SELECT *, list_max([abs(v) FOR v IN x]) AS top FROM r) SELECT snippet_id, channel_id, [round(v / nullif(top, 0) + row_number() OVER (PARTITION BY snippet_id ORDER BY channel_id), 7) FOR v IN x] AS x FROM t")
def vis01_stacked(spark, d):
    """Traces of each snippet less their median, at equal height, one above the other."""
    return wf.stacked(_traces(spark, d)).select("snippet_id", "channel_id", F.transform("x", lambda v: F.round(v, 7)).alias("x"))


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY 1, 2")
def str02_windowed_counts(spark, d):
    """Events by type in windows of an hour, by the function that streams use."""
    rows = binned.counts_by_window(table(spark, d, "events").select("event_type", "ts"), "ts", "1 hour", ["event_type"])
    return rows.select("event_type", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', window.start)").alias("start_s"), "n")


_DM = """s AS (SELECT DISTINCT ON (recording_id, file_ord, band, sample_idx) recording_id, file_ord, band, sample_idx, x FROM samples WHERE sample_idx IS NOT NULL AND x IS NOT NULL ORDER BY recording_id, file_ord, band, sample_idx),
u AS (SELECT recording_id, file_ord, band, sample_idx, (sample_idx - 1) // 65536 AS chunk, unnest(range(1, len(x) + 1)) AS c, unnest(x)::DOUBLE AS v FROM s),
m AS (SELECT recording_id, file_ord, band, chunk, c, median(v) AS cm FROM u GROUP BY ALL),
dm AS (SELECT recording_id, file_ord, band, sample_idx, list(CAST(greatest(-32768, least(32767, round(v - cm))) AS SMALLINT) ORDER BY c) AS x FROM u JOIN m USING (recording_id, file_ord, band, chunk, c) GROUP BY ALL)"""


def _demeaned(spark, d):
    return signal.transform_chunks(table(spark, d, "samples").select("recording_id", "file_ord", "band", "sample_idx", "x"), ["recording_id", "file_ord", "band"], [signal.demean], 1 << 16)


@query(f"WITH {_DM} SELECT * FROM dm")
def sig03_demean(spark, d):
    """Samples less their channel's median over the chunk."""
    return _demeaned(spark, d)


@query(f"WITH {_DM} SELECT *, 'processed' AS src FROM dm UNION ALL SELECT *, 'source' FROM s")
def flt16_layers(spark, d):
    """Processed samples and those they come from, layer by layer."""
    raw = table(spark, d, "samples").select("recording_id", "file_ord", "band", "sample_idx", "x").where("sample_idx is not null and x is not null").dropDuplicates(["recording_id", "file_ord", "band", "sample_idx"])
    return joins.stacked({"processed": _demeaned(spark, d), "source": raw})


@query("""WITH f AS (SELECT DISTINCT ON (spike_id) spike_id, pc_features AS p FROM spikes WHERE pc_features IS NOT NULL ORDER BY spike_id), w AS (SELECT p[1][1]::DOUBLE AS x0, p[1][2]::DOUBLE AS x1, p[1][3]::DOUBLE AS x2, p[2][1]::DOUBLE AS x3, p[2][2]::DOUBLE AS x4, p[2][3]::DOUBLE AS x5 FROM f), """
+ "a AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, count(*) AS n, avg(x{i}) AS mean_i, avg(x{j}) AS mean_j, covar_samp(x{i}, x{j}) AS cov FROM w" for i in range(6) for j in range(i, 6)) + ") SELECT i, j, n, round(mean_i, 4) AS mean_i, round(mean_j, 4) AS mean_j, round(cov, 3) AS cov FROM a")
def sig16_moments(spark, d):
    """Means and covariances of the spike features, from which the principal components follow."""
    rows, f = ref._features(spark, d)
    return templates.moments(rows, f).withColumns({"mean_i": F.round("mean_i", 4), "mean_j": F.round("mean_j", 4), "cov": F.round("cov", 3)})


@query(f"WITH {_TC} SELECT snippet_id, channel_id, pos_x, pos_y FROM tc JOIN channels USING (channel_id)")
def jn01_trace_positions(spark, d):
    """Every trace with its channel's position; a channel that isn't in the map would be an error."""
    rows = _traces(spark, d).select("snippet_id", "channel_id")
    return joins.lookup(rows, table(spark, d, "channels").select("channel_id", "pos_x", "pos_y"), ["channel_id"])


@query(f"WITH {_SP}, {_TR} SELECT spike_id, trial_id, round((spike_time - trial_start) / fs * 1000, 6) AS ms, spike_time AS back FROM sp JOIN tr ON sp.recording_id = tr.recording_id AND spike_time BETWEEN trial_start AND trial_stop")
def fn02_times_in_trials(spark, d):
    """Spikes in ms after the start of their trial, and brought back to samples."""
    rows = tr.segment(_spikes(spark, d, "spike_time"), _trials(spark, d).select("recording_id", "trial_id", "trial_start", "trial_stop", "fs"))
    ms = scalars.sample_to_ms(F.col("spike_time"), F.col("fs"), F.col("trial_start"))
    return rows.select("spike_id", "trial_id", F.round(ms, 6).alias("ms"), scalars.ms_to_sample(ms, F.col("fs"), F.col("trial_start")).alias("back"))


@query(f"WITH {_DM} SELECT recording_id, file_ord, band, sample_idx, [CAST(greatest(-32768, least(32767, round(v::DOUBLE * 700.5))) AS SMALLINT) FOR v IN x] AS x FROM s")
def fn07_clamped(spark, d):
    """Samples raised 700.5 times, rounded and clamped to 16 bits."""
    rows = table(spark, d, "samples").select("recording_id", "file_ord", "band", "sample_idx", "x").where("sample_idx is not null and x is not null").dropDuplicates(["recording_id", "file_ord", "band", "sample_idx"])
    return rows.withColumn("x", F.transform("x", lambda v: scalars.sat_int16(v.cast("double") * 700.5)))


@query(f"WITH {_SP} SELECT DISTINCT recording_id, cluster_id FROM sp")
def set05_clusters(spark, d):
    """Every cluster of every recording."""
    return sp.clusters_of(table(spark, d, "spikes"))


@query(f"WITH {ref._LONG} SELECT snippet_id, channel_id, CAST(t AS INT) AS t, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY snippet_id, channel_id ORDER BY t) AS rank FROM long WHERE v <> 0) WHERE rank <= 3")
def win08_first_set(spark, d):
    """The three first readings of each trace that aren't zero."""
    return tensor.first_nonzero(ref._long(spark, d), "t", ["snippet_id", "channel_id"], 3).select("snippet_id", "channel_id", "t", "rank")


@query(f"""WITH {ref._LONG}, f AS (SELECT *, CASE WHEN v > 0 THEN 1 ELSE 0 END AS flag FROM long),
g AS (SELECT *, max(flag) OVER b AS g, CASE WHEN count(*) OVER b = 4 THEN min(flag) OVER b ELSE 0 END AS s FROM f WINDOW b AS (PARTITION BY snippet_id, channel_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, min(g) OVER a AS c, max(s) OVER a AS o FROM g WINDOW a AS (PARTITION BY snippet_id, channel_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT snippet_id, channel_id, count(*) FILTER (c = 1) AS n_closed, count(*) FILTER (o = 1) AS n_opened FROM h GROUP BY 1, 2""")
def win10_closing_opening(spark, d):
    """Readings above zero of each trace after gaps shorter than four are closed, and after runs shorter than four are taken out."""
    keep = ["snippet_id", "channel_id"]
    rows = ref._long(spark, d).withColumn("flag", F.col("v") > 0)
    rows = tensor.opening(tensor.closing(rows, "t", keep, 4), "t", keep, 4)
    return rows.groupBy(*keep).agg(F.count_if("closed").alias("n_closed"), F.count_if("opened").alias("n_opened"))


@query(f"WITH {_SP}, b AS (SELECT recording_id, CAST(floor(spike_time / {BIN // 10}) AS BIGINT) AS bin, count(*) AS n FROM sp WHERE is_cutoff GROUP BY 1, 2), g AS (SELECT recording_id, unnest(range(0, CAST(floor(max(spike_time) / {BIN // 10}) AS BIGINT) + 1)) AS bin FROM sp GROUP BY 1) SELECT recording_id, bin, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (recording_id, bin)")
def fn12_inflated_bins(spark, d):
    """Cutoff spikes per stretch of every recording, stretches without any filled with 0."""
    s = _spikes(spark, d, "spike_time", "is_cutoff")
    at = F.floor(F.col("spike_time") / (BIN // 10))
    grid = s.groupBy("recording_id").agg(F.max(at).alias("_b")).select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), "_b")).alias("bin"))
    counts = s.where("is_cutoff").groupBy("recording_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return tensor.inflated(counts, grid, ["recording_id", "bin"], {"n": 0})


@query()
def win07_smoothed(spark, d):
    """Depth traces of clusters smoothed between gaps."""
    return drift.smoothed_trace(_trace(spark, d)).withColumn("smooth", F.round("smooth", 3))


@query()
def sig02_highpass(spark, d):
    """Fast-band samples after a high-pass filter of third order run forward and backward over each chunk and its neighbours' nearest samples."""
    rows = table(spark, d, "samples").where("band = 'ap'").select("recording_id", "file_ord", "sample_idx", "x")
    return signal.transform_chunks(rows, ["recording_id", "file_ord"], [partial(signal.zero_phase_highpass, cutoff=300.0, fs=30000.0)], 1 << 16, 1024)
