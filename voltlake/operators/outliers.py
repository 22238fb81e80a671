"""Implausible readings in traces, flagged against the normal behaviour of their source.

A source is a channel within a recording. What is normal for it comes from counts of its
readings (exact median and median absolute deviation) and of their differences at lags 1 and 2
(a robust variogram, from which an AR(2) model follows by Yule-Walker). Every trace is then
searched for additive outliers and level shifts of that model, largest first, until none is
left; what is found is held against the source's usual level. Codes the converter can't give
and readings that stay put are tested on their own.

Layout: traces are laid out once by (recording, salt), where only recordings with more than
their share of rows get several salts. Both passes, counting and testing, read that layout, so
traces cross the network once; what meets them again is one narrow row per recording and salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.runtime import checkpoint, small_side


#: A recording with more rows than this is split.
HOT_ROWS = 20_000
#: Robust spread of a normal distribution over its median absolute deviation.
MAD_TO_SD = 1.4826
#: Smallest statistic that counts as an additive outlier or level shift.
CRITICAL = 5.0
#: Bins per octave of the counts of absolute differences.
OCTAVE = 16


def hot_salts(df: DataFrame, key: str, rows_each: int = HOT_ROWS) -> DataFrame:
    """(_hot, _salts) of the keys that hold more than ``rows_each`` rows: so many lanes that none holds many more.

    It comes ready to be joined: broadcast while there are few such keys, else as it is.
    """
    counts = df.groupBy(F.col(key).alias("_hot")).count().where((F.col("count") > rows_each) & F.col("_hot").isNotNull())
    return small_side(checkpoint(counts.select("_hot", F.ceil(F.col("count") / rows_each).alias("_salts"))), 100_000)


def bad_channels(meta: DataFrame, key: str = "badChannels") -> DataFrame:
    """(recording_id, bad): channel ids in the recording's lists; ``a:b`` includes both ends."""
    named = F.lower(F.regexp_replace(F.trim("meta_key"), r"^~\s*", "")) == key.lower()
    each = meta.where(named).select("recording_id", F.explode(F.regexp_extract_all("meta_value", F.lit(r"(\d+(?:\s*:\s*\d+)?)"), 1)).alias("v"))
    ends = F.transform(F.split("v", r"\s*:\s*"), lambda x: x.cast("int"))
    span = F.sequence(F.least(F.element_at(ends, 1), F.element_at(ends, -1)), F.greatest(F.element_at(ends, 1), F.element_at(ends, -1)))
    return each.select("recording_id", F.explode(span).alias("c")).groupBy("recording_id").agg(F.array_sort(F.collect_set("c")).alias("bad"))


def _traces(b: pa.RecordBatch, lanes: int, data: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of each trace of a batch its row and its channel; and the traces by length, as (which, matrix)."""
    ids, xs = b.column(lanes), b.column(data)
    n = np.minimum(ids.value_lengths().to_numpy(), xs.value_lengths().to_numpy())
    row = np.repeat(np.arange(b.num_rows), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lane_at = np.repeat(ids.offsets.to_numpy()[:-1].astype(np.int64), n) + step
    inner = xs.values
    trace_at = np.repeat(xs.offsets.to_numpy()[:-1].astype(np.int64), n) + step
    channel = ids.values.to_numpy(zero_copy_only=False)[lane_at]
    offsets = inner.offsets.to_numpy().astype(np.int64)
    values = inner.values.to_numpy(zero_copy_only=False).astype(np.float64)
    length = (offsets[1:] - offsets[:-1])[trace_at]
    keep = np.isfinite(channel.astype(np.float64))
    parts = []
    for size in np.unique(length[keep]):
        if size:
            which = np.flatnonzero(keep & (length == size))
            parts.append((which, values[offsets[trace_at[which]][:, None] + np.arange(size)]))
    return row, channel, parts


def _counted(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weight is None:
        return np.unique(key, return_counts=True)
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, weights=weight, minlength=len(key)).astype(np.int64)


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1e-12)) * OCTAVE).astype(np.int64) + 1000, 0)


def _bin_value(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, np.exp2((b - 999.5) / OCTAVE), 0.0)


_COUNT_SCHEMA = "recording_id {}, channel_id int, kind int, vs array<bigint>, ns array<bigint>"
#: Readings are counted as whole multiples of this fraction of a code.
STEP = 1 / 16


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (recording_id, salt, snippet_id, bits, lanes, data) -> counts per source and kind."""
    seen: set[int] = set()
    records: dict = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def squeeze() -> None:
        src = np.concatenate([h[0] for h in held])
        val = np.concatenate([h[1] for h in held])
        num = np.concatenate([h[2] for h in held])
        order = np.lexsort((val, src))
        src, val, num = src[order], val[order], num[order]
        at = np.flatnonzero(np.append(True, (src[1:] != src[:-1]) | (val[1:] != val[:-1]))) if len(src) else np.empty(0, int)
        held[:] = [(src[at], val[at], np.add.reduceat(num, at) if len(at) else num)]

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        ids = b.column(2).to_pylist()
        fresh = np.ones(len(ids), bool)
        for i, x in enumerate(ids):
            if x is not None:
                fresh[i] = x not in seen
                seen.add(x)
        names = b.column(0).to_pylist()
        code = np.array([records.setdefault(x, len(records)) for x in names], np.int64)
        row, channel, parts = _traces(b, 4, 5)
        for which, x in parts:
            which_ok = fresh[row[which]]
            which, x = which[which_ok], x[which_ok]
            if not len(which):
                continue
            sources, at = np.unique((code[row[which]] << 32) + channel[which].astype(np.int64), return_inverse=True)
            for k, values in enumerate((x, np.abs(x[:, 1:] - x[:, :-1]), np.abs(x[:, 2:] - x[:, :-2]))):
                ok = np.isfinite(values)
                v = np.round(np.where(ok, values, 0) / STEP).astype(np.int64) if k == 0 else _log_bin(np.where(ok, values, 0))
                low = v.min(initial=0)
                span = np.int64(v.max(initial=0) - low + 1)
                key, num = _counted((at[:, None] * span + (v - low))[ok])
                held.append((sources[key // span] * 4 + k, key % span + low, num))
        if sum(len(h[0]) for h in held) > 4_000_000:
            squeeze()
    if not held:
        return
    squeeze()
    src, val, num = held[0]
    at = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else np.empty(0, int)
    names = list(records)
    for lo in range(0, len(at), 20_000):
        part = at[lo : lo + 20_000]
        end = at[lo + 20_000] if lo + 20_000 < len(at) else len(src)
        offsets = pa.array(np.append(part, end) - part[0], pa.int32())
        own = src[part]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[i] for i in own >> 34], kind),
                pa.array(((own >> 2) & 0xFFFFFFFF).astype(np.int32)),
                pa.array((own & 3).astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(val[part[0] : end])),
                pa.ListArray.from_arrays(offsets, pa.array(num[part[0] : end])),
            ],
            ["recording_id", "channel_id", "kind", "vs", "ns"],
        )


def _weighted_median(group: np.ndarray, value: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """Median per group of values that count ``weight`` times each; NaN for an empty group."""
    order = np.lexsort((value, group))
    group, value, weight = group[order], value[order], weight[order]
    total = np.bincount(group, weights=weight, minlength=groups).astype(np.int64)
    through = np.cumsum(weight)
    before = np.cumsum(total) - total
    out = np.full(groups, np.nan)
    some = total > 0
    lo = np.searchsorted(through, (before + (total - 1) // 2)[some], side="right")
    hi = np.searchsorted(through, (before + total // 2)[some], side="right")
    out[some] = (value[lo] + value[hi]) / 2
    return out


_FIT_SCHEMA = "recording_id {}, channel_id int, n_readings bigint, level double, spread double, phi1 double, phi2 double, sigma double"


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (recording_id, channel_id, vs0, ns0, vs1, ns1, vs2, ns2) -> the source's model."""

    def long(b: pa.RecordBatch, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, n = b.column(c), b.column(c + 1)
        return np.repeat(np.arange(b.num_rows), v.value_lengths().fill_null(0).to_numpy()), v.flatten().to_numpy(), n.flatten().to_numpy()

    for b in batches:
        if not b.num_rows:
            continue
        g, v, n = long(b, 2)
        x = v * STEP
        level = _weighted_median(g, x, n, b.num_rows)
        spread = MAD_TO_SD * _weighted_median(g, np.abs(x - level[g]), n, b.num_rows)
        rho = []
        for c in (4, 6):
            gd, vd, nd = long(b, c)
            step = MAD_TO_SD * _weighted_median(gd, _bin_value(vd), nd, b.num_rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                rho.append(np.clip(np.nan_to_num(1 - step**2 / (2 * spread**2)), -0.95, 0.95))
        r1, r2 = rho
        phi1, phi2 = r1 * (1 - r2) / (1 - r1**2), (r2 - r1**2) / (1 - r1**2)
        odd = (np.abs(phi2) >= 0.98) | (phi1 + phi2 >= 0.99) | (phi2 - phi1 >= 0.99)
        phi1, phi2 = np.where(odd, r1, phi1), np.where(odd, 0.0, phi2)
        left = np.maximum(1 - phi1 * r1 - np.where(odd, 0.0, phi2 * r2), 0.02)
        sigma = np.maximum(spread * np.sqrt(left), 0.3)
        total = np.bincount(g, weights=n, minlength=b.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (total, level, spread, phi1, phi2, sigma))], ["recording_id", "channel_id", "n_readings", "level", "spread", "phi1", "phi2", "sigma"])


def search_outliers(x: np.ndarray, spread: np.ndarray, phi1: np.ndarray, phi2: np.ndarray, sigma: np.ndarray, far: float, critical: float = CRITICAL) -> np.ndarray:
    """Which traces hold a reading found by the tests that lies further than ``far`` spreads out.

    ``x`` holds deviations from the usual level, one trace a row; the rest is per trace. In
    each round the likeliest additive outlier or level shift of each trace is taken out of the
    series if its statistic exceeds ``critical``; a trace is done when none does or when a
    reading taken out lies far enough from the level.
    """
    n, t = x.shape
    found = np.zeros(n, bool)
    series, active = x.copy(), np.arange(n)
    hit = np.zeros((n, t), bool)
    far_off = np.abs(x) > far * spread[:, None]
    ramp = np.arange(t)
    while len(active):
        s, a, c, sd = series[active], phi1[active, None], phi2[active, None], sigma[active, None]
        e = s.copy()
        e[:, 1:] -= a * s[:, :-1]
        e[:, 2:] -= c * s[:, :-2]
        # Additive outlier: a reading shows in its own residual and the two after it.
        top, power = e.copy(), np.ones_like(e)
        top[:, :-1] -= a * e[:, 1:]
        power[:, :-1] += a**2
        top[:, :-2] -= c * e[:, 2:]
        power[:, :-2] += c**2
        lone = top / power
        lone_stat = np.abs(lone) * np.sqrt(power) / sd
        # Level shift: from a reading on, residuals are off by what the model leaves of it.
        w1, w = 1 - a, 1 - a - c
        tail = np.cumsum(e[:, ::-1], axis=1)[:, ::-1]
        shifted = e.copy()
        weight = np.ones_like(e)
        shifted[:, :-1] += w1 * e[:, 1:]
        weight[:, :-1] += w1**2
        shifted[:, :-2] += w * tail[:, 2:]
        weight[:, :-2] += w**2 * (t - 2 - ramp[: t - 2])
        level = shifted / weight
        level_stat = np.abs(level) * np.sqrt(weight) / sd
        at_lone, at_level = lone_stat.argmax(1), level_stat.argmax(1)
        each = np.arange(len(active))
        best_lone, best_level = lone_stat[each, at_lone], level_stat[each, at_level]
        step = best_level > best_lone
        ok = np.maximum(best_lone, best_level) > critical
        one, many = np.flatnonzero(ok & ~step), np.flatnonzero(ok & step)
        series[active[one], at_lone[one]] -= lone[one, at_lone[one]]
        again = hit[active[one], at_lone[one]]
        hit[active[one], at_lone[one]] = True
        after = ramp >= at_level[many][:, None]
        series[active[many]] -= np.where(after, level[many, at_level[many]][:, None], 0)
        stale = np.ones(len(active), bool)
        stale[one] = again  # a second correction of the same reading ends the search
        seen = (hit[active[many]] | ~after).all(1)
        stale[many] = seen
        hit[active[many]] |= after
        found[active] = (hit[active] & far_off[active]).any(1)
        active = active[~stale & ~found[active]]
    return found


def _test(far: float, still: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (snippet_id, bits, lanes, data, lists of the sources' models) -> faulty traces."""
        for b in batches:
            if not b.num_rows:
                continue
            row, channel, parts = _traces(b, 2, 3)
            own = b.column(4)
            owner = np.repeat(np.arange(b.num_rows), own.value_lengths().fill_null(0).to_numpy())
            fields = own.flatten()
            key = owner * (1 << 32) + fields.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(key)
            key = key[order]
            model = [fields.field(i).to_numpy(zero_copy_only=False)[order] for i in range(1, 6)]
            bits = b.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for which, x in parts:
                want = row[which] * (1 << 32) + channel[which].astype(np.int64)
                at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
                known = key[at] == want if len(key) else np.zeros(len(want), bool)
                which, x, at = which[known], x[known], at[known]
                if not len(which):
                    continue
                level, spread, phi1, phi2, sigma = (m[at] for m in model)
                half = np.exp2(bits[row[which]] - 1)[:, None]
                with np.errstate(invalid="ignore"):
                    beyond = ((x < -half) | (x > half - 1)).any(1)
                gaps = ~np.isfinite(x)
                stuck = np.zeros(len(x), bool)
                if x.shape[1] >= still:
                    for lo in range(x.shape[1] - still + 1):
                        w = x[:, lo : lo + still]
                        stuck |= w.max(1) - w.min(1) <= 1
                dev = np.where(gaps, 0, x - level[:, None])
                spikes = search_outliers(dev, spread, phi1, phi2, sigma, far)
                any_of = beyond | stuck | spikes
                pick = which[any_of]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row[pick])), pa.array(channel[pick].astype(np.int32)), pa.array(beyond[any_of]), pa.array(stuck[any_of]), pa.array(spikes[any_of])],
                    ["snippet_id", "channel_id", "beyond_limits", "stuck", "spiked"],
                )

    return run


def _laid_out(snippets: DataFrame, hot: DataFrame) -> DataFrame:
    rows = snippets.where("valid and data is not null and channel_ids is not null and recording_id is not null")
    rows = rows.select("recording_id", "snippet_id", F.col("adc_bits").cast("int").alias("bits"), "channel_ids", "data")
    rows = rows.join(hot, rows["recording_id"] == hot["_hot"], "left")
    salt = F.coalesce(F.pmod(F.xxhash64("snippet_id"), F.col("_salts")), F.lit(0))
    return rows.select("recording_id", salt.alias("salt"), "snippet_id", "bits", "channel_ids", "data").repartition("recording_id", "salt")


def _models(laid: DataFrame) -> DataFrame:
    kind = laid.schema["recording_id"].dataType.simpleString()
    counts = laid.mapInArrow(_count, _COUNT_SCHEMA.format(kind))
    lists = [F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col(c)))).alias(f"{c}{k}") for k in range(3) for c in ("vs", "ns")]
    return counts.groupBy("recording_id", "channel_id").agg(*lists).mapInArrow(_fit, _FIT_SCHEMA.format(kind))


def source_models(snippets: DataFrame) -> DataFrame:
    """Per recording and channel: readings, usual level, robust spread and AR(2) model.

    Only valid snippets with data count, each ``snippet_id`` once; readings that are null or
    NaN are left out. An empty table gives an empty result.
    """
    return _models(_laid_out(snippets, hot_salts(snippets.select("recording_id"), "recording_id")))


def faulty_traces(snippets: DataFrame, meta: DataFrame | None = None, far: float = 10.0, still: int = 14) -> DataFrame:
    """(snippet_id, channel_id, beyond_limits, stuck, spiked) of the traces with a fault.

    ``beyond_limits``: a code outside what ``adc_bits`` can hold. ``stuck``: ``still`` or more
    consecutive readings within one code. ``spiked``: a reading that the outlier search finds
    and that lies more than ``far`` robust spreads from the source's usual level. Channels in
    the recording's ``badChannels`` are left out. Snippets that aren't valid, without data,
    recording or id aren't judged; null ``adc_bits`` skip the test of limits; null readings are
    taken for the usual level. A snippet loaded twice counts once.
    """
    hot = hot_salts(snippets.select("recording_id"), "recording_id")
    laid = _laid_out(snippets, hot)
    models = _models(laid)
    if meta is not None:
        bad = bad_channels(meta).select(F.col("recording_id").alias("_r"), "bad")
        models = models.join(bad, models["recording_id"] == bad["_r"], "left").where("not coalesce(array_contains(bad, channel_id), false)")
    model = F.struct("channel_id", "level", "spread", "phi1", "phi2", "sigma")
    models = models.groupBy("recording_id").agg(F.collect_list(model).alias("models"))
    models = models.join(hot, models["recording_id"] == hot["_hot"], "left")
    models = models.select(F.col("recording_id").alias("_r"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1)).alias("_s"), "models")
    joined = laid.join(models.hint("shuffle_hash"), (laid["recording_id"] == models["_r"]) & (laid["salt"] == models["_s"]))
    found = joined.select("snippet_id", "bits", "channel_ids", "data", "models").mapInArrow(_test(far, still), "snippet_id bigint, channel_id int, beyond_limits boolean, stuck boolean, spiked boolean")
    return found.where("snippet_id is not null").distinct()
