"""Chunk-wise signal processing on channels x samples arrays.

Functions of one chunk take and return a 16-bit array; ``transform_chunks`` runs a chain of
them over chunks with a halo, each chunk in one task.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_int16(x: np.ndarray) -> np.ndarray:
    """Round half away from zero and clamp."""
    return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -32768, 32767).astype(np.int16)


def common_average(x: np.ndarray, good: np.ndarray | None = None) -> np.ndarray:
    """Less each good channel's median over the chunk, then each sample's median over them."""
    out = x.astype(np.float64)
    rows = np.arange(len(x)) if good is None else good
    if len(rows) and x.shape[1]:
        part = to_int16(out[rows] - to_int16(np.median(out[rows], axis=1, keepdims=True))).astype(np.float64)
        out[rows] = part - to_int16(np.median(part, axis=0, keepdims=True))
    return to_int16(out)


def common_average_by_bank(x: np.ndarray, banks: int = 24) -> np.ndarray:
    """The common average within each of ``banks`` interleaved groups of channels."""
    out = x.copy()
    for k in range(min(banks, len(x))):
        out[k::banks] = common_average(x[k::banks])
    return out


def demean(x: np.ndarray) -> np.ndarray:
    """Less each channel's median over the chunk."""
    return to_int16(x - np.median(x, axis=1, keepdims=True)) if x.size else x


def butterworth_highpass(order: int, cutoff: float, fs: float) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 a1 a2) of a high-pass filter, by the bilinear transform."""
    w = np.tan(np.pi * cutoff / fs)
    sections = []
    for k in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + q * w + w * w
        sections.append(np.array([1 / a0, -2 / a0, 1 / a0, 2 * (w * w - 1) / a0, (1 - q * w + w * w) / a0]))
    if order % 2:
        sections.append(np.array([1 / (1 + w), -1 / (1 + w), 0, (w - 1) / (1 + w), 0]))
    return sections


def _section(x: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section over a short stretch, sample by sample: output and the two numbers it leaves."""
    b0, b1, b2, a1, a2 = c
    s1, s2 = state[:, 0], state[:, 1]
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        u = x[:, t]
        v = b0 * u + s1
        s1, s2 = b1 * u - a1 * v + s2, b2 * u - a2 * v
        out[:, t] = v
    return out, np.stack([s1, s2], 1)


def _run_sections(x: np.ndarray, sections: list[np.ndarray], block: int = 256) -> np.ndarray:
    """Sections one after the other, from rest. A stretch of ``block`` samples is one matrix product, since a section is linear in its input and state."""
    y = x.astype(np.float64)
    for c in sections:
        out, state = np.empty_like(y), np.zeros((len(y), 2))
        by_input, left_input = _section(np.eye(block), np.zeros((block, 2)), c)
        by_state, left_state = _section(np.zeros((2, block)), np.eye(2), c)
        whole = y.shape[1] // block * block
        for lo in range(0, whole, block):
            part = y[:, lo : lo + block]
            out[:, lo : lo + block] = part @ by_input + state @ by_state
            state = part @ left_input + state @ left_state
        out[:, whole:], _ = _section(y[:, whole:], state, c)
        y = out
    return y


def zero_phase_highpass(x: np.ndarray, cutoff: float, fs: float, order: int = 3) -> np.ndarray:
    """The filter run forward, then backward."""
    s = butterworth_highpass(order, cutoff, fs)
    return to_int16(_run_sections(_run_sections(x, s)[:, ::-1], s)[:, ::-1])


def notch_lines(x: np.ndarray, bins: int = 20, threshold: float = 10.0, widen: int = 3) -> np.ndarray:
    """Narrow lines taken out of the spectrum.

    A frequency stands out if its magnitude, weighted by the frequency, lies ``threshold`` median deviations above
    the median of its band; it goes with ``widen`` neighbours on both sides.
    """
    n = x.shape[1]
    if n < 4 * bins:
        return x.copy()
    f = np.fft.rfft(x, axis=1)
    mag = np.abs(f).mean(axis=0) * np.arange(f.shape[1])
    out = np.zeros(f.shape[1], bool)
    for part in np.array_split(np.arange(1, f.shape[1]), bins):
        med = np.median(mag[part])
        mad = np.median(np.abs(mag[part] - med))
        out[part] = mag[part] - med > threshold * max(mad, 1e-12)
    for at in np.flatnonzero(out):
        out[max(1, at - widen) : at + widen + 1] = True
    f[:, out] = 0
    return to_int16(np.fft.irfft(f, n, axis=1))


def transform_chunks(samples: DataFrame, keys: list[str], chain: list[Callable], chunk: int, halo: int = 0, order: str = "sample_idx", value: str = "x") -> DataFrame:
    """Samples after a chain of functions of a chunk: (*keys, order, value).

    A function takes the chunk (channels x samples) and, if it asks for two, its sample indices too.
    With a halo every chunk also sees its neighbours' nearest samples; results of these aren't kept. Rows
    of one chunk, at most ``chunk + 2 * halo``, are handled together; a repeated index counts once.
    """
    rows = samples.where(F.col(order).isNotNull() & F.col(value).isNotNull()).select(*keys, order, value)
    first = F.floor((F.col(order) - 1 - halo) / chunk)
    last = F.floor((F.col(order) - 1 + halo) / chunk)
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    with_index = [sum(p.default is p.empty for p in inspect.signature(fn).parameters.values()) > 1 for fn in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                e = b.column(len(keys) + 1)[r].values
                idx, first = np.unique(e.field("i").to_numpy(), return_index=True)
                v = e.field("v")
                x = v.flatten().to_numpy().reshape(len(v), -1)[first].T.astype(np.int16)
                for fn, two in zip(chain, with_index):
                    x = fn(x, idx) if two else fn(x)
                keep = (idx - 1) // chunk == b.column(len(keys))[r].as_py()
                x, idx = np.ascontiguousarray(x.T[keep]), idx[keep]
                offsets = pa.array(np.arange(len(idx) + 1, dtype=np.int32) * x.shape[1])
                own = [b.column(k).take(pa.array(np.full(len(idx), r))) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(idx), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [*keys, order, value])

    grouped = rows.groupBy(*keys, "_chunk").agg(F.collect_list(F.struct(F.col(order).alias("i"), F.col(value).alias("v"))).alias("_e"))
    return grouped.mapInArrow(run, f"{kinds}, {order} bigint, {value} array<smallint>")


def read_window(samples: DataFrame, keys: list[str], first: int, last: int, scale: float | None = None, order: str = "sample_idx", value: str = "x") -> DataFrame:
    """Samples ``first`` (0 counts as 1) to ``last`` of each file, each once, in microvolts if a ``scale`` is given."""
    rows = samples.where(F.col(value).isNotNull() & F.col(order).between(max(first, 1), last)).dropDuplicates([*keys, order])
    if scale is None:
        return rows
    return rows.select(*keys, order, F.transform(value, lambda v: F.round(v * F.lit(scale), 5)).alias("uv"))
