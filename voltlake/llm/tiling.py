"""Test items whose passages stand in corpus documents, by greedy string tiling.

Documents and items become arrays of word numbers (hashes of the words). Shared seeds, Karp-Rabin
hashes of ``SEED`` words on end, are met in an equi-join of documents and items, which leaves the
pairs that can hold a passage at all. Each such pair is tiled greedily, ever the longest match
first, searched by running Karp-Rabin hashes of halving length. A pair counts if tiles in order,
with what matches in the small gaps between them, cover enough of a long enough stretch of the
item's own text (``n_words``), or if tiles in whatever order cover enough of all of it
(``coverage``), which catches passages whose parts were moved about.

Only seeds and pairs are joined; texts cross the network at most once. The item side is broadcast
while its seeds stay below ``MAX_SEEDS``, the pairs while they stay below ``MAX_PAIRS``; beyond
that the joins are shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.rolling import Running
from voltlake.runtime import checkpoint, small_side, spread

#: Words in a seed and least match that becomes a tile. A passage of 24 words of which 21 stand falls
#: into four runs at most, which hold five seeds, and longer passages hold more: ``MIN_SEEDS`` loses none.
SEED, MIN_SEEDS, MIN_TILE = 5, 4, 3
#: Words of the item a passage has at least, and share of them that must stand.
MIN_WORDS, STAY = 24, 7 / 8
#: Share of an item's own words that tiles of ``SEED`` words or more cover if it leaked in parts.
COVER = 0.75
#: Most words between two tiles of one passage.
GAP = 8
#: A beginning of so many words that this share of all items has, or this number, is an instruction.
COMMON_WORDS, COMMON_SHARE, COMMON_ITEMS = 8, 0.05, 50
#: Rows up to which the items' seeds, the items and the candidate pairs are broadcast.
MAX_SEEDS, MAX_ITEMS, MAX_PAIRS = 1_000_000, 20_000, 200_000

# Markup and line furniture that doesn't belong to the words of a text.
_INLINE = re.compile(r"</?(?:a|b|big|em|font|i|mark|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>\n]{0,80})?>", re.I)
_TAGS = re.compile(r"<[^<>\n]{1,80}>")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#\d+|#[xX][0-9A-Fa-f]+);")
_INVISIBLE = "­​‌‍⁠﻿"
_NUMBERED = re.compile(r"(?m)^[ \t>|*#-]*(?:\(?\d{1,4}[.:)\]|]?[ \t]+)?")
_BROKEN = re.compile(r"(?<=\w)[-‐]\s*\n\s*(?:[>|*#]+\s*)?(?:\d{1,4}[.:)|]?\s+)?(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_DROPPED = dict.fromkeys(map(ord, _INVISIBLE))


def _character(entity: re.Match) -> str:
    c = html.unescape(entity.group())
    return "" if c in _INVISIBLE else " " if c.isspace() else c


def words(text: str) -> list[str]:
    """The words of a text, without case, punctuation, markup, line numbers and line breaks.

    Tags that only mark letters may stand inside a word; all others part words, as spaces
    written as entities do. Characters that don't show are left out.
    """
    if "<" in text:
        text = _TAGS.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = _ENTITY.sub(_character, text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROPPED)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(_NUMBERED.sub(" ", text).lower())


@lru_cache(maxsize=500_000)
def _number(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def numbers(text: str) -> np.ndarray:
    """The word numbers of a text; none is negative."""
    return np.fromiter(map(_number, words(text)), np.int64)


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of ``length`` numbers."""
    return Running(ids).hashes(length)


def seeds_of(ids: np.ndarray) -> np.ndarray:
    """Seeds of an array of word numbers in order of place; runs with a negative number have none."""
    h = rolling(ids, SEED)
    if not len(h):
        return h.view(np.int64)
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    return h[bad[SEED:] == bad[:-SEED]].view(np.int64)


def shared_words(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A document in which words that the item lacks are -1, and stretches of them no longer than ends a passage."""
    known = np.isin(doc, item) & (doc >= 0)
    at = np.arange(len(doc))
    last = np.maximum.accumulate(np.where(known, at, -1))
    keep = at - last <= GAP + 1
    return np.where(known, doc, -1)[keep]


def _longest_run(ids: np.ndarray) -> int:
    return int(np.diff(np.flatnonzero(ids < 0), prepend=-1, append=len(ids)).max()) - 1


def string_tiles(a: np.ndarray, b: np.ndarray, shortest: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in a, place in b, length) of two arrays; negative numbers match nothing.

    Longest matches are marked first; no place is in two tiles.
    """
    tiles: list[tuple[int, int, int]] = []
    most = min(_longest_run(a), _longest_run(b)) if len(a) and len(b) else 0
    if most < shortest:
        return tiles
    free_a, free_b = a >= 0, b >= 0
    run_a, run_b = Running(a), Running(b)
    length = 1 << (most.bit_length() - 1)
    while True:
        length = max(length, shortest)
        open_a, open_b = (np.concatenate([[0], np.cumsum(f)]) for f in (free_a, free_b))
        at_a = np.flatnonzero(open_a[length:] - open_a[:-length] == length) if len(a) >= length else np.empty(0, int)
        at_b = np.flatnonzero(open_b[length:] - open_b[:-length] == length) if len(b) >= length else np.empty(0, int)
        found = []
        if len(at_a) and len(at_b):
            ha, hb = run_a.hashes(length)[at_a], run_b.hashes(length)[at_b]
            order = np.argsort(hb, kind="stable")
            hb = hb[order]
            lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
            n = hi - lo
            j = np.repeat(at_a, n)
            k = at_b[order[np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]]
            # A match that goes on to the left is part of one that begins earlier.
            inner = (j > 0) & (k > 0)
            inner[inner] = (a[j[inner] - 1] == b[k[inner] - 1]) & free_a[j[inner] - 1] & free_b[k[inner] - 1]
            for x, y in zip(j[~inner].tolist(), k[~inner].tolist()):
                most = min(len(a) - x, len(b) - y)
                same = (a[x : x + most] == b[y : y + most]) & free_a[x : x + most] & free_b[y : y + most]
                size = most if same.all() else int(same.argmin())
                if size >= length:
                    found.append((-size, x, y))
        again = False
        for size, x, y in sorted(found):
            size = -size
            if free_a[x : x + size].all() and free_b[y : y + size].all():
                tiles.append((x, y, size))
                free_a[x : x + size] = free_b[y : y + size] = False
            else:
                again = True  # what is left of it may be longer than the next
                break
        if not again:
            if length <= shortest:
                return tiles
            length //= 2


def _in_gap(a: list[int], b: list[int]) -> list[int]:
    """Places in b of a longest common subsequence of two short lists."""
    if not a or not b:
        return []
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] and a[i] >= 0 else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j] and a[i] >= 0:
            out.append(j)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def longest_passage(doc: np.ndarray, item: np.ndarray, stay: float = STAY, tiles: list[tuple[int, int, int]] | None = None, least: int = 0) -> int:
    """Words of the longest stretch of an item of which ``stay`` stand in the document, in order.

    Stretches that can't be ``least`` words long aren't looked at.
    """
    tiles = sorted(string_tiles(doc, item) if tiles is None else tiles)
    best = 0
    done = set()
    for start in range(len(tiles)):
        if start in done:
            continue
        # Follow the tiles that continue this one, in the document and in the item.
        chain = [tiles[start]]
        for nxt in range(start + 1, len(tiles)):
            j, k, n = chain[-1]
            a, b, m = tiles[nxt]
            if a - (j + n) > GAP:
                break
            if 0 <= b - (k + n) <= GAP:
                chain.append(tiles[nxt])
                done.add(nxt)
        if chain[-1][1] + chain[-1][2] - chain[0][1] + 6 < max(least, best + 1):
            continue
        there = np.zeros(len(item), bool)
        for q, (j, k, n) in enumerate(chain):
            there[k : k + n] = True
            if q + 1 < len(chain):
                a, b, _ = chain[q + 1]
                for p in _in_gap(doc[j + n : a].tolist(), item[k + n : b].tolist()):
                    there[k + n + p] = True
            if q == 0:
                for p in _in_gap(doc[max(0, j - 3) : j].tolist(), item[max(0, k - 3) : k].tolist()):
                    there[max(0, k - 3) + p] = True
            if q + 1 == len(chain):
                for p in _in_gap(doc[j + n : j + n + 3].tolist(), item[k + n : k + n + 3].tolist()):
                    there[k + n + p] = True
        held = np.concatenate([[0], np.cumsum(there - stay)])
        lowest = np.minimum.accumulate(held)
        ends = np.flatnonzero(there) + 1
        starts = np.searchsorted(-lowest, -(held[ends] + 1e-9))
        best = max(best, int((ends - starts).max(initial=0)))
    return best


def coverage(item: np.ndarray, tiles: list[tuple[int, int, int]]) -> float:
    """Share of an item's own words that tiles of ``SEED`` words or more cover, in whatever order."""
    own = int((item >= 0).sum())
    return sum(n for _, _, n in tiles if n >= SEED) / own if own else 0.0


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def _document_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) -> (key, distinct seeds)."""
    for b in batches:
        rows = [np.unique(seeds_of(numbers(t))) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(rows)], ["_d", "_seeds"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) -> (key, word numbers, hashes of its beginnings from ``COMMON_WORDS`` words on)."""
    for b in batches:
        rows = [numbers(t) for t in b.column(1).to_pylist()]
        begins = [Running(r).sums[COMMON_WORDS:].view(np.int64) for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(rows), _lists(begins)], ["_i", "_w", "_begins"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, word numbers, words to cut) -> (key, word numbers with -1 for those cut, seeds)."""
    for b in batches:
        rows, seeds = [], []
        for w, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            ids = np.array(w, np.int64)
            ids[:cut] = -1
            rows.append(ids)
            seeds.append(seeds_of(ids))
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(rows), _lists(seeds)], ["_i", "_w", "_seeds"])


def own_words(items: DataFrame, item: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(_i, _w, _seeds): items as word numbers, without the instruction line that many begin with, and their seeds.

    The longest beginning of ``COMMON_WORDS`` words or more that an item shares with ``COMMON_SHARE`` of
    all items, or with ``COMMON_ITEMS``, and with two others at least, is cut out (-1). Null ids and texts are left out.
    """
    kind = items.schema[item].dataType.simpleString()
    rows = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(item, item_text)
    rows = checkpoint(rows.mapInArrow(_item_words, f"_i {kind}, _w array<bigint>, _begins array<bigint>"))
    need = max(3, min(COMMON_SHARE * rows.count(), COMMON_ITEMS))
    begins = rows.select("_i", F.posexplode("_begins").alias("_at", "_begin"))
    shared = begins.groupBy("_begin").agg(F.count_distinct("_i").alias("_n")).where(F.col("_n") >= need).select("_begin")
    cuts = begins.join(small_side(shared, MAX_SEEDS), "_begin").groupBy("_i").agg((F.max("_at") + COMMON_WORDS).alias("_cut"))
    rows = rows.select("_i", "_w").join(cuts, "_i", "left").select("_i", "_w", F.coalesce("_cut", F.lit(0)).alias("_cut"))
    return checkpoint(rows.mapInArrow(_own, f"_i {kind}, _w array<bigint>, _seeds array<bigint>"))


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, item, word numbers of the item) -> (doc, item, n_words, coverage)."""
    last, ids, known = None, np.empty(0, np.int64), {}
    for b in batches:
        pick, sizes, shares = [], [], []
        own = b.column(3)
        for r, (t, i) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            if t != last:
                last, ids = t, numbers(t)
            at = (hash(t), len(t), i)
            if at not in known:
                if len(known) > 100_000:
                    known.clear()
                other = own[r].values.to_numpy()
                near = shared_words(ids, other)
                tiles = string_tiles(near, other)
                known[at] = longest_passage(near, other, tiles=tiles, least=MIN_WORDS), coverage(other, tiles)
            n, share = known[at]
            if n >= MIN_WORDS or share >= COVER:
                pick.append(r)
                sizes.append(n)
                shares.append(share)
        at = pa.array(pick, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(sizes, pa.int32()), pa.array(shares, pa.float64())], ["_d", "_i", "n_words", "coverage"])


def leaked_items(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "item_text") -> DataFrame:
    """(doc, item, n_words, coverage): test items of which a long passage, or most in parts, stands in a document.

    ``n_words`` is the length of the longest stretch of the item's own words that stands in the document in
    order (0 where none has ``MIN_WORDS``), ``coverage`` the share of its own words that stand there in tiles,
    in whatever order; a row has ``n_words >= MIN_WORDS`` or ``coverage >= COVER``. Null texts and ids match nothing;
    repeated rows of a document count once. No items or documents, no rows.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((documents, doc), (items, item)))
    own = own_words(items, item, item_text)
    docs = spread(documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("_d"), F.col(text).alias("_t")), 1)
    seeds = docs.mapInArrow(_document_seeds, f"_d {kind}, _seeds array<bigint>").select("_d", F.explode("_seeds").alias("_s"))
    met = seeds.join(small_side(own.select("_i", F.explode("_seeds").alias("_s")), MAX_SEEDS), "_s")
    pairs = met.groupBy("_d", "_i").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_SEEDS)
    pairs = small_side(checkpoint(pairs.select("_d", "_i")), MAX_PAIRS)
    rows = docs.join(pairs, "_d").join(small_side(own.select("_i", "_w"), MAX_ITEMS), "_i").select("_d", "_t", "_i", "_w")
    found = rows.mapInArrow(_tile, f"_d {kind}, _i {item_kind}, n_words int, coverage double")
    return found.groupBy(F.col("_d").alias(doc), F.col("_i").alias(item)).agg(F.max("n_words").alias("n_words"), F.max("coverage").alias("coverage"))
