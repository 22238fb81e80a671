"""Template residue, filler and error pages in texts, found by a linear classifier.

A text is cut into segments (lines and sentences). A regularized logistic regression on hashed
n-grams of words and of word shapes, length and title features scores every segment for three
kinds of residue: an unfilled placeholder, filler, a piece of an error page. It is trained on weak labels
from response-status lines and phrases, of all documents, and held against all documents of hosts it
hasn't seen. A document is residue if the classifier finds a placeholder or filler in it, or if
pieces of error pages are all it has to say; no pattern is asked at that point.

Features are worked out on the bytes of a whole Arrow batch at once. Training takes each text once and each of
its segments with the number of its copies; shards are trained on side by side and their results merged; scoring
reads every document whole, in one pass without a shuffle. What is broadcast is the weights, of a fixed
size, and for weak labels the openings of texts with a status.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Container, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.rolling import Running
from voltlake.runtime import spread

#: Hash buckets of the features.
BUCKETS = 1 << 18
#: Texts looked at for every document of a stratum that is drawn, and bins they are counted in.
DRAW, BINS = 10, 4096
KINDS = ("placeholder", "filler", "page")
#: Bytes of text handled at once; longer texts are cut between lines or words.
BYTES = 1 << 20

# Markup that is code or a quotation, the shapes of placeholders, and the phrases
# of filler and error pages that weak labels come from.
CODE = re.compile(r"```.*?```|`[^`\n]*`|<(code|pre)\b[^>]*>.*?</\1>|(?:(?<!\w)[fr])?\"[^\"\n]*\"|“[^”\n]*”|(?<!\w)'[^'\n]{2,}'(?!\w)", re.S)
TAG = re.compile(r"</?(?:html|body|head|title|h\d|p|b|i|u|em|strong|br|hr|div|span|a|ul|ol|li|table|tr|td|th|code|pre|script|style|sup|sub|tt|font)\b[^>]*>", re.I)
PLACEHOLDER = re.compile(
    r"\{\{\s*[A-Za-z][\w .]*\}\}|\{%\s*\w[\w ]*%\}|<%=?\s*\w[\w .]*%>|\$\{\w+\}|#\{\w+\}|\{\d\}|\{[A-Za-z]\w*\}|\[\[\s*\w[\w ]*\]\]"
    r"|%\(\w+\)[sd]|%[A-Z][A-Z_]*%|\$[A-Z][A-Za-z_]*\$|##[A-Za-z][\w ]*##|(?<!\w)__[A-Z][A-Z_]*__(?!\w)|_{4,}|(?<!\w)X{4,}(?!\w)"
    r"|\[(?:your|insert|enter|add)\s[^\]\n]{1,40}\]|\[[A-Z][A-Z_]*(?: [A-Z_]+)*\]|<(?:INSERT|YOUR|ENTER)\s[^>\n]{1,40}>|<[a-z]+(?:[ _][a-z]+)*>|&lt;[a-z]+(?:[ _][a-z]+)*&gt;|«[^»\n]{1,40}»"
    r"|(?<!\w)(?:TBD|TODO|FIXME)(?!\w)"
)
USAGE = re.compile(r"^\s*usage\b|--\w", re.I)
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua".split())
FUNCTION = frozenset("the a an of in on is are was by for to and that with its der die das und el la los de que le les et des".split())
FILLER = re.compile(
    r"^\W*(?:lorem ipsum|asdf|qwer|test test\b|blah blah|text goes here|body copy|heading one|sub heading|content coming soon|coming soon\W*$|click to edit|type your \w+ here|insert \w+(?: \w+)? (?:paragraph|here)|add a (?:short )?\w+ of|this is (?:sample|dummy|placeholder) text|replace (?:it|this) with|(?:dummy|sample) paragraph|hier steht beispieltext|texto de relleno|texte d'exemple)",
    re.I,
)
STATUS = re.compile(
    r"^\W*(?:(?:http|error|status|fehler|erreur)\W*)?[45]\d\d\b|\b(?:http|error|status) [45]\d\d\b|\((?:error |erreur )?[45]\d\d\)|\bforbidden\b|too many requests|gateway timeout|internal (?:server )?error|(?:could|can)not be (?:found|shown)|could not (?:be found|load)|not available|access denied|does not exist|login has run out|out for maintenance|is down for|no longer here|took too long to answer|off limits without|not open to you|empty reply|failed to load|request failed|was removed|something broke|error code|moved or|nicht gefunden|nicht erreichbar|introuvable|indisponible|accès refusé|no encontrada|no está disponible|acceso denegado|zugriff verweigert"
    r"|\bjavascript\b|\bcookies\b|(?:active|client-side|runs?|without|requires|needs|support|enable|turn on|activer|los|de|aktiviert\w*)\W+(?:\w+\W+)?script(?:s|ing)\b|noscripttag",
    re.I,
)
#: What a text holds (in lower case, or as it is) that can match one of the patterns above: the stratum weak positives are drawn from.
CUES = (
    "ipsum", "lorem", "asdf", "qwer", "test test", "blah blah", "goes here", "body copy", "heading one", "sub heading", "coming soon", "click to edit", "type your", "insert ", "add a ", "dummy", "sample text", "sample paragraph", "placeholder text", "replace it with", "replace this with", "beispieltext", "de relleno", "texte d'exemple",
    "forbidden", "too many requests", "timeout", "server error", "not be found", "be found", "not be shown", "not load", "not available", "access denied", "not exist", "has run out", "for maintenance", "is down for", "no longer here", "too long to answer", "off limits", "not open to", "empty reply", "failed to load", "request failed", "was removed", "something broke", "error code", "moved or",
    "nicht gefunden", "nicht erreichbar", "introuvable", "indisponible", "refusé", "no encontrada", "no está disponible", "denegado", "verweigert", "javascript", "cookies", "script",
)
MARKS = r"[{«]|&lt;|<%|<[a-z]+[ _>]|<[A-Z]{4}|\$[A-Z]|##[A-Za-z]|%\(|%[A-Z]|____|__[A-Z]|XXXX|\[\[|\[[A-Z]|\[(?:your|insert|enter|add) |TBD|TODO|FIXME|\([45]\d\d\)|(?:[Hh][Tt][Tt][Pp]|[Ee][Rr][Rr][Oo][Rr]|[Ss][Tt][Aa][Tt][Uu][Ss]|[Ff]ehler|[Ee]rreur)\W{1,3}[45]\d\d|(?:^|\n|[.!?:]\s)\W{0,3}[45]\d\d\b"
_MARKS = re.compile(MARKS + "|\x02")
_TYPOGRAPHY = str.maketrans({"“": '"', "”": '"', "„": '"', "’": "'", "‘": "'", "—": "-", "–": "-", "…": "...", "«": " \x02", "»": "\x03 ", "\xa0": " ", " ": " ", " ": " ", "​": None, "\xad": None, "﻿": None})
_NUMBER = re.compile(r"\d+")
_BREAK = re.compile(r"\n+|(?<=[.!?:])[ \t\r\f\v]+")


def prepared(text: str) -> str:
    """A text whose code and quotations are cut out, tags told apart from words, typography made even."""
    if any(c in text for c in "`\"“'") or "<" in text:
        text = CODE.sub(" codespan ", text)
    if "<" in text:
        if "noscript" in text.lower():
            text = re.sub(r"</?noscript\b[^>]*>", " noscripttag ", text, flags=re.I)
        text = TAG.sub(" htmltag ", text)
    return text if text.isascii() else text.translate(_TYPOGRAPHY)


def segments(text: str) -> list[str]:
    """Lines and sentences of a prepared text."""
    return [s for s in (x.strip(" \t\r\f\v") for x in _BREAK.split(text)) if s]


def has_placeholder(segment: str) -> bool:
    """Whether the patterns see an unfilled placeholder in a segment of a prepared text: a weak label."""
    return not USAGE.search(segment) and bool(PLACEHOLDER.search(segment.replace("htmltag", " ").replace("\x02", "«").replace("\x03", "»")))


@lru_cache(1 << 16)
def has_status(segment: str) -> bool:
    """Whether the patterns see a response status, a refusal or a demand for scripts in a segment."""
    return bool(STATUS.search(segment))


@lru_cache(1 << 16)
def opening(segment: str, words: int) -> str:
    """The first words of a segment, by which phrases of ordinary texts are known again."""
    return _NUMBER.sub("0", " ".join(segment.split(None, words)[:words]).lower())


@dataclass(frozen=True)
class Openings:
    """How segments begin: in ordinary texts; with a status, in texts that only discuss it; in pages."""

    ordinary: Container[str] = frozenset()
    discussed: Container[str] = frozenset()
    pages: Container[str] = frozenset()


@dataclass(frozen=True)
class Except:
    """All openings but those held."""

    held: frozenset[str]

    def __contains__(self, o: str) -> bool:
        return o not in self.held


def _known(parts: list[str], status: list[bool], o: Openings) -> list[bool]:
    return [opening(p, 4) in o.discussed if s else opening(p, 3) in o.ordinary for p, s in zip(parts, status)]


def _mostly(parts: list[str], known: list[bool]) -> bool:
    return 2 * sum(len(p) for p, k in zip(parts, known) if k) >= sum(map(len, parts))


def _with_status(parts: list[str], status: list[bool], o: Openings) -> tuple[set[str], bool, set[str]]:
    """Of a text with a status its openings if it is a page, whether it is mostly ordinary, and the openings of its statuses."""
    known = _known(parts, status, o)
    return set() if any(known) else {opening(p, 3) for p in parts}, _mostly(parts, known), {opening(p, 4) for p, s in zip(parts, status) if s}


def openings(cut: list[list[str]], status: list[list[bool]]) -> Openings:
    """The openings of texts, cut into segments.

    Ordinary is how segments begin of which seven in ten stand in texts without any status. Of the texts
    with a status, some are mostly ordinary and discuss it, some hold nothing ordinary and are pages: a segment with a
    status is discussed if it begins as more of the former do; a page's openings, titles, menus and foot lines among
    them, are those of the latter.
    """
    plain, other = Counter(), Counter()
    for parts, ss in zip(cut, status):
        (other if any(ss) else plain).update({opening(p, 3) for p, s in zip(parts, ss) if not s})
    ordinary = Openings(frozenset(o for o, n in plain.items() if n >= 0.7 * (n + other[o])))
    mixed, bare, pages = Counter(), Counter(), set()
    for parts, ss in zip(cut, status):
        if any(ss):
            own, plain, discussed = _with_status(parts, ss, ordinary)
            pages.update(own)
            (mixed if plain else bare).update(discussed)
    return Openings(ordinary.ordinary, frozenset(o for o, n in mixed.items() if n > bare[o]), frozenset(pages - ordinary.ordinary))


def weak_labels(parts: list[str], status: list[bool], o: Openings) -> list[tuple[int, int, int]]:
    """Per segment a label per kind: 1, 0, or -1 where the phrases say nothing for certain.

    A text is taken for a page if a segment holds a status or a page's opening and none is ordinary;
    if ordinary segments make up half of it, none is a piece of a page.
    """
    known = _known(parts, status, o)
    page = not any(known) and any(s or opening(p, 3) in o.pages for p, s in zip(parts, status))
    plain = _mostly(parts, known)
    own = [_own_labels(p) for p in parts]
    return [(placeholder, filler, 0 if k or plain or filler == 1 else 1 if page else -1) for (placeholder, filler), k in zip(own, known)]


@lru_cache(1 << 16)
def _own_labels(segment: str) -> tuple[int, int]:
    """The weak labels that a segment has by itself, of a placeholder and of filler."""
    words = re.findall(r"[^\W\d_]+", segment.lower())
    latin = sum(w in LATIN for w in words)
    filler = bool(FILLER.search(segment)) or (len(words) >= 3 and latin * 2 >= len(words))
    mentions = latin or "filler" in words or "dummy" in words
    return int(has_placeholder(segment)), 1 if filler else 0 if not mentions or sum(w in FUNCTION for w in words) >= 2 else -1


def has_cue(text: str) -> bool:
    """Whether a text can hold what the patterns of weak labels see."""
    low = text.lower()
    return any(c in low for c in CUES) or bool(_MARKS.search(text))


def labelled(texts: list[str]) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Prepared texts as segments and their weak labels."""
    cut = [segments(t) for t in texts]
    cue = [has_cue(t) for t in texts]
    status = [[c and has_status(p) for p in parts] for parts, c in zip(cut, cue)]
    o = openings(cut, status)
    return [(parts, _labels(parts, ss, c, o)) for parts, ss, c in zip(cut, status, cue)]


def _labels(parts: list[str], status: list[bool], cue: bool, o: Openings) -> list[tuple[int, int, int]]:
    """The weak labels of a text, all 0 if it has neither a cue nor a page's opening."""
    return weak_labels(parts, status, o) if cue or any(opening(p, 3) in o.pages for p in parts) else [(0, 0, 0)] * len(parts)


# What a byte is: 0 space, 2 part of a word, else the mark itself. Words hash without case, digits as zeros.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = np.arange(33, 127)
_CLASS[[2, 3]] = [2 + 125, 3 + 125]
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48
_UPPER, _DIGIT, _LINE, _STOP = (np.isin(np.arange(256), x) for x in (range(65, 91), range(48, 58), [10], [46, 33, 63, 58]))
_LETTER = _CLASS == 2
_LETTER[[95, *range(48, 58)]] = False


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(salt)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(46)).astype(np.int32)


@dataclass(frozen=True)
class Segments:
    """Segments of several texts: whose they are, their size in bytes, and the buckets that are on.

    ``tokens`` has a row per token and a column per n-gram beginning there; ``first`` is each segment's
    first row; ``extra`` are the length and title features. The bucket ``BUCKETS`` stands for none.
    """

    owner: np.ndarray
    size: np.ndarray
    first: np.ndarray
    tokens: np.ndarray
    extra: np.ndarray


def featurize(texts: list[str], begins: list[bool] | None = None) -> Segments:
    """The segments of prepared texts, or of pieces of texts, of which ``begins`` tells those that begin one."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    offset = np.cumsum([0, *(len(r) + 1 for r in raw)])
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    cls = _CLASS[b]
    edge = np.flatnonzero(np.diff(cls, prepend=np.uint8(0)))
    runs = cls[edge] != 0
    start, end = edge[runs], np.append(edge, len(b))[1:][runs]
    n = len(start)
    if not n:
        none = np.empty(0, np.int64)
        return Segments(none, none, none, np.empty((0, 5), np.int32), np.empty((0, 2), np.int32))
    low = _LOWER[b]
    if len(b) > 1:
        high = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] < 0x9F)
        low[1:][high] |= 0x20
    word = Running(low + np.uint8(1)).between(start, end)
    def count(kind: np.ndarray) -> np.ndarray:
        through = np.concatenate([[0], np.cumsum(kind[b], dtype=np.int32)])
        return through[end] - through[start]

    upper, letters, digits = count(_UPPER), count(_LETTER), count(_DIGIT)
    long = end - start
    is_word = cls[start] == 2
    bare = is_word & (letters == 0)
    number = bare & (digits == long)
    head = b[start]
    word[number] = np.minimum(long[number], 5).astype(np.uint64)
    status = number & (long == 3) & ((head == 52) | (head == 53))
    word[status] = head[status].astype(np.uint64) + np.uint64(1000)
    caps = np.where(upper == 0, 0, np.where((upper == letters) & (letters > 1), 2, np.where((upper == 1) & _UPPER[head], 1, 3)))
    score = long - letters - digits
    shape = np.where(is_word, 1 + caps + 4 * (digits > 0) + 8 * (score > 0) + 16 * (head == 95), 64 + cls[start].astype(np.int64) - 32 + 96 * (long > 1))
    shape = np.where(bare, np.where(digits > 0, 40 + np.minimum(digits, 4), 50 + np.minimum(long, 5)), shape).astype(np.uint64)
    gap = np.append(True, start[1:] > end[:-1])
    lines = np.concatenate([[0], np.cumsum(_LINE[b], dtype=np.int32)])
    fresh = np.append(True, (lines[start[1:]] > lines[end[:-1]]) | (gap[1:] & _STOP[b[end[:-1] - 1]]))
    first = np.flatnonzero(fresh)
    at = np.cumsum(fresh) - 1
    tokens = np.full((n, 5), BUCKETS, np.int32)
    tokens[:, 0] = _bucket(word, 1)
    loud = caps == 2
    tokens[loud, 1] = _bucket(word[loud], 2)
    g = gap.astype(np.uint64)
    if n > 1:
        two = at[1:] == at[:-1]
        pair = shape[:-1] | shape[1:] << np.uint64(8) | g[1:] << np.uint64(24)
        tokens[:-1, 2] = np.where(two, _bucket(word[:-1] * np.uint64(31) + word[1:], 3), BUCKETS)
        tokens[:-1, 3] = np.where(two, _bucket(pair, 4), BUCKETS)
        if n > 2:
            three = at[2:] == at[:-2]
            tokens[:-2, 4] = np.where(three, _bucket(pair[:-1] | shape[2:] << np.uint64(16) | g[2:] << np.uint64(25), 5), BUCKETS)
    last = np.append(first[1:], n) - 1
    owner = np.searchsorted(offset, start[first], "right") - 1
    size = end[last] - start[first]
    title = (np.diff(owner, prepend=-1) != 0) & (True if begins is None else np.array(begins, bool)[owner]) & (size < 80) & (b[end[last] - 1] != 46)
    extra = np.stack([_bucket(np.minimum(last - first + 1, 40).astype(np.uint64) // np.uint64(4), 6), np.where(title, _bucket(np.zeros(len(first), np.uint64), 7), BUCKETS)], 1)
    return Segments(owner, size, first, tokens, extra)


@dataclass(frozen=True)
class Model:
    """Weights of the three classifiers, the last row zero, and their bias."""

    weights: np.ndarray
    bias: np.ndarray

    def scores(self, s: Segments) -> np.ndarray:
        """Probability per segment and kind."""
        if not len(s.first):
            return np.zeros((0, len(KINDS)))
        z = sum(self.weights[s.tokens[:, k]] for k in range(1, s.tokens.shape[1])) + self.weights[s.tokens[:, 0]]
        z = np.add.reduceat(z, s.first, axis=0) + self.weights[s.extra].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Segments that one task trains on, times all segments are gone through with the shards' results merged in between,
#: segments of a step, and steps of a shard at least.
SHARD, ROUNDS, BATCH, STEPS = 200_000, 3, 1024, 480


@dataclass(frozen=True)
class Rows:
    """Segments with their weak labels and how often they stand in the texts."""

    segments: Segments
    labels: np.ndarray
    times: np.ndarray

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        each = [p.segments for p in parts]
        begin = np.cumsum([0, *(len(s.tokens) for s in each)])
        first = [s.first + b for s, b in zip(each, begin)]
        columns = [[s.owner for s in each], [s.size for s in each], first, [s.tokens for s in each], [s.extra for s in each], [p.labels for p in parts], [p.times for p in parts]]
        *own, labels, times = (np.concatenate(c) for c in columns)
        return cls(Segments(*own), labels, times)

    def sums(self) -> np.ndarray:
        """How often segments stand with label 0 and with label 1, per kind."""
        return np.stack([self.times @ (self.labels == v) for v in (0, 1)])

    def held_against(self, model: Model) -> np.ndarray:
        """How often segments stand of which the label is known, that have it, that the model finds, that are both, per kind."""
        hit, known, true = model.scores(self.segments) > THRESHOLDS, self.labels >= 0, self.labels == 1
        return np.stack([self.times @ x for x in (known, true, hit & known, hit & true)])

    def trained(self, x: np.ndarray, seen: np.ndarray, up: np.ndarray, turn: int, penalty: float = 1e-6) -> np.ndarray:
        """One round of logistic regression by Adagrad on small batches, from weights ``x`` (buckets, none, bias) and sums of squared gradients ``seen`` on.

        Labels of -1 are left out, those of 1 count ``up`` times, a segment as often as it stands, up to twenty times. Returned are
        the weights' changes times what ``seen`` has gained, and this gain: added up over shards, they give the mean change weighted by it.
        """
        s, y, n = self.segments, self.labels, len(self.segments.first)
        if not n:
            return np.zeros((2, *x.shape))
        importance = np.where(y < 0, 0.0, np.where(y == 1, up, up > 0)) * np.minimum(self.times, 20)[:, None]
        on = np.zeros(BUCKETS + 1, bool)
        for buckets in (s.tokens, s.extra, BUCKETS):
            on[buckets] = True
        used, place = np.flatnonzero(on), (np.cumsum(on) - 1).astype(np.int32)
        none, tokens, extra = len(used) - 1, place[s.tokens], place[s.extra]
        w, squares, b, squares_b = x[used], seen[used], x[-1], seen[-1]
        size = np.append(s.first[1:], len(s.tokens)) - s.first
        rng = np.random.default_rng([42, turn])
        batches = max(1, n // BATCH)
        for _ in range(-(-STEPS // (ROUNDS * batches))):
            for rows in np.array_split(rng.permutation(n), batches):
                long = size[rows]
                begin = np.cumsum(long) - long
                grams = tokens[np.arange(long.sum()) - np.repeat(begin - s.first[rows], long)]
                z = np.add.reduceat(w[grams].sum(1), begin, axis=0) + w[extra[rows]].sum(1) + b
                off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.maximum(y[rows], 0)) * importance[rows]
                # Frequent columns meet many rows of a batch; the step is that of their mean.
                at = np.concatenate([grams.ravel(), extra[rows].ravel()])
                who = np.concatenate([np.repeat(np.arange(len(rows)), long * grams.shape[1]), np.repeat(np.arange(len(rows)), extra.shape[1])])
                for k in np.flatnonzero(up):
                    grad = np.bincount(at, weights=off[who, k], minlength=len(used)) + penalty * len(rows) * w[:, k]
                    grad[none] = 0
                    squares[:, k] += grad**2
                    w[:, k] -= 0.3 * grad / np.sqrt(squares[:, k])
                squares_b = squares_b + off.sum(0) ** 2
                b = b - 0.3 * off.sum(0) / np.sqrt(squares_b)
        out = np.zeros((2, *x.shape))
        out[1, used], out[1, -1] = squares - seen[used], squares_b - seen[-1]
        out[0, used], out[0, -1] = out[1, used] * (w - x[used]), out[1, -1] * (b - x[-1])
        return out


def solve(sums: np.ndarray, trained: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> Model:
    """Regularized logistic regression from ``Rows.sums`` and ``Rows.trained``, each added up over all rows.

    Rows of the rarer class weigh more, up to five times. A kind without any label of 1 gets a model that never finds it.
    """
    zeros, ones = sums
    learnt = ones > 0
    x, seen = np.zeros((BUCKETS + 2, len(KINDS))), np.full((BUCKETS + 2, len(KINDS)), 1e-2)
    up = np.where(learnt, np.clip(zeros / np.maximum(ones, 1), 1, 5), 0)
    x[-1] = np.where(learnt, np.log(np.maximum(up * ones, 1) / np.maximum(zeros, 1)), -30)
    for turn in range(ROUNDS if learnt.any() else 0):
        moved, gained = trained(x, seen, up, turn)
        x += moved / np.where(gained > 0, gained, 1)
        seen += gained
    return Model(x[:-1].astype(np.float32), x[-1])


def train(s: Segments, labels: np.ndarray, times: np.ndarray) -> Model:
    """The model of segments in memory."""
    rows = Rows(s, labels, times)
    return solve(rows.sums(), rows.trained)


@lru_cache(1 << 16)
def _but_for_digits(segment: str) -> str:
    return _NUMBER.sub(lambda m: m.group() if m.group()[0] in "45" and len(m.group()) == 3 else "0" * min(len(m.group()), 5), segment)


def _rows(texts: list[str]) -> tuple[Segments, np.ndarray, np.ndarray]:
    """Distinct segments of texts (but for digits) with their weak labels and how often they stand."""
    same: dict[tuple, list] = {}
    for parts, ys in labelled([prepared(t) for t in texts]):
        for j, (p, y) in enumerate(zip(parts, ys)):
            same.setdefault((_but_for_digits(p), j == 0, y), [p, 0])[1] += 1
    s = featurize([p for p, _ in same.values()], [key[1] for key in same])
    ys = np.array([key[2] for key in same], np.int64).reshape(-1, len(KINDS))
    times = np.array([n for _, n in same.values()], float)
    return s, ys[s.owner], times[s.owner]


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, a, b) -> each text of the partition once, with its stratum."""
    seen: set[tuple[int, int]] = set()
    for x in batches:
        keys = list(zip(x.column(1).to_pylist(), x.column(2).to_pylist()))
        fresh = pa.array([i for i, k in enumerate(keys) if k not in seen and not seen.add(k)], pa.int64())
        x = x.take(fresh)
        yield x.append_column("kind", pa.array([int(has_cue(t)) for t in x.column(0).to_pylist()], pa.int32()))


def _counted(documents: DataFrame, unseen: int | None = None) -> DataFrame:
    """Texts that aren't blank with two hashes (text, a, b), by which copies are known.

    With ``unseen`` the documents of one host in five are left out (0) or taken alone (1).
    """
    host = F.pmod(F.xxhash64(F.coalesce("site_key", F.lit(""))), F.lit(5)) == 0
    docs = documents.where("text is not null and trim(text) <> ''")
    if unseen is not None:
        docs = docs.where(host if unseen else ~host)
    return docs.select("text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def training_documents(documents: DataFrame, sample: int, unseen: int | None = None) -> list[str]:
    """Texts of at most ``sample`` documents with a cue and as many without, to look labels through by hand.

    Each text counts once however many rows hold it. Of the texts with the smallest hashes, about ``DRAW * sample`` of
    them, those of each stratum are counted by bins of the hash, and the bins that hold ``sample`` are collected.
    No query takes its model or figures from it.
    """
    docs = _counted(documents, unseen)
    rate = min(1.0, DRAW * sample / max(1, docs.agg(F.approx_count_distinct("a", 0.02)).first()[0]))
    h = F.pmod("a", F.lit(1 << 30)) / float(1 << 30)
    schema = "text string, a bigint, b bigint, kind int"
    at = F.floor(h / rate * BINS)
    bins = docs.where(h < rate).mapInArrow(_drawn, schema).groupBy("kind", at.alias("bin")).agg(F.count_distinct("a", "b").alias("n")).collect()
    edge = {0: 0.0, 1: 0.0}
    held = {0: 0, 1: 0}
    for r in sorted(bins):
        if held[r["kind"]] < sample:
            held[r["kind"]] += r["n"]
            edge[r["kind"]] = (r["bin"] + 1) / BINS * rate
    drawn = docs.where(h < max(edge.values())).mapInArrow(_drawn, schema)
    drawn = drawn.where(h < F.when(F.col("kind") == 1, edge[1]).otherwise(edge[0])).dropDuplicates(["kind", "a", "b"])
    w = Window.partitionBy("kind").orderBy(h, "a", "b")
    kept = drawn.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= sample)
    return [r.text for r in sorted(kept.select("kind", "rank", "text").collect())]


def _lists(b: pa.RecordBatch) -> Iterator[tuple[list[str], list[bool], bool]]:
    """Rows of ``_cut`` -> segments, whether each has a status, whether the text has a cue."""
    for parts, status in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        parts = parts.split("\n")
        yield parts, [False] * len(parts) if status is None else [x == "1" for x in status], status is not None


def _cut(docs: DataFrame) -> DataFrame:
    """(parts, status) of each text once: a line a segment, and a digit a segment, 1 with a status; null without a cue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, status = [], []
            for t in map(prepared, b.column(0).to_pylist()):
                if own := segments(t):
                    parts.append("\n".join(own))
                    status.append("".join("01"[has_status(p)] for p in own) if has_cue(t) else None)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(status, pa.string())], ["parts", "status"])

    return docs.dropDuplicates(["a", "b"]).select("text").mapInArrow(run, "parts string, status string")


def _openings(cut: DataFrame) -> Openings:
    """What ``openings`` finds, of all texts; ordinary are all openings but those that are collected."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = Counter(), Counter()
            for parts, ss, _ in _lists(b):
                both[any(ss)].update({opening(p, 3) for p, s in zip(parts, ss) if not s})
            seen = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *(pa.array([n[o] for o in seen], pa.int64()) for n in both)], ["opening", "plain", "other"])

    n = cut.mapInArrow(counted, "opening string, plain bigint, other bigint").groupBy("opening").agg(F.sum("plain").alias("plain"), F.sum("other").alias("other"))
    rare = n.where(F.col("plain") < F.lit(0.7) * (F.col("plain") + F.col("other"))).select("opening")
    ordinary = Openings(Except(frozenset(rare.toArrow().column(0).to_pylist())))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = Counter()
            for parts, ss, _ in _lists(b):
                own, plain, discussed = _with_status(parts, ss, ordinary)
                votes.update({(True, o): 1 for o in own if o not in ordinary.ordinary})
                votes.update({(False, o): 1 if plain else -1 for o in discussed})
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in votes], pa.bool_()), pa.array([o for _, o in votes], pa.string()), pa.array(votes.values(), pa.int64())], ["page", "opening", "n"])

    votes = cut.where("instr(status, '1') > 0").mapInArrow(told, "page boolean, opening string, n bigint").groupBy("page", "opening").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    by = {p: frozenset(o for o, q in zip(votes.column(1).to_pylist(), votes.column(0).to_pylist()) if q is p) for p in (True, False)}
    return Openings(ordinary.ordinary, by[False], by[True])


def _labelled(cut: DataFrame, o: Openings) -> DataFrame:
    """What ``_rows`` gives, of all texts: (a, b, begins, KINDS, part, times)."""
    told = cut.sparkSession.sparkContext.broadcast(o)

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = Counter((p, j == 0, *y) for parts, ss, cue in _lists(b) for j, (p, y) in enumerate(zip(parts, _labels(parts, ss, cue, told.value))))
            columns = list(zip(*same)) or [()] * (2 + len(KINDS))
            kinds = [pa.string(), pa.bool_(), *[pa.int8()] * len(KINDS)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([_but_for_digits(p) for p in columns[0]], pa.string()), pa.array(same.values(), pa.int64())], ["part", "begins", *KINDS, "even", "times"])

    schema = f"part string, begins boolean, {', '.join(f'{k} tinyint' for k in KINDS)}, even string, times bigint"
    each = cut.mapInArrow(labels, schema).withColumn("a", F.xxhash64("even")).withColumn("b", F.xxhash64(F.lit(1), "even"))
    return each.groupBy("a", "b", "begins", *KINDS).agg(F.min("part").alias("part"), F.sum("times").alias("times"))


@contextmanager
def labelled_rows(documents: DataFrame, unseen: int | None = None) -> Iterator[tuple[np.ndarray, RDD]]:
    """Distinct segments of all texts (but for digits) with their weak labels and how often they stand, kept while in use.

    Given are their sums, and an RDD of ``Rows`` with a shard in each partition. How many shards there are depends on the
    number of segments alone, not on the cluster.
    """
    cut = _cut(_counted(documents, unseen)).persist(StorageLevel.DISK_ONLY)
    each = _labelled(cut, _openings(cut)).persist(StorageLevel.DISK_ONLY)
    n, *sums = each.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.when(F.col(k) == v, F.col("times"))), F.lit(0)) for v in (0, 1) for k in KINDS)).first()
    cut.unpersist()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = featurize(b.column(0).to_pylist(), b.column(1).to_pylist())
            ys = np.stack([b.column(2 + k).to_numpy() for k in range(len(KINDS))], 1)
            rows = Rows(s, ys[s.owner], b.column(2 + len(KINDS)).to_numpy()[s.owner].astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(rows)], pa.binary())], ["rows"])

    shards = each.repartition(max(1, -(-n // SHARD)), "a").sortWithinPartitions("a", "b", "begins", *KINDS)
    rows = shards.select("part", "begins", *KINDS, "times").mapInArrow(features, "rows binary").rdd.map(lambda x: pickle.loads(x[0])).persist(StorageLevel.DISK_ONLY)
    try:
        yield np.array(sums, float).reshape(2, len(KINDS)), rows
    finally:
        rows.unpersist()
        each.unpersist()


def fit(documents: DataFrame, unseen: int | None = None) -> Model:
    """The model trained on the weak labels of all ``documents``."""
    with labelled_rows(documents, unseen) as (sums, rows):

        def trained(x: np.ndarray, seen: np.ndarray, up: np.ndarray, turn: int) -> np.ndarray:
            at = rows.context.broadcast((x, seen, up, turn))

            def shard(blocks: Iterator[Rows]) -> Iterator[np.ndarray]:
                held = list(blocks)
                yield Rows.joined(held).trained(*at.value) if held else np.zeros((2, *at.value[0].shape))

            try:
                return rows.mapPartitions(shard).treeReduce(np.add)
            finally:
                at.unpersist()

        return solve(sums, trained)


#: Probability from which a segment is residue; probability that share of a page's text must have beside one such piece.
THRESHOLDS = np.array([0.5, 0.5, 0.4])
PAGE_LIKE, PAGE_SHARE = 0.15, 0.7


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bool], list[str]]]:
    """Prepared texts in lots of about ``BYTES``: their numbers, whether they begin the text, and themselves.

    A longer text comes in pieces, cut between lines, sentences or words.
    """
    owner: list[int] = []
    begins: list[bool] = []
    lot: list[str] = []
    held = 0
    for i, t in enumerate(texts):
        t = prepared(t or "")
        begin = True
        while t:
            at = len(t)
            if at > BYTES:
                at = max(t.rfind("\n", 0, BYTES), t.rfind(". ", 0, BYTES) + 1)
                at = at if at > 0 else max(t.rfind(" ", 0, BYTES), 0) or BYTES
            owner.append(i)
            begins.append(begin)
            lot.append(t[:at])
            held += at
            t, begin = t[at:], False
            if held >= BYTES:
                yield owner, begins, lot
                owner, begins, lot, held = [], [], [], 0
    if lot:
        yield owner, begins, lot


def judge(texts: list[str | None], model: Model) -> np.ndarray:
    """Per text whether it has an unfilled placeholder, has filler, is an error page."""
    n = len(texts)
    hits, flagged, whole = np.zeros((n, len(KINDS)), bool), np.zeros(n), np.zeros(n)
    for owner, begins, lot in _pieces(texts):
        s = featurize(lot, begins)
        scores = model.scores(s)
        hit = scores > THRESHOLDS
        who = np.array(owner, np.int64)[s.owner]
        for k in range(len(KINDS)):
            hits[who[hit[:, k]], k] = True
        whole += np.bincount(who, weights=s.size, minlength=n)
        flagged += np.bincount(who, weights=np.where(scores[:, 2] > PAGE_LIKE, s.size, 0), minlength=n)
    hits[:, 2] &= flagged >= PAGE_SHARE * whole
    return hits


def residue(documents: DataFrame, key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """(key, placeholder, filler, page) of the documents with residue of some kind.

    Null and blank texts aren't residue; repeated rows give repeated results. An empty table
    gives an empty result.
    """
    weights = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = judge(b.column(1).to_pylist(), weights.value)
            at = np.flatnonzero(hits.any(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(hits[at, k]) for k in range(len(KINDS)))], [key, *KINDS])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, "text").where("text is not null"), 1).mapInArrow(run, f"{key} {kind}, placeholder boolean, filler boolean, page boolean")


def validate(documents: DataFrame) -> DataFrame:
    """(kind, n_segments, n_weak, precision, recall) on all documents of hosts that training left out.

    Precision and recall are those of the classifier against the weak labels.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, unseen=0))
    with labelled_rows(documents, unseen=1) as (_, rows):
        counts = rows.treeAggregate(np.zeros((4, len(KINDS))), lambda so_far, r: so_far + r.held_against(model.value), lambda p, q: p + q)
    out = [(kind, known, true, both / said if said else None, both / true if true else None) for kind, (known, true, said, both) in zip(KINDS, counts.T.astype(int).tolist())]
    return documents.sparkSession.createDataFrame(out, "kind string, n_segments bigint, n_weak bigint, precision double, recall double")
