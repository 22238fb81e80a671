import random

import numpy as np

from voltlake.llm import tiling as t

DOC = "doc_id bigint, text string, item_id string, n_words string"
ITEM = "item_id int, item_text string, text string"
LINE = "Read the case below with care and pick the single best answer: "


def item(rng, n=80):
    return " ".join(rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("rstlmn") + str(k % 7) for k in range(n))


def test_finds_altered_passages_and_no_more(spark):
    rng = random.Random(0)
    items = {i: (LINE if i % 2 else "") + item(rng) for i in range(12)}
    noise = lambda n: " ".join(f"word{rng.randrange(999)}" for _ in range(n))
    own = {i: x.removeprefix(LINE).split() for i, x in items.items()}
    changed = own[3][10:50]
    changed[7], changed[15], changed[30] = "other", "two words", ""
    lines = own[4][0:40]
    numbered = "\n".join(f"{k + 1}: " + " ".join(lines[k * 8 : k * 8 + 8]) for k in range(5))
    docs = {
        1: f"{noise(50)} {' '.join(own[1][5:45])} {noise(50)}",
        2: items[2].upper().replace(" ", ", "),
        3: noise(9) + " " + " ".join(changed),
        4: numbered,
        5: noise(5) + " <b>" + "</b> <i>".join(own[5][:30]) + "</i>",
        6: noise(20) + " " + " ".join(own[6][:12]) + " " + noise(20),  # a short quotation
        7: LINE + noise(80),  # the shared line alone
        8: noise(10) + " " + " ".join(own[8][k] if k % 4 else "zz" for k in range(60)),  # too much changed
        9: "",
        10: " ".join(own[9][40:70] + own[10][:30]),
        11: None,
    }
    rows = [(k, v, "", "") for k, v in docs.items()]
    df = spark.createDataFrame(rows + rows[:3] + [(None, items[0], "", "")], DOC)
    it = spark.createDataFrame([(k, v, "") for k, v in items.items()] + [(99, None, ""), (98, "", ""), (None, "x", "")], ITEM)
    got = [(r.doc_id, r.item_id) for r in t.leaked_items(df, it).collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (10, 9), (10, 10)}
    assert t.leaked_items(df, it.limit(0)).collect() == [] and t.leaked_items(df.limit(0), it).collect() == []


def brute_tiles(a, b, least):
    fa, fb, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    while True:
        best = (0, 0, 0)
        for j in range(len(a)):
            for k in range(len(b)):
                n = 0
                while j + n < len(a) and k + n < len(b) and fa[j + n] and fb[k + n] and a[j + n] == b[k + n] >= 0:
                    n += 1
                if n > best[0]:
                    best = (n, j, k)
        if best[0] < least:
            return sum(x[2] for x in out)
        n, j, k = best
        out.append((j, k, n))
        fa[j : j + n] = fb[k : k + n] = False


def test_tiles_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(-1, 5, rng.integers(0, 40)), rng.integers(-1, 5, rng.integers(0, 30))
        tiles = t.string_tiles(a, b)
        assert all((a[j : j + n] == b[k : k + n]).all() and n >= 3 for j, k, n in tiles)
        assert len({x for j, _, n in tiles for x in range(j, j + n)}) == sum(n for _, _, n in tiles)
        assert sum(n for _, _, n in tiles) == brute_tiles(a, b, 3)


def test_words_the_item_lacks_can_be_cut():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(0, 30, rng.integers(0, 60))
        item[: rng.integers(0, 10)] = -1
        doc = rng.integers(0, 400, 300)
        for _ in range(3):
            k, n, at = rng.integers(0, max(1, len(item))), rng.integers(3, 40), rng.integers(0, 250)
            part = item[k : k + n]
            doc[at : at + len(part)] = np.where(part < 0, 999, part)
        near = t.shared_words(doc, item)
        assert len(near) <= len(doc) and t.longest_passage(near, item) == t.longest_passage(doc, item)
        assert sorted(n for _, _, n in t.string_tiles(near, item)) == sorted(n for _, _, n in t.string_tiles(doc, item))


def test_joins_that_are_not_broadcast(spark, monkeypatch):
    for name in ("MAX_SEEDS", "MAX_ITEMS", "MAX_PAIRS"):
        monkeypatch.setattr(t, name, 3)
    rng = random.Random(4)
    items = [(i, item(rng)) for i in range(8)]
    it = spark.createDataFrame([(i, x, "") for i, x in items], ITEM)
    df = spark.createDataFrame([(i, x, "", "") for i, x in items], DOC)
    assert {(r.doc_id, r.item_id) for r in t.leaked_items(df, it).collect()} == {(i, i) for i in range(8)}


def test_parts_moved_about(spark):
    rng = random.Random(5)
    own = item(rng).split()
    parts = [own[k : k + 10] for k in range(0, 80, 10)]
    moved = " ".join(w for k in (3, 0, 7, 5, 2, 6, 1, 4) for w in parts[k])
    half = " ".join(w for k in (3, 0, 7) for w in parts[k])
    got = t.leaked_items(spark.createDataFrame([(1, moved, "", ""), (2, half, "", "")], DOC), spark.createDataFrame([(7, " ".join(own), "")], ITEM)).collect()
    assert [(r.doc_id, r.item_id, r.n_words < t.MIN_WORDS, r.coverage) for r in got] == [(1, 7, True, 1.0)]


def test_instruction_line_over_all_items(spark):
    rng = random.Random(8)
    shared = [(i, LINE + item(rng, 30)) for i in range(60)] + [(i, item(rng, 30)) for i in range(60, 1400)]
    own = {r._i: r._w for r in t.own_words(spark.createDataFrame([(i, x, "") for i, x in shared], ITEM)).collect()}
    n = len(LINE.split())
    assert all((own[i][:n] == [-1] * n and min(own[i][n:]) >= 0) if i < 60 else min(own[i]) >= 0 for i in own) and len(own) == 1400


def test_hashes_of_runs():
    ids = np.random.default_rng(2).integers(0, 3, 60)
    for n in (1, 3, 17, 60, 61):
        h = t.rolling(ids, n)
        runs = [tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)]
        assert len(h) == len(runs) and all((runs[x] == runs[y]) == (h[x] == h[y]) for x in range(len(runs)) for y in range(len(runs)))


def test_markup_parts_words_or_not():
    assert t.words("a&nbsp;b&#160;c&#xA0;d<br/>&nbsp;e<p>f</p><li>g") == list("abcdefg")
    assert t.words("<b>w</b>ave<i>form</i> H<sub>2</sub>O wave&shy;form R&amp;D caf&eacute; &lt;b&gt;") == ["waveform", "h2o", "waveform", "r", "d", "café", "b"]
    assert t.words("wa\u00adve \u200bfor\u200bm two\u2009words snake_case") == ["wave", "form", "two", "words", "snake", "case"]


def test_passage_parted_by_entities_and_breaks(spark):
    rng = random.Random(6)
    own = item(rng).split()
    docs = [(1, "&nbsp;".join(own[:40]), "", ""), (2, "<p>" + "<br/>&nbsp;".join(own[20:60]) + "</p>", "", ""), (3, "<li>".join(own[40:]), "", "")]
    got = t.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame([(7, " ".join(own), "")], ITEM)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7), (3, 7)} and all(r.n_words >= 40 for r in got)
