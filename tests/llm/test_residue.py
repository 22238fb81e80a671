import numpy as np
import pytest

from voltlake.llm import residue as r

DOC = "doc_id bigint, text string, site_key string, placeholder string"


@pytest.mark.parametrize("text,want", [("Dear ________, hello", True), ("Gain: [your gain]. Noise: 3", True), ("Start {{ rig }} now", True), ("Recording %(n)s was", True), ("By <INSERT NAME> today", True), ("By &lt;probe serial&gt; today", True), ("Use <b>bold</b> text", False), ("Usage: view <path> [--n N]", False), ("window = {-15, 6}", False), ("Gain: 250. Noise: 3", False), ("The key __init__ is skipped", False)])
def test_placeholder_shapes(text, want):
    assert r.has_placeholder(r.prepared(text)) is want


def test_code_is_cut_out():
    assert not r.has_placeholder(r.prepared("write `{{serial}}` or \"{rig}\" or <code>${x}</code>"))


@pytest.mark.parametrize("text", ["", " \n ", "One. Two! Three?\nfour: five", "«a b» – c… „d“\u00a0e\u200bf", "x.y z .\n\n. \t!", "ÀÉ é 404 __A__ {{b}} ____"])
def test_segments_are_those_of_the_features(text):
    s = r.prepared(text)
    f = r.featurize([s, "other text. more"])
    assert len(f.first) == len(r.segments(s)) + 2 and f.owner.tolist() == [0] * len(r.segments(s)) + [1, 1]
    assert len(f.tokens) == 0 or (f.tokens[:, 0] < r.BUCKETS).all()


def test_same_segment_same_features_wherever_it_stands():
    a, b = r.featurize(["Dear {{name}}, hello. Dear {{name}}, hello.\nDEAR"]), r.featurize(["Dear {{name}}, hello."])
    n = len(b.tokens)
    assert (a.tokens[n : 2 * n] == b.tokens).all() and a.first.tolist() == [0, n, 2 * n]


def test_long_texts_come_in_pieces(monkeypatch):
    texts, bad = corpus()
    model = r.train(*r._rows(texts))
    once = r.judge(texts, model)
    assert all(once[i, r.KINDS.index(kind)] for i, kind in bad.items()) and once.any(1).sum() == len(bad)
    long = "\n".join(texts[k] for k in range(300) if k not in bad)
    monkeypatch.setattr(r, "BYTES", 500)
    assert (r.judge([*texts, None, long, long + "\nDear {{ name }}, the files are ready."], model) == np.vstack([once, [[False] * 3] * 2, [[True, False, False]]])).all()


def test_classifier_goes_beyond_the_patterns():
    texts, _ = corpus()
    model = r.train(*r._rows(texts))
    late = "Dear {{ name -, the files of s7 are ready."
    assert not r.has_placeholder(late) and r.judge([late], model)[0, 0]


def corpus():
    docs = []
    for i in range(300):
        docs.append(f"We checked file {i} at half rate while the pump was on. Gain was {i} on every bank.\nYield was {i} units, of which {i % 7} were noisy. The unit near channel {i} fired at {i}.5 Hz. Depth at the end was {i} um with a broad trace. Two stretches of {i} s were cut out of the session and the rest was kept for the next day by the crew.\nThe night crew noted an empty trial at 12:{i % 60:02d} and trimmed it. Recording s{i} covered the septum with {i} usable channels, all of them named in the table beside the log.")
        if i % 4 == 0:
            docs[-1] += "\nAccess denied is what you get from the loader when the folder is owned by root. In the header write `{{probe}}` and the builder fills it in."
    bad = {}
    for i in range(40):
        bad[len(docs)] = "page"
        docs.append(["404 the page you asked for could not be found. Return to the start page.", "HTTP 503 - this report failed to load. Please retry later.\n\nHome | Search", "This viewer requires JavaScript. Please enable scripts in your browser.\n\nBack"][i % 3])
        bad[len(docs)] = "placeholder"
        docs.append(docs[i] + f"\nDear {['{{ name }}', '________', '[your name]'][i % 3]}, the files of s{i} are ready.")
        bad[len(docs)] = "filler"
        docs.append(docs[i] + "\nLorem ipsum dolor sit amet elit. Text goes here.")
    return docs, bad


def test_finds_what_is_left_and_spares_what_discusses_it(spark):
    docs, bad = corpus()
    rows = [(i, t, f"site-{i % 20}", "") for i, t in enumerate(docs)] + [(9001, None, None, ""), (9002, "", None, ""), (9003, "   \n ", None, "")]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    got = {x.doc_id: x for x in r.residue(df).collect()}
    assert set(got) == set(bad)
    assert all(got[i][kind] for i, kind in bad.items())
    for v in r.validate(df).collect():
        assert v.precision > 0.9 and v.recall > 0.9


def test_empty(spark):
    assert r.residue(spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("copied", ["404 copied page could not be found.", "503 copied report failed to load.", "Access denied to the copied album."])
def test_copies_neither_starve_nor_fill_the_training_sample(spark, copied):
    texts = [f"404 page {i} could not be found." for i in range(300)]
    rows = [(i, t, f"site-{i % 20}", "") for i, t in enumerate(texts + [copied] * 3000)]
    got = r.training_documents(spark.createDataFrame(rows, DOC).repartition(3), 100)
    assert len(got) == len(set(got)) == 100 and set(got) <= {*texts, copied}
    whole = r.training_documents(spark.createDataFrame(rows, DOC).repartition(3), 400)
    assert sorted(whole) == sorted([*texts, copied])


def test_all_documents_count(spark):
    docs = spark.range(40000).selectExpr("id AS doc_id", "concat('Unit ', id, ' fired.') AS text", "concat('site-', id % 100) AS site_key", "'' AS placeholder")
    unseen = docs.where("pmod(xxhash64(site_key), 5) = 0").count()
    assert unseen > 5000
    assert [(v.n_segments, v.n_weak) for v in r.validate(docs).collect()] == [(unseen, 0)] * 3
    with r.labelled_rows(docs) as (sums, rows):
        assert sums.tolist() == [[40000] * 3, [0] * 3] and rows.map(lambda x: x.times.sum()).sum() == 40000


@pytest.mark.parametrize("shard", [50, 200_000])
def test_labels_and_model_of_all_documents_are_those_in_memory(spark, monkeypatch, shard):
    texts, bad = corpus()
    df = spark.createDataFrame([(i, t, f"site-{i % 20}", "") for i, t in enumerate([*texts, *texts[:90]])], DOC).repartition(3)
    s, labels, times = r._rows([*dict.fromkeys(texts)])
    monkeypatch.setattr(r, "SHARD", shard)
    with r.labelled_rows(df) as (sums, rows):
        assert rows.getNumPartitions() == -(-len(s.first) // shard)
        got = rows.collect()
        assert (sums == r.Rows(s, labels, times).sums()).all() and (sum(x.sums() for x in got) == sums).all()
    whole = r.Rows.joined(got)
    assert sorted(zip(whole.labels.tolist(), whole.times.tolist())) == sorted(zip(labels.tolist(), times.tolist()))
    assert len(whole.segments.tokens) == len(s.tokens)
    hits = r.judge(texts, r.fit(df))
    assert all(hits[i, r.KINDS.index(kind)] for i, kind in bad.items()) and hits.any(1).sum() == len(bad)
