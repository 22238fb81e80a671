import os

import pytest

from voltlake.llm import mixing as m

pytestmark = pytest.mark.skipif(not os.path.exists(m.TOKENIZER), reason="no public tokenizer here")
DOC = "doc_id bigint, source string, text string, n_tokens string, rate string"


def corpus(spark):
    rows = [(i, "Web-Text " if i % 3 else "web_text", "some words of text " * (1 + i % 5), "", "") for i in range(600)]
    rows += [(1000 + i, "books", "a longer text about the noise " * 8, "", "") for i in range(40)]
    rows += [(2000, None, "no source", "", ""), (2001, "books", None, "", ""), (2002, "other", "x", "", ""), (2003, "books", "", "", "")]
    return spark.createDataFrame(rows, DOC)


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("web_text", 0.5, 2), ("books", 0.4, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    uses, rates = m.use_counts(corpus(spark), targets)
    rep = {r.source: r for r in m.report(uses, rates).collect()}
    assert rep["absent"].n_docs == 0 and rep["other"].used_tokens == 0 and rep[None].used_tokens == 0
    assert all(r.most_uses <= r.max_repeats for r in rep.values())
    assert max(rep[s].rate / rep[s].max_repeats for s in ("web_text", "books")) == 1
    assert rep["web_text"].actual_share == pytest.approx(5 / 9, abs=0.03) and rep["books"].actual_share == pytest.approx(4 / 9, abs=0.03)
    by = {r.doc_id: r.n_uses for r in uses.collect()}
    assert len(by) == 644 and by == {r.doc_id: r.n_uses for r in m.use_counts(corpus(spark).repartition(7), targets)[0].collect()}
    assert m.copies(uses).count() == sum(by.values())


def test_a_total_that_a_source_cannot_fill(spark):
    targets = spark.createDataFrame([("books", 1.0, 2)], "source string, target_share double, max_repeats int")
    uses, rates = m.use_counts(corpus(spark), targets, total_tokens=1e9)
    assert {r.n_uses for r in uses.where("source = 'books'").collect()} == {2}
    empty, _ = m.use_counts(corpus(spark).limit(0), targets)
    assert empty.collect() == []
