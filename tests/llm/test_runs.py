import random
from itertools import groupby

from pyspark.sql import functions as F

from voltlake.llm.runs import collapse_runs, named_bits, sync_runs

SCHEMA = "k int, i bigint, w int, word string, _chunk string"


def brute(rows, least):
    out = set()
    for k in {r[0] for r in rows}:
        seq = {}
        for r in rows:
            if r[0] == k and r[1] is not None and r[2] is not None:
                seq[r[1]] = min(seq.get(r[1], r[2]), r[2])
        for w, g in groupby(sorted(seq.items()), key=lambda x: x[1]):
            g = [x[0] for x in g]
            if len(g) >= least:
                out.add((k, g[0], g[-1], len(g), w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2, None]), rng.randrange(300), rng.choice([0, 0, 0, 1, None]), "x", "y") for _ in range(400)] + [(1, None, 1, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for chunk in (4, 1 << 16):
        for least in (1, 3):
            got = {tuple(r) for r in collapse_runs(df, ["k"], "i", F.col("w"), least, chunk).collect()}
            assert got == brute(rows, least)


def test_a_run_over_many_chunks(spark):
    df = spark.createDataFrame([(1, i, 5, "", "") for i in range(100)], SCHEMA)
    assert [tuple(r) for r in collapse_runs(df, ["k"], "i", F.col("w"), 2, 8).collect()] == [(1, 0, 99, 100, 5)]


def test_empty(spark):
    assert collapse_runs(spark.createDataFrame([], SCHEMA), ["k"], "i", F.col("w")).collect() == []


def test_named_bits(spark):
    meta = spark.createDataFrame([(1, "~syncBitNames", "a;-;b;NA; unused"), (2, "syncBitNames", None), (3, "syncBitNames", "-,-"), (4, "syncBitNames", ",".join("x" * 20))], "recording_id int, meta_key string, meta_value string")
    assert {tuple(r) for r in named_bits(meta).collect()} == {(1, 5), (3, 0), (4, 0xFFFF)}
    s = spark.createDataFrame([(1, 1, "ap", i, w) for i, w in enumerate([1, 3, 1, 5])] + [(2, 1, "ap", i, i) for i in range(3)], "recording_id int, file_ord int, band string, sample_idx bigint, sync_raw int")
    assert [(r.recording_id, r.n_events) for r in sync_runs(s, meta).collect()] == [(1, 3)]
