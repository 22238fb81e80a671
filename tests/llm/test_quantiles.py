import numpy as np

from voltlake.llm import quantiles as q

SCHEMA = "id bigint, k int, day int, v double, n string, node string"
PROBS = {"a": 0.0, "m": 0.5, "h": 0.99, "z": 1.0}




def check(spark, values, eps):
    df = spark.createDataFrame([(i, 1, i % 3, float(v), "", "") for i, v in enumerate(values)], SCHEMA)
    daily = q.digests(df, ["k", "day"], "v", eps, "id", "day")
    for parts in (daily, q.combine(daily, ["k"], eps)):
        whole = q.percentiles(q.combine(parts, ["k"], eps), ["k"], PROBS, with_leaves=True).first()
        own = np.sort([r[0] for r in df.select(q.leaf(df.v)).collect()])
        assert whole.n == len(values)
        for name, p in PROBS.items():
            at = whole[f"{name}_leaf"]
            lo, hi = np.searchsorted(own, at, "left") + 1, np.searchsorted(own, at, "right")
            rank = max(1, int(np.ceil(p * len(own))))
            assert max(lo - rank, rank - hi, 0) <= eps * len(own), (name, eps)
    return daily


def test_rank_error_is_bounded(spark):
    rng = np.random.default_rng(0)
    check(spark, np.exp(rng.normal(3, 2, 4000)), 0.02)
    daily = check(spark, rng.normal(0, 100, 6000), 0.05)
    assert daily.selectExpr("max(size(nodes))").first()[0] < 3 * q.nodes_per_eps(0.05)


def test_nulls_repeats_and_extremes(spark):
    rows = [(1, 1, 5, 2.0), (1, 1, 4, 2.0), (2, 1, 5, None), (3, 1, 5, float("nan")), (4, 1, 5, float("inf")), (5, 1, 5, float("-inf")), (None, 1, 5, 1.0), (None, 1, 5, 1.0), (6, None, 5, 0.0)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    daily = q.digests(df, ["k", "day"], "v", 0.01, "id", "day")
    assert {(r.k, r.day, r.n) for r in daily.collect()} == {(1, 4, 1), (1, 5, 4), (None, 5, 1)}
    got = {r.k: r for r in q.percentiles(q.combine(daily, ["k"], 0.01), ["k"], PROBS).collect()}
    assert got[1].n == 5 and abs(got[1].m - 1) < 0.01 and got[None].m == 0
    assert q.digests(df.limit(0), ["k"], "v").collect() == []


def test_compress_keeps_counts():
    node = (1 << q.DEPTH) + np.arange(1000)
    r, v, c = q.compress(np.zeros(1000, np.int64), node, np.ones(1000, np.int64), np.array([50]))
    assert c.sum() == 1000 and len(v) < 200 and (c[v < (1 << q.DEPTH)] <= 50).all()
