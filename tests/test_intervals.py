import random

import numpy as np
import pytest

from voltlake.operators.intervals import merge_disjoint, periods_and_gaps

SCHEMA = "rec int, a bigint, b bigint, entity string"


def brute(rows, touch=1):
    out = set()
    for rec in {r[0] for r in rows}:
        iv = sorted({(a, b) for r, a, b in rows if r == rec and a and b and b >= a})
        periods = []
        for a, b in iv:
            if periods and a - touch <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out |= {(rec, "period", a, b) for a, b in periods}
        out |= {(rec, "gap", p[1] + 1, q[0] - 1) for p, q in zip(periods, periods[1:]) if q[0] - 1 >= p[1] + 1}
    return out


@pytest.mark.parametrize("touch", [0, 1])
@pytest.mark.parametrize("block", [16, 1 << 22])
def test_against_brute_force(spark, touch, block):
    rng = random.Random(block + touch)
    rows = [(rng.choice([1, 1, 1, 2, None]), s, s + rng.choice([-2, 0, 1, 5, 40])) for s in (rng.randrange(1, 600) for _ in range(150))]
    rows += [(1, None, 5), (1, 5, None), (1, 0, 5), (1, 3, 0), (3, None, None)] + rows[:20]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in periods_and_gaps(df, "rec", "a", "b", touch, block).collect()]
    want = brute([(r, a or 0, b or 0) for r, a, b in rows], touch)
    assert len(got) == len(set(got)) and set(got) == want


def test_long_interval_spans_blocks(spark):
    df = spark.createDataFrame([(1, 5, 10**12, ""), (1, 100, 200, ""), (1, 10**12 + 2, 10**12 + 3, "")], SCHEMA)
    assert {tuple(r) for r in periods_and_gaps(df, "rec", "a", "b").collect()} == {(1, "period", 5, 10**12), (1, "gap", 10**12 + 1, 10**12 + 1), (1, "period", 10**12 + 2, 10**12 + 3)}


def test_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), "rec", "a", "b").collect() == []


def test_merge_is_associative():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 300, 80)
    t = s + rng.integers(0, 9, 80)
    g = rng.integers(0, 3, 80)
    whole = merge_disjoint(g, s, t, 1)
    a, b = merge_disjoint(g[:37], s[:37], t[:37], 1), merge_disjoint(g[37:], s[37:], t[37:], 1)
    again = merge_disjoint(*(np.concatenate(x) for x in zip(a, b)), 1)
    assert all((x == y).all() for x, y in zip(whole, again))
