import numpy as np
from pyspark.sql import functions as F

from voltlake.llm import density_peaks as dp
from voltlake.llm import plans

SCHEMA = "id bigint, a float, b float, c float, cell string, n string"
def xyz():
    return [F.col(x) for x in "abc"]


def blobs(n=300, seed=0):
    rng = np.random.default_rng(seed)
    centre = np.array([[0, 0, 0], [20, 0, 5], [-3, 25, 0]])
    which = rng.integers(0, 3, n)
    return which, centre[which] + rng.normal(0, 1, (n, 3))


def test_finds_the_groups(spark):
    which, x = blobs()
    rows = [(i, *map(float, p), "", "") for i, p in enumerate(x)] + [(900, 60.0, 60.0, 60.0, "", ""), (901, None, 0.0, 0.0, "", ""), (902, float("nan"), 0.0, 0.0, "", ""), (None, 0.0, 0.0, 0.0, "", "")]
    df = spark.createDataFrame(rows + rows[:30], SCHEMA).repartition(3)
    labels = dp.density_peaks(df, "id", xyz(), 1.0, 6.0, 2.0)
    described = dp.describe_groups(df, "id", xyz(), 1.0, labels)
    groups = {r.group_id: r for r in described.collect()}
    assert groups[None].n_members == 1 and groups.pop(None).typical_ids is None
    assert sorted(r.n_members for r in groups.values()) == sorted(np.bincount(which))
    got = dp.members(df, "id", xyz(), 1.0, labels, described).collect()
    of, kind = {r.id: r.group_id for r in got}, {r.id: r.kind for r in got}
    assert of[901] is None and of[902] is None and of[900] is None
    assert kind[900] == "stray" and kind[901] == kind[902] == kind[None] == "unplaced" and kind[0] == "member"
    for k in range(3):
        assert len({of[i] for i in np.flatnonzero(which == k)}) == 1
    for g, r in groups.items():
        assert len(r.typical_ids) == 5 and r.typical_ids[0] == g and all(of[i] == g for i in r.typical_ids)


def test_typical_members_are_those_nearest_the_peak(spark):
    _, x = blobs()
    df = spark.createDataFrame([(i, *map(float, p), "", "") for i, p in enumerate(x)], SCHEMA)
    labels = dp.density_peaks(df, "id", xyz(), 2.0, 6.0, 2.5)
    cells = {r.cell: r for r in labels.collect()}
    at = {r.id: r.c for r in df.select("id", F.xxhash64(*(F.floor(c / 2.0).cast("long") for c in xyz())).alias("c")).collect()}
    for r in dp.describe_groups(df, "id", xyz(), 2.0, labels).collect():
        if r.group_id is None:
            continue
        peak = cells[cells[at[r.group_id]].peak]
        d = sorted((((x[i] - np.array(peak.x)) ** 2).sum(), i) for i in range(len(x)) if at[i] == peak.cell)
        assert peak.n < 5 or list(r.typical_ids) == [i for _, i in d[:5]]


def exact_groups(x, reach, kernel):
    """Density peaks of single records: the peak each leads to, -1 for strays."""
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    rho = np.where(d2 <= (dp.RADIUS * kernel) ** 2, np.exp(-d2 / kernel**2), 0).sum(1)
    order = np.lexsort((np.arange(len(x)), -rho))
    to = np.arange(len(x))
    for r, i in enumerate(order[1:], 1):
        up = order[:r]
        j = up[np.argmin(d2[i, up])]
        if d2[i, j] <= reach**2:
            to[i] = j
    for i in order:
        to[i] = to[to[i]]
    return np.where(rho[to] >= dp.LEAST, to, -1)


def test_agrees_with_exact_density_peaks_at_the_registered_setting(spark):
    rng = np.random.default_rng(4)
    centre = rng.uniform(-60, 60, (9, 7))
    which = rng.choice(9, 1500, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
    x = np.vstack([centre[which] + rng.normal(0, 1.6, (1500, 7)), rng.uniform(-300, 300, (60, 7))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, p array<float>")
    coords = [F.col("p")[k] for k in range(7)]
    labels = dp.density_peaks(df, "id", coords, plans.P6_WIDTH, plans.P6_REACH, plans.P6_KERNEL)
    got = dp.members(df, "id", coords, plans.P6_WIDTH, labels, dp.describe_groups(df, "id", coords, plans.P6_WIDTH, labels)).collect()
    mine = np.full(len(x), -1)
    for r in got:
        mine[r.id] = -1 if r.group_id is None else r.group_id
    true = exact_groups(x.astype(float), plans.P6_REACH, plans.P6_KERNEL)
    together = lambda g: (g[:, None] == g[None]) & (g >= 0)[:, None]
    a, b = together(mine), together(true)
    assert (a & b).sum() >= 0.9 * b.sum() and (a & b).sum() >= 0.9 * a.sum()


def test_full_blocks_are_cut_further(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.uniform(-30, 30, (1200, 5))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, p array<float>")
    coords = [F.col("p")[k] for k in range(5)]
    run = lambda: sorted((r.cell, r.rho, round(r.delta, 6) if r.delta == r.delta else None, r.peak) for r in dp.density_peaks(df, "id", coords, 2.0, 6.0, 2.5).collect())
    whole = run()
    monkeypatch.setattr(dp, "MAX_CELLS", 5)
    cells = dp.gather_cells(df, "id", coords, 2.0)
    assert {r.level for r in dp.block_levels(cells, 5, 6.0).collect()} <= {4, 5} and dp.block_levels(cells, 5, 6.0).count()
    assert run() == whole


def test_pairs_against_brute_force(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(dp, "LEAF", 7)
    for dims in (1, 2, 3, 5, 7):
        x = rng.uniform(-4, 4, (80, dims))
        home = rng.random(80) < 0.7
        met = np.zeros((80, 80), int)
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        for i, j, dd in dp.neighbour_blocks(x, home, 2.0):
            met[np.ix_(i, j)] += 1
            assert np.allclose(dd, d[np.ix_(i, j)])
        assert met.max() == 1 and not met[~home].any() and met[home][d[home] <= 4].all()


def test_density_and_pointers_against_brute_force(spark):
    _, x = blobs(120, 3)
    df = spark.createDataFrame([(i, *map(float, p), "", "") for i, p in enumerate(x)], SCHEMA)
    got = dp.density_peaks(df, "id", xyz(), 0.5, 4.0, 2.0).collect()  # the radius of the density is the reach
    p, n, cell = np.array([r.x for r in got], float), np.array([r.n for r in got]), np.array([r.cell for r in got])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    rho = np.where(d <= 4, np.exp(-(d**2) / 4), 0) @ n
    assert np.allclose(rho, [r.rho for r in got], atol=1e-5)
    rank = np.empty(len(got), int)
    rank[np.lexsort((cell, -np.array([r.rho for r in got])))] = np.arange(len(got))
    for i, r in enumerate(got):
        up = (rank < rank[i]) & (d[i] <= 4)
        assert np.isnan(r.delta) if not up.any() else abs(r.delta - d[i][up].min()) < 1e-4


def test_equal_records_and_empty(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0, 1.0, "", "") for i in range(50)], SCHEMA)
    assert [r.n_members for r in dp.describe_groups(df, "id", xyz(), 1.0, dp.density_peaks(df, "id", xyz(), 1.0, 3.0, 1.0)).collect()] == [50]
    labels = dp.density_peaks(df.limit(0), "id", xyz(), 1.0, 3.0, 1.0)
    assert labels.collect() == [] and dp.describe_groups(df.limit(0), "id", xyz(), 1.0, labels).collect() == []
