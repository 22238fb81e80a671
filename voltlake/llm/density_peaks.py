"""Groups of mutually similar records by density peaks.

Records are first gathered into cells of the feature space narrower than the kernel (a cell keeps its
count and mean), so what follows depends on how much of the space is
occupied rather than on the number of records, and a heap of equal records is one cell. Density
of a cell is the kernel-weighted count of records within two kernels; its pointer goes to the nearest denser cell
within reach. A cell without one is a candidate; candidates of high density times distance are
peaks, the others strays. Both steps are blocked neighbour joins: space is cut
into blocks, every cell goes to its home block and, as a candidate, to the blocks whose border it
is within reach of, blocks that hold too many cells are cut along further dimensions, and inside a block
a grid narrows down the pairs. Following pointers by doubling leads every cell to its peak.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import checkpoint, small_side

#: Salts over which the members of one cell are spread while repeated rows are dropped.
SALTS = 32
#: Dimensions that the blocks cut at first, the blocks' width as a multiple of the reach, and cells a block holds before
#: it is cut along another dimension.
SPLIT_DIMS = 3
BLOCK_REACHES = 8
MAX_CELLS = 20_000
#: Radius of the density in kernels, and part of the reach in which a denser cell is looked for first.
RADIUS = 2.0
FIRST = 0.5
#: Least density of a peak, and bins per octave and empty bins that tell peaks from strays.
LEAST, OCTAVE, EMPTY = 10.0, 4, 8
#: Points of a leaf, and multiplications of one matrix product: few enough to stay in the cache and on one thread.
LEAF = 128
PRODUCT = 1 << 18


def _cell(coords: list[str], width: float) -> Column:
    return F.xxhash64(*(F.floor(F.col(c) / width).cast("long") for c in coords))


def _coordinates(df: DataFrame, key: str, coords: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"x{i}" for i in range(len(coords))]
    return df.select(F.col(key).cast("long").alias("id"), *(x.cast("float").alias(c) for x, c in zip(coords, names))), names


def _finite(names: list[str]) -> Column:
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)
    return ok


def gather_cells(df: DataFrame, key: str, coords: list[Column], width: float) -> DataFrame:
    """(cell, n, x array): occupied cells with count and mean.

    Rows of the same ``key`` and coordinates count once; rows with a null key or a coordinate
    that is null, NaN or infinite belong to no cell.
    """
    rows, names = _coordinates(df, key, coords)
    rows = rows.where(F.col("id").isNotNull() & _finite(names)).withColumn("cell", _cell(names, width))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).repartition("cell", "salt")
    rows = rows.groupBy("cell", "salt", "id").agg(*(F.first(c).alias(c) for c in names))
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names))
    return cells.select("cell", "n", F.array(*((F.col(c) / F.col("n")).cast("float") for c in names)).alias("x"))


def _at(i: int, width: float, off: float = 0.0) -> Column:
    return F.floor((F.col("x")[i] + off) / width).cast("long")


def block_levels(cells: DataFrame, dims: int, reach: float) -> DataFrame:
    """(base, level): how many dimensions the blocks of a base block are cut along.

    The base blocks cut ``SPLIT_DIMS`` dimensions; where a block holds more than ``MAX_CELLS``, one more is cut,
    as long as there are any. Base blocks that need no more aren't listed.
    """
    split, width = min(SPLIT_DIMS, dims), BLOCK_REACHES * reach
    fine = cells.groupBy(F.xxhash64(*(_at(i, width) for i in range(split))).alias("base"), *(_at(i, width).alias(f"b{i}") for i in range(split, dims))).agg(F.count(F.lit(1)).alias("n"))
    over = None
    for level in range(split, dims):
        most = fine.groupBy("base", *(f"b{i}" for i in range(split, level))).agg(F.sum("n").alias("n")).where(F.col("n") > MAX_CELLS).select("base", F.lit(level + 1).alias("level"))
        over = most if over is None else over.unionByName(most)
        fine = fine.join(most.select("base").distinct(), "base", "left_semi") if level == split else fine
    if over is None:
        over = cells.select(F.lit(0).cast("long").alias("base"), F.lit(0).alias("level")).limit(0)
    return checkpoint(over.groupBy("base").agg(F.max("level").alias("level")))


def _blocks(cells: DataFrame, dims: int, reach: float, levels: DataFrame) -> DataFrame:
    """``cells`` in all blocks they are needed in: adds ``block`` and ``home``."""
    split, width = min(SPLIT_DIMS, dims), BLOCK_REACHES * reach
    out, home = cells, F.lit(True)

    def cut(i: int) -> Column:
        return F.sequence(_at(i, width, -reach), _at(i, width, reach))

    for i in range(split):
        out = out.withColumn(f"b{i}", F.explode(cut(i)))
        home = home & (F.col(f"b{i}") == _at(i, width))
    out = out.withColumn("base", F.xxhash64(*(f"b{i}" for i in range(split)))).join(small_side(levels, 100_000), "base", "left")
    for i in range(split, dims):
        deep = F.coalesce("level", F.lit(0)) > i
        out = out.withColumn(f"b{i}", F.explode(F.when(deep, cut(i)).otherwise(F.array(F.lit(0).cast("long")))))
        home = home & (~deep | (F.col(f"b{i}") == _at(i, width)))
    return out.withColumn("home", home).withColumn("block", F.xxhash64(*(f"b{i}" for i in range(dims)))).drop("base", "level", *(f"b{i}" for i in range(dims)))


def leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points, and the edges in it of the leaves of a k-d tree of at most ``LEAF`` points each."""
    order = np.arange(len(x))
    edges, todo = [0], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            edges.append(hi)
            continue
        part = order[lo:hi]
        p = x[part]
        k, half = int(np.argmax(p.max(0) - p.min(0))), (hi - lo) // 2
        order[lo:hi] = part[np.argpartition(p[:, k], half)]
        todo += [(lo + half, hi), (lo, lo + half)]
    return order, np.array(edges)


def neighbour_blocks(x: np.ndarray, home: np.ndarray, reach: float, rank: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, squared distances i x j), between them covering all pairs within ``reach``, i at home.

    Points of a leaf meet the points of all leaves whose boxes lie within reach, one matrix product for each. With
    ``rank`` points that rank after all of the leaf are left out.
    """
    if not home.any():
        return
    order, edges = leaves(x)
    p, size = x[order], np.diff(edges)
    low, high = np.minimum.reduceat(p, edges[:-1]), np.maximum.reduceat(p, edges[:-1])
    most = reach**2 * (1 + 1e-9)
    for at in range(len(size)):
        mine = order[edges[at] : edges[at + 1]]
        mine = mine[home[mine]]
        if not len(mine):
            continue
        apart = np.maximum(0, np.maximum(low - high[at], low[at] - high))
        other = np.flatnonzero(np.repeat(np.einsum("ij,ij->i", apart, apart) <= most, size))
        if rank is not None:
            other = other[rank[order[other]] < rank[mine].max()]
        q = p[other]
        apart = np.maximum(0, np.maximum(low[at] - q, q - high[at]))
        close = np.einsum("ij,ij->i", apart, apart) <= most
        other, q = other[close], q[close] - (low[at] + high[at]) / 2
        a = x[mine] - (low[at] + high[at]) / 2
        # The squared lengths ride along in the product.
        left = np.column_stack([-2 * a, np.ones(len(a)), (a**2).sum(1)])
        right = np.column_stack([q, (q**2).sum(1), np.ones(len(q))])
        step = max(1, PRODUCT // left.size)
        for lo in range(0, len(other), step):
            yield mine, order[other[lo : lo + step]], left @ right[lo : lo + step].T


def _matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    x = t.column("x").combine_chunks() if isinstance(t, pa.Table) else t.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64)


def _in_order(t: pa.Table) -> pa.Table:
    """Rows by cell, so that sums come out the same however rows arrive."""
    return t.take(pa.array(np.argsort(t.column("cell").to_numpy(), kind="stable")))


def _density(radius: float, kernel: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = _in_order(t)
        home = t.column("home").to_numpy()
        n = t.column("n").to_numpy().astype(np.float64)
        rho = np.zeros(t.num_rows)
        for i, j, d in neighbour_blocks(_matrix(t), home, radius):
            close = np.flatnonzero(d <= radius**2)
            row, column = np.divmod(close, len(j))
            rho[i] += np.bincount(row, weights=np.exp(d.ravel()[close] / -(kernel**2)) * n[j][column], minlength=len(i))
        # Rounded, so that the order of summation can't change which of two cells is denser.
        return pa.table({"cell": t.column("cell").filter(pa.array(home)), "rho": pa.array(np.round(rho[home], 6))})

    return run


def _pointer(reach: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = _in_order(t)
        home, cell, rho = t.column("home").to_numpy(), t.column("cell").to_numpy(), t.column("rho").to_numpy()
        order = np.lexsort((cell, -rho))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        to = np.arange(len(cell))
        best = np.full(len(cell), np.inf)
        x, left = _matrix(t), home.copy()
        # Most cells have a denser one nearby; only the rest is searched through the whole reach.
        for near in (FIRST * reach, reach):
            for i, j, d in neighbour_blocks(x, left, near, rank):
                d[rank[j] >= rank[i][:, None]] = np.inf
                at = d.argmin(1)
                got = d[np.arange(len(i)), at]
                closer = (got <= near**2) & ((got < best[i]) | ((got == best[i]) & (rank[j[at]] < rank[to[i]])))
                to[i[closer]], best[i[closer]] = j[at[closer]], got[closer]
            left = left & np.isinf(best)
        best = np.sqrt(np.maximum(best, 0))
        return pa.table({"cell": pa.array(cell[home]), "to": pa.array(cell[to[home]]), "delta": pa.array(np.where(np.isfinite(best[home]), best[home], np.nan))})

    return run


def least_density(candidates: DataFrame) -> float:
    """Density from which a candidate is a peak.

    All candidates are at least the reach away from anything denser, so their density decides. Where the logarithms of
    the densities leave a gap of two octaves or more, peaks lie above the widest one; they have ``LEAST`` at any rate.
    """
    bins = sorted(r[0] for r in candidates.select(F.floor(F.log2(F.greatest("rho", F.lit(1e-6))) * OCTAVE).alias("b")).distinct().collect())
    gap, top = max(((hi - lo, hi) for lo, hi in zip(bins, bins[1:])), default=(0, 0))
    return max(LEAST, 2.0 ** (top / OCTAVE) * (1 - 1e-9)) if gap > EMPTY else LEAST


def label_cells(cells: DataFrame, dims: int, reach: float, kernel: float) -> DataFrame:
    """(cell, n, x, rho, delta, peak): ``peak`` is the cell at the end of the pointers, null for strays.

    ``delta`` is the distance to the nearest denser cell, NaN where there is none within reach.
    """
    levels = block_levels(cells, dims, reach)
    radius = min(reach, RADIUS * kernel)
    dense = _blocks(cells.select("cell", "n", "x"), dims, reach, levels).groupBy("block").applyInArrow(_density(radius, kernel), "cell bigint, rho double")
    cells = checkpoint(cells.join(dense, "cell"))
    points = _blocks(cells.select("cell", "rho", "x"), dims, reach, levels).groupBy("block").applyInArrow(_pointer(reach), "cell bigint, to bigint, delta double")
    points = checkpoint(points)
    ends = points.select("cell", "to")
    while True:
        # A cell whose target is a peak is done; the others skip to their target's target.
        nxt = ends.select(F.col("cell").alias("_c"), F.col("to").alias("_t"))
        ends = checkpoint(ends.join(nxt, ends["to"] == nxt["_c"]).select("cell", F.col("_t").alias("to"), (F.col("_t") != F.col("to")).alias("moved")))
        if ends.where("moved").isEmpty():
            break
        ends = ends.select("cell", "to")
    candidates = checkpoint(cells.join(points.where(F.col("cell") == F.col("to")).select("cell"), "cell").select(F.col("cell").alias("to"), "rho"))
    peaks = candidates.where(F.col("rho") >= least_density(candidates)).select("to", F.col("to").alias("peak"))
    ends = ends.select("cell", "to").join(small_side(checkpoint(peaks), 500_000), "to", "left").select("cell", "peak")
    return cells.join(points.select("cell", "delta"), "cell").join(ends, "cell")


def density_peaks(df: DataFrame, key: str, coords: list[Column], width: float, reach: float, kernel: float) -> DataFrame:
    """Cells of ``df`` with their group's peak, see ``label_cells``; ``width`` lies below ``kernel``.

    ``reach`` is the distance below which a denser record takes a record along: two peaks are never closer.
    An empty table gives an empty result; ties in density are broken by the cell's number.
    """
    return label_cells(checkpoint(gather_cells(df, key, coords, width)), len(coords), reach, kernel)


def _ranked(w: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*w).orderBy(*order))


def describe_groups(df: DataFrame, key: str, coords: list[Column], width: float, labels: DataFrame, typical: int = 5) -> DataFrame:
    """(group_id, n_members, n_cells, density, centroid, typical_ids) of labelled cells.

    ``typical_ids`` are the ``typical`` members nearest to the mean of the peak's cell among those of the densest cells that
    hold so many, nearest first; ``group_id`` is the first of them. Strays, records too far from any peak, come in
    one row of their own without a group.
    """
    rows, names = _coordinates(df, key, coords)
    mean = [(F.sum(F.col("x")[i] * F.col("n")) / F.sum("n")) for i in range(len(coords))]
    sums = labels.groupBy("peak").agg(F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_cells"), F.max("rho").alias("density"), F.array(*(F.round(m, 4) for m in mean)).cast("array<double>").alias("centroid"))
    dense = labels.where("peak is not null").select("peak", "cell", "n", "rho").withColumn("rn", _ranked(["peak"], F.desc("rho"), "cell")).where(F.col("rn") <= typical)
    before = F.sum("n").over(Window.partitionBy("peak").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1))
    dense = dense.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < typical).select("peak", "cell")
    middle = labels.where(F.col("cell") == F.col("peak")).select("peak", F.col("x").alias("_m"))
    near = rows.where(F.col("id").isNotNull() & _finite(names)).withColumn("cell", _cell(names, width)).join(small_side(checkpoint(dense.join(middle, "peak")), 500_000), "cell")
    off = sum(((F.col(c) - F.col("_m")[i]) ** 2 for i, c in enumerate(names[1:], 1)), (F.col(names[0]) - F.col("_m")[0]) ** 2)
    top = near.groupBy("peak", "id").agg(F.min(off).alias("d")).withColumn("rn", _ranked(["peak"], "d", "id")).where(F.col("rn") <= typical)
    top = top.groupBy("peak").agg(F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("t")).select(F.col("peak").alias("_p"), F.col("t.id").alias("typical_ids"))
    known = F.col("peak").isNotNull()
    out = sums.join(top, sums["peak"] == top["_p"], "left")
    return out.select(F.col("typical_ids")[0].alias("group_id"), "n_members", "n_cells", F.when(known, F.col("density")).alias("density"), F.when(known, F.col("centroid")).alias("centroid"), "typical_ids")


def members(df: DataFrame, key: str, coords: list[Column], width: float, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, group_id, kind): the group of every record, one row per key and group.

    ``groups`` are those of ``describe_groups``. ``kind`` is member, stray (no peak within reach) or unplaced (a coordinate is
    missing); of the latter two ``group_id`` is null.
    """
    rows, names = _coordinates(df, key, coords)
    rows = rows.select("id", F.when(F.col("id").isNotNull() & _finite(names), _cell(names, width)).alias("cell")).distinct()
    first = groups.where("group_id is not null").select("group_id")
    heads = rows.join(small_side(first, 500_000), F.col("id") == F.col("group_id")).select("cell", "group_id")
    heads = labels.select("cell", "peak").join(heads, "cell").select("peak", "group_id").distinct()
    known = labels.select("cell", "peak").join(heads, "peak", "left").select(F.col("cell").alias("_c"), "group_id")
    known = small_side(checkpoint(known), 500_000)
    kind = F.when(F.col("group_id").isNotNull(), "member").when(F.col("cell").isNotNull(), "stray").otherwise("unplaced")
    return rows.join(known, rows["cell"] == known["_c"], "left").select(F.col("id").alias(key), "group_id", kind.alias("kind"))
