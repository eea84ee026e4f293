"""Density clustering: DBSCAN for one setting by cells, and for many settings by one forest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product
from operator import add
from math import ceil, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .checkpoints import written
from .ordered import numbered

#: Points of a lot; two lots meet in a task, tile by tile.
LOT, TILE = 48_000, 2048
#: Lots that fewer points are dealt to, so that tasks share the work, and the least points of such a lot.
SPREAD, LEAST = 10, 2000
#: Sides of a tile of products, and of one of points that lie together.
WIDE, NARROW = (512, 1024), 512
#: Different points up to which one task holds what it takes to join them; some 150 MB.
ONE = 1 << 20
#: Points that the cuts between lots are taken from.
CUTS = 20_000
#: Columns beyond which cells of side eps / sqrt(columns) hold next to nothing but single points.
MOST_CELLS = 8
#: Kept off a cell's side, so that points of one cell are within eps whatever the rounding.
MARGIN = 1e-9


def settle(edges: DataFrame, by: Sequence[str] = (), rounds: int = 60) -> DataFrame:
    """(by, a, label): the smallest node reachable from each node of (by, a, b) edges.

    Alternating star contraction, so that long chains take rounds by the logarithm of their
    length: every larger neighbour of a node goes to the node's smallest neighbour, then a node
    and its smaller neighbours to the smallest of them. Each step is written.
    """
    by, key = list(by), [*by, "a"]
    nodes = edges.select(*key).unionAll(edges.select(*by, "b")).distinct()
    now = written(edges.where("a != b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*key, "b") % 1_000_003)).first()
        if not state[0] or state == before:
            break
        both = now.unionAll(now.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*key).agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        now = written(both.where("b > a").join(least, key).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = now.groupBy(*key).agg(F.min("b").alias("m"))
        moved = now.join(least, key).where("b != m").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(moved.unionAll(least.withColumnRenamed("m", "b")).distinct())
    else:
        raise RuntimeError(f"labels not settled after {rounds} rounds")
    return written(nodes.join(now, key, "left").select(*key, F.coalesce("b", "a").alias("label")))


def _sum(parts: Iterator[Column]) -> Column:
    return reduce(add, parts)


def dbscan(points: DataFrame, key: str, columns: Sequence[str], eps: float, min_pts: int) -> DataFrame:
    """(key, cluster): density clusters numbered from 0, noise -1, one row for each point.

    A core point has ``min_pts`` points within ``eps``, itself counted; cores within ``eps``
    share a cluster; another point joins the cluster of its core neighbour with the smallest
    number. Clusters are numbered by their smallest core key.

    Equal points are one with a weight. Points fall in cells of side eps / sqrt(dimensions), all
    of a cell being within eps of each other: a cell that holds ``min_pts`` has cores only, and
    no pair inside a cell is ever made. Of two cells, their bounding boxes tell whether all,
    none or some of their points are within eps; single points are compared in the last case,
    and only where a cell with few points takes part. Two full cells that touch are tried by
    the points nearest to each other's box, and compared in whole only if these are too far
    apart and nothing else joins them. A point without one of its coordinates is noise.

    Of over MOST_CELLS columns a cell holds next to no two points, and boxes on three of them
    leave nearly all pairs to be compared: they are compared lot by lot, as dbscan_settings() does.
    """
    if len(columns) > MOST_CELLS:
        return dbscan_settings(points, key, columns, [eps], [min_pts]).select(key, "cluster")
    q = [f"q{i}" for i in range(len(columns))]
    keyed = points.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, q)))
    whole = reduce(Column.__and__, (F.col(n).isNotNull() & ~F.isnan(n) for n in q))
    side, steps = eps / sqrt(len(q)) * (1 - MARGIN), floor(sqrt(len(q)) * (1 + 2 * MARGIN)) + 1
    units = keyed.where(whole).groupBy(*q).agg(F.min("key").alias("u"), F.count(F.lit(1)).alias("w"))
    units = written(units.withColumn("cell", F.array(*(F.floor(F.col(n) / side) for n in q))))
    ends = [f(n).alias(f"{e}{n}") for n in q for e, f in (("low_", F.min), ("high_", F.max))]
    cells = units.groupBy("cell").agg(F.min("u").alias("c"), F.sum("w").alias("n"), *ends)
    cells = written(cells.withColumn("dense", F.col("n") >= min_pts))
    units = written(units.join(cells.select("cell", "c", "n", "dense"), "cell").drop("cell"))
    # Cells of ``steps`` cells on up to three columns: what is within eps lies in the next one.
    grid = [f"g{i}" for i in range(min(3, len(q)))]
    boxes = cells.select("c", "n", "dense", *(f"{e}_{n}" for n in q for e in ("low", "high")), *(F.floor(F.col("cell")[i] / steps).alias(g) for i, g in enumerate(grid)))
    near = F.array(*(F.struct(*(F.lit(s).alias(g) for s, g in zip(shift, grid))) for shift in product((-1, 0, 1), repeat=len(grid))))
    spread = boxes.withColumn("s", F.explode(near)).withColumns({g: F.col(g) + F.col(f"s.{g}") for g in grid}).drop("s")
    a, b = spread.alias("a"), boxes.alias("b")
    met = a.join(b, reduce(Column.__and__, (F.col(f"a.{g}") == F.col(f"b.{g}") for g in grid)) & (F.col("a.c") != F.col("b.c")))
    gap = _sum(F.pow(F.greatest(F.lit(0.0), F.col(f"b.low_{n}") - F.col(f"a.high_{n}"), F.col(f"a.low_{n}") - F.col(f"b.high_{n}")), F.lit(2.0)) for n in q)
    span = _sum(F.pow(F.greatest(F.col(f"a.high_{n}") - F.col(f"b.low_{n}"), F.col(f"b.high_{n}") - F.col(f"a.low_{n}")), F.lit(2.0)) for n in q)
    middle = [((F.col(f"b.low_{n}") + F.col(f"b.high_{n}")) / 2).alias(f"m_{n}") for n in q]
    pairs = written(met.where(gap <= eps * eps * (1 + MARGIN)).select(
        F.col("a.c").alias("a"), F.col("b.c").alias("b"), F.col("a.dense").alias("dense_a"), F.col("b.dense").alias("dense_b"), F.col("b.n").alias("n_b"), (span <= eps * eps * (1 - MARGIN)).alias("all_near"), *middle
    ))
    left = units.select(F.col("c").alias("a"), F.col("u").alias("ua"), *(F.col(n).alias(f"a_{n}") for n in q))
    right = units.select(F.col("c").alias("b"), F.col("u").alias("ub"), F.col("w").alias("w_b"), *(F.col(n).alias(f"b_{n}") for n in q))
    apart = F.sqrt(_sum(F.pow(F.col(f"a_{n}") - F.col(f"b_{n}"), F.lit(2.0)) for n in q))
    some = pairs.where("not all_near and not dense_a").select("a", "b")
    close = written(some.join(left, "a").join(right, "b").where(apart <= eps).select("a", "b", "ua", "ub", "w_b"))
    # Cores: what the own cell, cells wholly within eps and single points add up to.
    by_cell = pairs.where("all_near and not dense_a").groupBy(F.col("a").alias("c")).agg(F.sum("n_b").alias("n_all"))
    by_unit = close.groupBy(F.col("ua").alias("u")).agg(F.sum("w_b").alias("n_some"))
    counted = units.select("u", "c", "n", "dense").join(by_cell, "c", "left").join(by_unit, "u", "left")
    zero = F.lit(0)
    state = written(counted.select("u", "c", (F.col("dense") | (F.col("n") + F.coalesce("n_all", zero) + F.coalesce("n_some", zero) >= min_pts)).alias("core")))
    first = written(state.where("core").groupBy("c").agg(F.min("u").alias("first")))
    nodes = first.select(F.col("c").alias("a"), F.col("c").alias("b"))
    cores = state.where("core").select("u")
    links = pairs.where("all_near").select("a", "b")
    links = links.unionAll(close.join(cores.select(F.col("u").alias("ua")), "ua").join(cores.select(F.col("u").alias("ub")), "ub").select("a", "b"))
    # Full cells: the point of one nearest to the other's middle, and the other's nearest to it.
    full = pairs.where("not all_near and dense_a and dense_b and a < b").select("a", "b", *(f"m_{n}" for n in q))
    nearest = full.join(left, "a").groupBy("a", "b").agg(F.min_by(F.struct(*(f"a_{n}" for n in q)), _sum(F.pow(F.col(f"a_{n}") - F.col(f"m_{n}"), F.lit(2.0)) for n in q)).alias("p"))
    tried = written(nearest.join(right, "b").groupBy("a", "b").agg(F.min(F.sqrt(_sum(F.pow(F.col(f"p.a_{n}") - F.col(f"b_{n}"), F.lit(2.0)) for n in q))).alias("d")))
    links = links.unionAll(tried.where(F.col("d") <= eps).select("a", "b"))
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = first.select(F.col("c").alias("a"))
    edges = written(both(links).join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b").distinct().unionAll(nodes))
    if first.isEmpty():
        return keyed.select(F.col("key").alias(key), F.lit(-1).alias("cluster"))
    labels = settle(edges)
    own = labels.select(F.col("a"), F.col("label").alias("la"))
    left_over = written(tried.where(F.col("d") > eps).select("a", "b").join(own, "a").join(own.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b").where("la != lb").select("a", "b"))
    if not left_over.isEmpty():
        found = left_over.join(left, "a").join(right, "b").where(apart <= eps).select("a", "b").distinct()
        labels = settle(written(edges.unionAll(both(found))))
    # Clusters are numbered by their smallest core.
    heads = labels.join(first.withColumnRenamed("c", "a"), "a").groupBy("label").agg(F.min("first").alias("head"))
    numbers = numbered(heads, ["head"]).select("label", F.col("_position").cast("int").alias("cluster"))
    named = written(labels.join(numbers, "label").select(F.col("a").alias("c"), "cluster"))
    rest = state.where("not core").select("u", "c")
    reached = rest.join(named, "c").select("u", "cluster")
    over = pairs.where("all_near").select(F.col("a").alias("c"), F.col("b").alias("other")).join(named.withColumnRenamed("c", "other"), "other")
    reached = reached.unionAll(rest.join(over, "c").select("u", "cluster"))
    lone = close.join(cores.select(F.col("u").alias("ub")), "ub").select(F.col("ua").alias("u"), F.col("b").alias("c"))
    reached = reached.unionAll(rest.select("u").join(lone, "u").join(named, "c").select("u", "cluster"))
    placed = state.where("core").join(named, "c").select("u", "cluster").unionAll(reached).groupBy("u").agg(F.min("cluster").alias("cluster"))
    found = units.join(placed, "u").select(*q, "cluster")
    return keyed.join(found, q, "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _halves(rows: pa.Table) -> list[pa.Table]:
    """The rows of the first and of the second lot of a task."""
    second = rows["second"].to_numpy()
    return [rows.filter(pa.array(second == side)) for side in (False, True)]


def _sides(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, coordinates, weights, core distances) of the first and the second lot of a task."""
    return [(own["number"].to_numpy(), _matrix(own["x"]), own["w"].to_numpy(), _matrix(own["cores"])) for own in _halves(rows)]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of two equally long arrays."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += (x - y) ** 2
    return np.sqrt(total)


def _exactly(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of a[i] and b[j], so many at a time."""
    return np.concatenate([_exact(a[i[k : k + TILE * 8]], b[j[k : k + TILE * 8]]) for k in range(0, len(i), TILE * 8)] or [np.zeros(0)])


def _firsts(i: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of places in an order by i, those of the first ``most`` of each i."""
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < most]


class _Squares:
    """Squared distances of a tile, none of them wrong by more than ``slack``.

    Products in single precision where that is fine enough for ``least``, else differences. The
    squares of both sides are columns of the products.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, least: float):
        with np.errstate(all="ignore"):
            base = a.mean(0)
            self.a, self.b = ((v - base).astype(np.float32) for v in (a, b))
            sa, sb = ((v * v).sum(1)[:, None] for v in (self.a, self.b))
            self.slack = (a.shape[1] + 8) * 2.0**-22 * (float(sa.max()) + float(sb.max()))
        self.products = self.slack <= 0.05 * least * least
        if self.products:
            self.a = np.concatenate([self.a * np.float32(-2), sa, np.ones_like(sa)], axis=1)
            self.b = np.concatenate([self.b, np.ones_like(sb), sb], axis=1)
        else:
            self.a, self.b, self.slack = a, b, 1e-12 * least * least

    def __call__(self, rows: slice, columns: slice) -> np.ndarray:
        if self.products:
            return self.a[rows] @ self.b[columns].T
        with np.errstate(all="ignore"):
            return reduce(add, ((x[:, None] - y) ** 2 for x, y in zip(self.a[rows].T, self.b[columns].T)))


class _Best:
    """Of each point of a those of b that may be among its ``most`` nearest within ``bound``."""

    def __init__(self, a: np.ndarray, b: np.ndarray, most: int, bound: np.ndarray, slack: float):
        self.a, self.b, self.most, self.within, self.slack = a, b, most, bound, slack
        self.best, self.found = np.full((len(a), most), np.inf), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        self.bound = np.where(bound < 0, -np.inf, bound * bound * (1 + 1e-6) + slack)

    def add(self, squares: np.ndarray, row: int, column: int) -> None:
        """Looks only into rows whose least square is within their bound."""
        k, bound = self.most, self.bound[row : row + len(squares)]
        own = np.flatnonzero(np.fmin.reduce(squares, axis=1) <= bound)
        if not len(own):
            return
        squares, at = np.ascontiguousarray(squares[own]), own + row
        if squares.shape[1] > k and np.isinf(self.best[at]).all():
            kth = np.partition(squares, k - 1, axis=1)[:, k - 1].astype(float)
            self.bound[at] = np.fmin(self.bound[at], kth * (1 + 1e-6) + 2 * self.slack)
        flat = np.flatnonzero(squares <= self.bound[at].astype(squares.dtype)[:, None])
        i, j = np.divmod(flat, squares.shape[1])
        far = squares.ravel()[flat].astype(float)
        if len(i) > 8 * k * len(squares):  # many that only exact distances tell apart
            exact = _exactly(self.a, self.b, at[i], j + column)
            kept = _firsts(i, np.lexsort((j, exact, i)), k)
            i, j, far = i[kept], j[kept], far[kept]
        self.found.append((at[i], j + column, far))
        kept = _firsts(i, np.lexsort((far, i)), k)
        new = np.full((len(squares), k), np.inf)
        new[i[kept], np.arange(len(kept)) - np.searchsorted(i[kept], i[kept])] = far[kept]
        self.best[at] = np.partition(np.concatenate([self.best[at], new], axis=1), k - 1, axis=1)[:, :k]
        self.bound[at] = np.fmin(self.bound[at], self.best[at].max(1) * (1 + 1e-6) + 2 * self.slack)

    def nearest(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, distance) of each row's ``most`` nearest within its bound, ties to smaller numbers."""
        i, j, far = (np.concatenate(c) for c in zip(*self.found))
        keep = far <= self.bound[i]
        i, j = i[keep], j[keep]
        far = _exactly(self.a, self.b, i, j)
        order = np.lexsort((numbers[j], far, i))
        kept = _firsts(i, order[far[order] <= self.within[i[order]]], self.most)
        return i[kept], j[kept], far[kept]


def _steps(n: int, step: int | None = None) -> list[slice]:
    step = min(step or TILE, TILE)
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def _nearest(rows: pa.Table, most: int, eps: float) -> pa.Table:
    """Of each point the ``most`` nearest of the other lot within eps, with their weights.

    Where rows have a ``bound``, within that; below 0 a point is there for others only.
    """
    sides = []
    for own in _halves(rows):
        bound = own["bound"].to_numpy() if "bound" in own.column_names else np.full(own.num_rows, float(eps))
        order = np.argsort(bound < 0, kind="stable")
        sides.append((own["number"].to_numpy()[order], _matrix(own["x"])[order], own["w"].to_numpy()[order], bound[order]))
    (na, a, wa, ba), (nb, b, wb, bb) = sides
    same = rows["i"][0] == rows["j"][0]
    if same:
        nb, b, wb, bb = na, a, wa, ba
    found = []
    if len(a) and len(b):
        squares = _Squares(a, b, eps)
        here, there = _Best(a, b, most, ba, squares.slack), _Best(b, a, most, bb, squares.slack)
        back = here if same else there
        ask_a, ask_b = (int((v >= 0).sum()) for v in (ba, bb))
        for r in _steps(len(a), WIDE[0]):
            for c in _steps(len(b), WIDE[0] if same else WIDE[1]):
                if same and c.start < r.start or r.start >= ask_a and c.start >= ask_b:
                    continue
                tile = squares(r, c)
                here.add(tile, r.start, c.start)
                if not same or c.start > r.start:
                    back.add(tile.T, c.start, r.start)
        for best, own, others, weights in [(here, na, nb, wb)] + ([] if same else [(there, nb, na, wa)]):
            i, j, far = best.nearest(others)
            found.append((own[i], others[j], weights[j], far))
    number, other, w, far = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 4
    return pa.table({"number": pa.array(number, pa.int64()), "other": pa.array(other, pa.int64()), "w": pa.array(w, pa.int64()), "d": pa.array(far, pa.float64())})


def _unite(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the classes of p and q in ``label``, where each class has its least member's place."""
    while True:
        p, q = label[p], label[q]
        apart = p != q
        if not apart.any():
            return
        p, q = p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _join(label: np.ndarray, hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """Joins the classes of rows and columns that hit. Those that hit the largest class go there
    first, without a list of links."""
    for turn in range(4):
        lr, lc = label[rows], label[columns]
        main = np.bincount(np.concatenate([lr, lc])).argmax()
        open_r, open_c = lr != main, lc != main
        reached = np.concatenate([rows[open_r][hit[np.ix_(open_r, ~open_c)].any(1)], columns[open_c][hit[np.ix_(~open_r, open_c)].any(0)]])
        _unite(label, reached, np.full(len(reached), main))
        if not len(reached):
            break
    rows, columns = rows[open_r], columns[open_c]
    i, j = np.nonzero(hit[np.ix_(open_r, open_c)] & (label[rows][:, None] != label[columns]))
    _unite(label, rows[i], columns[j])


def _forest(rows: pa.Table, sizes: Sequence[int], eps: Sequence[float]) -> pa.Table:
    """For each of ``sizes`` a spanning forest of the links between two lots: its classes at each
    of the ascending ``eps`` are those of the links up to there."""
    (na, a, _, ca), (nb, b, _, cb) = _sides(rows)
    same = rows["i"][0] == rows["j"][0]
    numbers, after = (na, 0) if same else (np.concatenate([na, nb]), len(na))
    out: list[tuple[np.ndarray, ...]] = []
    if len(a) and (same or len(b)):
        b, cores = (a, ca) if same else (b, np.concatenate([ca, cb]))
        squares = _Squares(a, b, eps[0])
        level = np.searchsorted(eps, cores, "left")
        labels = {(k, e): np.arange(len(numbers)) for e in range(len(eps)) for k in range(len(sizes)) if (level[:, k] <= e).any()}
        for r in _steps(len(a)):
            for c in _steps(len(b)):
                if same and c.start < r.start:
                    continue
                tile = None
                for e, far in enumerate(eps):
                    hit = None
                    for k in range(len(sizes)):
                        if (k, e) not in labels:
                            continue
                        label = labels[k, e]
                        own, other = (np.arange(x.start, x.stop) + add for x, add in ((r, 0), (c, after)))
                        in_r, in_c = level[own, k] <= e, level[other, k] <= e
                        own, other = own[in_r], other[in_c]
                        if not len(own) or not len(other) or (label[own[0]] == label[own]).all() and (label[own[0]] == label[other]).all():
                            continue
                        if tile is None:
                            tile = squares(r, c)
                        if hit is None:
                            hit = tile <= far * far - squares.slack
                            i, j = np.nonzero(~hit & ~(tile > far * far + squares.slack))
                            hit[i, j] = _exactly(a, b, i + r.start, j + c.start) <= far
                        _join(label, hit if in_r.all() and in_c.all() else hit[np.ix_(in_r, in_c)], own, other)
        for k, size in enumerate(sizes):
            before = np.arange(len(numbers))
            for e, far in enumerate(eps):
                if (k, e) in labels:
                    pairs = np.unique(np.stack([before, labels[k, e]])[:, (level[:, k] <= e) & (before != labels[k, e])], axis=1)
                    out.append((np.full(pairs.shape[1], size), numbers[pairs[0]], numbers[pairs[1]], np.full(pairs.shape[1], far)))
                    before = labels[k, e]
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.float64()))], names=["min_pts", "a", "b", "reach"])


def _tasks(rows: DataFrame, tasks: int, task: str, make: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``make`` gives for the rows of each of so many tasks, that of a row being its ``task``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from make(pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)

    return rows.repartitionById(tasks, task).drop(task).mapInArrow(run, schema)


def _meet(points: DataFrame, lots: int) -> DataFrame:
    """Rows sent to each pair of lots, once as the first and once as the second."""
    own, other = F.col("lot"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))
    return _paired(points.withColumn("other", other), own, "number", "x", "w", "cores")


def _paired(sent: DataFrame, own: Column, *columns: str | Column) -> DataFrame:
    """Rows that meet those of the lot ``other``, with their ``task``."""
    i, j = F.least(own, "other"), F.greatest(own, "other")
    return sent.select(*columns, i.alias("i"), j.alias("j"), (F.col("other") < own).alias("second"), (j * (j + 1) / 2 + i).cast("int").alias("task"))


def _pairs(lots: int) -> int:
    return lots * (lots + 1) // 2


def _cuts(x: np.ndarray, lots: int) -> tuple | None:
    """(column, value, left, right) cuts of the widest columns, for so many lots of equal share."""
    if lots == 1:
        return None
    column = int(np.ptp(x, axis=0).argmax()) if len(x) else 0
    half, order = lots // 2, np.sort(x[:, column])
    value = float(order[len(order) * half // lots]) if len(order) else 0.0
    left = x[:, column] < value
    return column, value, half, _cuts(x[left], half), _cuts(x[~left], lots - half)


def _cut(x: np.ndarray, cuts: tuple | None) -> np.ndarray:
    """The lot of each row."""
    lot, todo = np.zeros(len(x), np.int32), [(np.arange(len(x)), cuts, 0)]
    while todo:
        at, cuts, first = todo.pop()
        if cuts is None:
            lot[at] = first
        else:
            column, value, half, low, high = cuts
            left = x[at, column] < value
            todo += [(at[left], low, first), (at[~left], high, first + half)]
    return lot


def _boxes(rows: DataFrame, lot: str, *most: str) -> dict[int, tuple[int, np.ndarray, np.ndarray, list[float]]]:
    """Of each lot its number of rows, its box and the largest of the columns ``most``; a task
    has one row a lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            lots, x = batch[lot].to_numpy(), _matrix(pa.chunked_array([batch["x"]]))
            for at in np.unique(lots):
                own = lots == at
                found = int(own.sum()), x[own].min(0), x[own].max(0), np.array([batch[m].to_numpy()[own].max() for m in most])
                before = held.get(int(at))
                held[int(at)] = found if before is None else (before[0] + found[0], np.minimum(before[1], found[1]), np.maximum(before[2], found[2]), np.maximum(before[3], found[3]))
        if held:
            columns = [list(held), [v[0] for v in held.values()], *([v[i].tolist() for v in held.values()] for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3))], names=["lot", "n", "low", "high", "most"])

    made: dict[int, tuple] = {}
    for r in rows.select(lot, "x", *most).mapInArrow(run, "lot int, n long, low array<double>, high array<double>, most array<double>").collect():
        n, low, high, top = made.get(r.lot, (0, np.inf, -np.inf, [-np.inf] * len(most)))
        made[r.lot] = n + r.n, np.minimum(low, r.low), np.maximum(high, r.high), [max(v) for v in zip(top, r.most)]
    return made


def _dealt(units: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(units with their lot, lots): points that lie together share a lot.

    Cuts come from some of the points; a lot that gets too many is divided by hash.
    """
    lots = max(1, ceil(n / LOT), min(SPREAD, ceil(n / LEAST)))
    some = units.where(F.pmod(F.xxhash64("number"), F.lit(ceil(n / CUTS))) == 0).select("x").toArrow() if lots > 1 else None
    cuts = _cuts(_matrix(some["x"]), lots) if some is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("lot", pa.array(_cut(_matrix(pa.chunked_array([batch["x"]])), cuts)))

    dealt = written(units.select("number", "x", "w").mapInArrow(run, "number long, x array<double>, w long, lot int"))
    sizes = {r["lot"]: r["count"] for r in dealt.groupBy("lot").count().collect()}
    parts = [ceil(sizes.get(i, 0) / (LOT * 1.25)) for i in range(lots)]
    first = np.cumsum([0, *parts]).tolist()
    placed = F.array(*(F.struct(F.lit(f).alias("first"), F.lit(max(1, p)).alias("parts")) for f, p in zip(first, parts)))[F.col("lot")]
    return dealt.withColumn("lot", (placed["first"] + F.pmod(F.xxhash64("number"), placed["parts"])).cast("int")), first[-1]


def _sent(rows: DataFrame, lot: str, boxes: dict[int, tuple], meets: np.ndarray, needs: np.ndarray) -> DataFrame:
    """Rows sent to each lot that theirs ``meets`` and to whose box they are as near as their ``bound``,
    or as that lot ``needs``; ``asks`` tells the first."""
    low, high = (np.array([boxes[i][side] for i in range(len(meets))]) for side in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, bound = _matrix(pa.chunked_array([batch["x"]])), batch[lot].to_numpy(), batch["bound"].to_numpy()
            with np.errstate(all="ignore"):
                gap = np.stack([np.sqrt((np.maximum(0, np.maximum(low[i] - x, x - high[i])) ** 2).sum(1)) for i in range(len(meets))], axis=1) * (1 - MARGIN)
            asks = gap <= bound[:, None]
            sent = meets[own] & (asks | (gap <= needs))
            to = pa.StructArray.from_arrays([pa.array(np.nonzero(sent)[1].astype(np.int32)), pa.array(asks[sent])], ["other", "asks"])
            yield batch.append_column("to", pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sent.sum(1)]).astype(np.int32)), to))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = rows.mapInArrow(run, schema + ", to array<struct<other: int, asks: boolean>>").withColumn("to", F.explode("to"))
    return made.select("*", "to.other", "to.asks").drop("to")


def _near(units: DataFrame, n: int, most: int, eps: float) -> tuple[DataFrame, DataFrame, int]:
    """(points with their lot, near, lots): near has each point's ``most`` nearest within eps as (d, other, w).

    Points meet their own lot first. How far the last of these nearest is bounds what a point
    looks for elsewhere, so that it goes to lots only whose boxes are as near as that.
    """
    dealt, lots = _dealt(units, n)
    lists = pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())

    def own(rows: pa.Table) -> pa.Table:
        rows = rows.append_column("i", pa.array(np.zeros(rows.num_rows, int))).append_column("j", pa.array(np.zeros(rows.num_rows, int))).append_column("second", pa.array(np.zeros(rows.num_rows, bool)))
        found = _nearest(rows, most, eps)
        number = rows["number"].to_numpy()
        order = np.argsort(number)
        place = order[np.searchsorted(number, found["number"].to_numpy(), sorter=order)]
        by = np.lexsort((found["other"].to_numpy(), found["d"].to_numpy(), place))
        count = np.bincount(place, minlength=len(number))
        ends = np.cumsum(count)
        far = found["d"].to_numpy()[by]
        bound = np.full(len(number), float(eps))
        bound[count >= most] = far[ends[count >= most] - 1]
        starts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        columns = [pa.ListArray.from_arrays(starts, pa.array(c, t.value_type)) for c, t in zip((far, found["other"].to_numpy()[by], found["w"].to_numpy()[by]), lists)]
        return pa.table({**{c: rows[c] for c in ("number", "x", "w", "lot")}, "bound": bound, "d": columns[0], "others": columns[1], "weights": columns[2]})

    first = dealt.withColumn("task", F.col("lot"))
    first = written(_tasks(first, lots, "task", own, "number long, x array<double>, w long, lot int, bound double, d array<double>, others array<long>, weights array<long>"))
    near = F.arrays_zip("d", F.col("others").alias("other"), F.col("weights").alias("w")).alias("near")
    points, ranked = first.select("number", "x", "w", "lot"), first.select("number", near)
    if lots > 1:
        boxes = _boxes(first, "lot", "bound")
        sent = _sent(first.select("number", "x", "w", "lot", "bound"), "lot", boxes, ~np.eye(lots, dtype=bool), np.array([boxes[i][3][0] for i in range(lots)]))
        sent = _paired(sent, F.col("lot"), "number", "x", "w", F.when(F.col("asks"), F.col("bound")).otherwise(-1.0).alias("bound"))
        more = _tasks(sent, _pairs(lots), "task", lambda rows: _nearest(rows, most, eps), "number long, other long, w long, d double")
        # A point has ``most`` candidates for each lot that it was sent to.
        more = more.groupBy("number").agg(F.collect_list(F.struct("d", "other", "w")).alias("more"))
        both = F.concat("near", F.coalesce("more", F.array().cast("array<struct<d: double, other: bigint, w: bigint>>")))
        ranked = ranked.join(more, "number", "left").select("number", F.slice(F.array_sort(both), 1, most).alias("near"))
    return points, written(ranked), lots


class _Links:
    """What one task holds of all points: core distances, nearest and links found since."""

    def __init__(self, rows: pa.Table, n: int, sizes: Sequence[int], eps: Sequence[float], most: int):
        known = rows.filter(pa.array(rows["known"].to_numpy(zero_copy_only=False)))
        number = known["number"].to_numpy()
        self.n, self.eps, self.sizes = n, np.array(eps), sizes
        self.cores = np.full((n, len(sizes)), np.inf)
        self.cores[number] = _matrix(known["cores"])
        count = np.diff(known["other"].combine_chunks().offsets.to_numpy())
        self.a, self.b, self.d = np.repeat(number, count), known["other"].combine_chunks().flatten().to_numpy(), known["d"].combine_chunks().flatten().to_numpy()
        #: From where on a point may have neighbours beside its nearest.
        self.full = np.full(n, len(eps))
        last = np.cumsum(count)[count >= most] - 1
        self.full[number[count >= most]] = np.searchsorted(self.eps, self.d[last], "left")
        found = rows.filter(pa.array(~rows["known"].to_numpy(zero_copy_only=False)))
        self.la, self.lb = found["number"].to_numpy(), found["other"].combine_chunks().flatten().to_numpy()
        self.reach = np.searchsorted(self.eps, found["d"].combine_chunks().flatten().to_numpy(), "left")

    def classes(self, k: int) -> Iterator[np.ndarray]:
        """For each eps the least point that each core is linked to."""
        level = np.searchsorted(self.eps, np.maximum(self.d, np.maximum(self.cores[self.a, k], self.cores[self.b, k])), "left")
        label = np.arange(self.n)
        for e in range(len(self.eps)):
            for a, b, at in ((self.a, self.b, level), (self.la, self.lb, self.reach)):
                _unite(label, a[at == e], b[at == e])
            yield label

    def open(self) -> pa.Table:
        """Points between which links may be missing, with their classes where these are several.

        A link that is not known has ends with neighbours beside their nearest, which are cores
        whatever ``min_pts``, and one of its ends lies outside the largest class.
        """
        seeds, is_open = np.full((self.n, len(self.eps)), -1), np.zeros(self.n, bool)
        for e, label in enumerate(self.classes(int(np.argmax(self.sizes)))):
            at = np.flatnonzero(self.full <= e)
            if len(at) and (label[at] != label[at[0]]).any():
                seeds[at, e] = label[at]
                is_open[at] |= label[at] != np.bincount(label[at]).argmax()
        at = np.flatnonzero((seeds >= 0).any(1))
        return pa.table({"number": at, "open": is_open[at], "seeds": pa.FixedSizeListArray.from_arrays(pa.array(seeds[at].ravel()), len(self.eps)).cast(pa.list_(pa.int64()))})

    def clusters(self, k: int) -> pa.Table:
        """For each point its cluster at each eps."""
        made = np.full((self.n, len(self.eps)), -1, np.int32)
        for e, label in enumerate(self.classes(k)):
            core = self.cores[:, k] <= self.eps[e]
            at = np.flatnonzero(core)
            made[at, e] = np.unique(label[at], return_inverse=True)[1]
            beside = np.flatnonzero(~core[self.a] & core[self.b] & (self.d <= self.eps[e]))
            least = np.full(self.n, self.n)
            np.minimum.at(least, self.a[beside], made[self.b[beside], e])
            at = self.a[beside]
            made[at, e] = least[at]
        return pa.table({"min_pts": np.full(self.n, self.sizes[k], np.int32), "number": np.arange(self.n), "clusters": pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), len(self.eps)).cast(pa.list_(pa.int32()))})


def _blocks(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of rows that lie together, at most so many each: halves along the widest column."""
    todo, done = [np.arange(len(x))] if len(x) else [], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            done.append(at)
            continue
        half, widest = len(at) // 2, np.ptp(x[at], axis=0).argmax()
        order = np.argpartition(x[at, widest], half)
        todo += [at[order[:half]], at[order[half:]]]
    return done


class _Side:
    """Points of a lot in blocks, of which each is open or closed in whole."""

    def __init__(self, rows: pa.Table, most: int):
        x, is_open = _matrix(rows["x"]), rows["open"].to_numpy(zero_copy_only=False)
        blocks = [at[own] for at in (np.flatnonzero(is_open), np.flatnonzero(~is_open)) for own in _blocks(x[at], most)]
        order, ends = np.concatenate(blocks), np.cumsum([0, *map(len, blocks)])
        self.x, self.seeds, self.starts = x[order], _matrix(rows["seeds"])[order], ends[:-1]
        self.blocks = [slice(a, b) for a, b in zip(ends, ends[1:])]
        self.open = is_open[order][self.starts]
        self.low, self.high = np.minimum.reduceat(self.x, self.starts), np.maximum.reduceat(self.x, self.starts)
        self.held = np.logical_or.reduceat(self.seeds >= 0, self.starts)


def _bridges(rows: pa.Table, eps: Sequence[float]) -> pa.Table:
    """Links between the classes of two lots' points, a forest for each eps.

    Blocks are looked at by how near their boxes are; those of one class are passed over, those
    whose boxes lie within eps are joined without a distance.
    """
    a, b = (_Side(own, NARROW if len(own["x"][0]) <= MOST_CELLS else TILE) if own.num_rows else None for own in _halves(rows))
    same = rows["i"][0] == rows["j"][0]
    b = a if same else b
    out: list[tuple[np.ndarray, ...]] = []
    if a and b:
        squares = _Squares(a.x, b.x, eps[0])
        gap, span = np.zeros((len(a.blocks), len(b.blocks))), np.zeros((len(a.blocks), len(b.blocks)))
        for la, ha, lb, hb in zip(a.low.T, a.high.T, b.low.T, b.high.T):
            gap += np.maximum(0, np.maximum(la[:, None] - hb, lb - ha[:, None])) ** 2
            span += np.maximum(ha[:, None] - lb, hb - la[:, None]) ** 2
        names, codes, labels = [], [], []
        for e in range(len(eps)):
            found, code = np.unique(np.concatenate([a.seeds[:, e], b.seeds[:, e]]), return_inverse=True)
            names.append(found), codes.append((code[: len(a.x)], code[len(a.x) :])), labels.append(np.arange(len(found)))
        limit = [far * far * (1 + MARGIN) for far in eps]
        todo = reduce(np.logical_or, (a.held[:, e][:, None] & b.held[:, e] & (gap <= limit[e]) for e in range(len(eps)))) & (a.open[:, None] | b.open)
        i, j = np.nonzero(np.triu(todo) if same else todo)
        order = np.lexsort((span[i, j], gap[i, j]))
        for p, q in zip(i[order], j[order]):
            r, c, tile = a.blocks[p], b.blocks[q], None
            for e in np.flatnonzero(a.held[p] & b.held[q]):
                if gap[p, q] > limit[e]:
                    continue
                label, in_r, in_c = labels[e], a.seeds[r, e] >= 0, b.seeds[c, e] >= 0
                own, other = codes[e][0][r][in_r], codes[e][1][c][in_c]
                main = label[own[0]]
                if (label[own] == main).all() and (label[other] == main).all():
                    continue
                if span[p, q] <= eps[e] ** 2 * (1 - MARGIN):
                    both = np.concatenate([own, other])
                    _unite(label, both, np.full(len(both), main))
                    continue
                if tile is None:
                    tile = squares(r, c)
                    least = np.fmin.reduce(tile, axis=1)
                high = eps[e] ** 2 + squares.slack
                at = np.flatnonzero(in_r & (least <= high))
                if not len(at):
                    continue
                part, own = tile[at], codes[e][0][r][at]
                part = part if in_c.all() else part[:, in_c]
                hit = part <= eps[e] ** 2 - squares.slack
                x, y = np.nonzero((part <= high) & ~hit)
                hit[x, y] = _exactly(a.x, b.x, at[x] + r.start, np.flatnonzero(in_c)[y] + c.start) <= eps[e]
                _join(label, hit, own, other)
        for e, far in enumerate(eps):
            moved = np.flatnonzero(labels[e] != np.arange(len(labels[e])))
            out.append((names[e][moved], names[e][labels[e][moved]], np.full(len(moved), far)))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "reach"])


def _grouped(counts: dict[int, int], lots: int, first: int) -> dict[int, int]:
    """Lots that follow each other as one up to LOT rows, numbered from ``first``."""
    made, held, now = {}, 0, first
    for lot in range(lots):
        n = counts.get(lot, 0)
        if held and held + n > LOT:
            now, held = now + 1, 0
        made[lot], held = now, held + n
    return made


def _joined(points: DataFrame, ranked: DataFrame, cores: DataFrame, n: int, lots: int, sizes: Sequence[int], eps: Sequence[float], most: int) -> DataFrame:
    """(min_pts, number, clusters) of up to ONE points, with a cluster for each eps.

    The links to a point's nearest join nearly all. Only between points with more neighbours, of
    which one lies outside the largest class, others are looked for: in each lot, then between lots.
    """
    held = ranked.join(cores, "number").select(F.lit(True).alias("known"), "number", "cores", F.col("near.other").alias("other"), F.col("near.d").alias("d"))
    schema, links = "a long, b long, reach double", None

    def given(task: Column) -> DataFrame:
        rows = held
        if links is not None:
            none = F.array().cast("array<double>")
            rows = rows.unionAll(links.select(F.lit(False), "a", none, F.array("b"), F.array("reach")))
        return rows.withColumn("task", task)

    for own in (True, False) if lots > 1 else (True,):
        opened = written(_tasks(given(F.lit(0)), 1, "task", lambda rows: _Links(rows, n, sizes, eps, most).open(), "number long, open boolean, seeds array<long>"))
        opened = written(points.join(opened, "number").select("number", "x", "lot", "open", "seeds"))
        counts = {(r["lot"], r["open"]): r["count"] for r in opened.groupBy("lot", "open").count().collect()}
        if not any(is_open for _, is_open in counts):
            break
        if own:
            sent = opened.withColumns({"i": F.lit(0), "j": F.lit(0), "second": F.lit(False), "task": F.col("lot")})
            found = _tasks(sent, lots, "task", lambda rows: _bridges(rows, eps), schema)
        else:
            s = _grouped({lot: c for (lot, is_open), c in counts.items() if is_open}, lots, 0)
            r = _grouped({lot: c for (lot, is_open), c in counts.items() if not is_open}, lots, max(s.values()) + 1)
            group = F.when(F.col("open"), F.array(*(F.lit(s[i]) for i in range(lots)))[F.col("lot")]).otherwise(F.array(*(F.lit(r[i]) for i in range(lots)))[F.col("lot")])
            groups = max(r.values()) + 1
            placed = written(opened.withColumns({"lot": group, "bound": F.lit(eps[-1])}))
            boxes = _boxes(placed, "lot")
            nowhere = np.full(len(boxes[0][1]), np.inf)
            boxes = {i: boxes.get(i, (0, nowhere, -nowhere, [])) for i in range(groups)}
            is_open = np.arange(groups) <= max(s.values())
            sent = _sent(placed, "lot", boxes, is_open[:, None] | is_open, np.full(groups, -np.inf))
            found = _tasks(_paired(sent, F.col("lot"), "number", "x", "open", "seeds"), _pairs(groups), "task", lambda rows: _bridges(rows, eps), schema)
        found = written(found)
        links = found if links is None else links.unionAll(found)
    each = F.explode(F.array(*(F.lit(i) for i in range(len(sizes)))))
    rows = given(each).withColumn("k", F.col("task"))
    make = lambda rows: _Links(rows, n, sizes, eps, most).clusters(rows["k"][0].as_py())
    return _tasks(rows, len(sizes), "task", make, "min_pts int, number long, clusters array<int>")


def dbscan_settings(points: DataFrame, key: str, columns: Sequence[str], eps: Sequence[float], min_pts: Sequence[int]) -> DataFrame:
    """(eps, min_pts, key, cluster) as dbscan() gives them, for all settings from two passes.

    With the distance to its ``min_pts``-th nearest point as a point's core distance, two cores
    are linked at every eps from the largest of their distance and core distances on. Equal
    points are one with a weight. Points are dealt to lots; a task compares two lots, tile by
    tile in single precision and exactly where that cannot tell, and keeps each point's nearest,
    so that rows grow with points and lots and not with pairs within eps. A point that is not
    core has fewer than ``min_pts`` neighbours, all among its nearest. Links are those to the
    nearest and what _joined() finds beside them; of over ONE points, forests of all pairs of
    lots, joined by settle().
    """
    most, levels, sizes = max(min_pts), sorted(map(float, eps)), sorted(min_pts)
    x = F.array(*(F.col(c).cast("double") for c in columns))
    keyed = points.select(F.col(key).alias("key"), x.alias("x"))
    usable = keyed.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    units = usable.groupBy("x").agg(F.min("key").alias("u"), F.count(F.lit(1)).alias("w"))
    units = written(numbered(units, ["u"]).select("x", "w", F.col("_position").alias("number")))
    keyed = written(keyed.join(units.select("x", "number"), "x", "left").select("key", "number"))
    n = units.count()
    if not n:
        settings = points.sparkSession.createDataFrame([(e, k) for e in levels for k in sizes], "eps double, min_pts int")
        return keyed.crossJoin(F.broadcast(settings)).select("eps", "min_pts", F.col("key").alias(key), F.lit(-1).alias("cluster"))
    dealt, ranked, lots = _near(units, n, most, levels[-1])
    each = F.flatten(F.transform("near", lambda p: F.array_repeat(p["d"], F.least(p["w"], F.lit(most)).cast("int"))))
    cores = ranked.select("number", each.alias("each")).select("number", F.array(*(F.coalesce(F.try_element_at("each", F.lit(k)), F.lit(float("inf"))) for k in sizes)).alias("cores"))
    if n <= ONE:
        found = written(_joined(dealt, ranked, cores, n, lots, sizes, levels, most))
        every = keyed.withColumn("min_pts", F.explode(F.array(*map(F.lit, sizes)))).join(found, ["number", "min_pts"], "left")
        own = F.arrays_zip(F.array(*map(F.lit, levels)).alias("eps"), F.coalesce("clusters", F.array_repeat(F.lit(-1), len(levels))).alias("cluster"))
        return every.select("min_pts", "key", F.explode(own).alias("c")).select("c.eps", "min_pts", F.col("key").alias(key), "c.cluster")
    full = _meet(dealt.join(cores, "number"), lots)
    forest = written(_tasks(full, _pairs(lots), "task", lambda rows: _forest(rows, sizes, levels), "min_pts int, a long, b long, reach double"))
    # A point has links of one length for each lot: all but one go on from the least point they lead to.
    ends = forest.select("min_pts", "reach", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("min_pts", "reach", "a").agg(F.collect_set("b").alias("b"))
    ends = ends.withColumn("m", F.array_min("b"))
    forest = ends.select("min_pts", "reach", F.explode(F.concat(F.array("a"), F.array_remove("b", F.col("m")))).alias("a"), F.col("m").alias("b")).distinct()
    spark, by = points.sparkSession, ["eps", "min_pts"]
    settings = F.broadcast(spark.createDataFrame([(e,) for e in levels], "eps double"))  # one row a setting
    links = forest.join(settings, F.col("reach") <= F.col("eps")).select(*by, "a", "b")
    core = cores.select("number", F.explode(F.arrays_zip(F.array(*(F.lit(k) for k in sizes)).alias("k"), F.col("cores").alias("d"))).alias("c"))
    core = written(core.join(settings, F.col("c.d") <= F.col("eps")).select("eps", F.col("c.k").alias("min_pts"), "number"))
    every = keyed.crossJoin(settings).withColumn("min_pts", F.explode(F.array(*map(F.lit, sizes))))
    if core.isEmpty():
        return every.select(*by, F.col("key").alias(key), F.lit(-1).alias("cluster"))
    edges = links.unionAll(core.select(*by, F.col("number").alias("a"), F.col("number").alias("b")))
    labels = settle(written(edges), by)
    heads = written(numbered(labels.select(*by, "label").distinct(), [*by, "label"]).select(*by, "label", "_position"))
    least = heads.groupBy(*by).agg(F.min("_position").alias("_least"))
    named = written(labels.join(heads, [*by, "label"]).join(least, by).select(*by, F.col("a").alias("number"), (F.col("_position") - F.col("_least")).cast("int").alias("cluster")))
    border = ranked.select("number", F.explode("near").alias("n")).join(settings, F.col("n.d") <= F.col("eps")).select("eps", F.col("number").alias("own"), F.col("n.other").alias("number"))
    reached = border.join(named, ["eps", "number"]).select(*by, F.col("own").alias("number"), "cluster").join(core, [*by, "number"], "left_anti")
    placed = named.unionAll(reached.groupBy(*by, "number").agg(F.min("cluster").alias("cluster")))
    return every.join(placed, [*by, "number"], "left").select(*by, F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
