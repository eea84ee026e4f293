"""DBSCAN by cells and by forest against brute force; what grows with dense groups."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster as K, density as N
from millrace.plans import clusters


def brute(points, eps, min_pts):
    near = {k: [j for j, q in points.items() if math.dist(p, q) <= eps] for k, p in points.items()}
    cores, label = {k for k, n in near.items() if len(n) >= min_pts}, {}
    for k in sorted(cores):
        if k not in label:
            todo = [k]
            while todo:
                i = todo.pop()
                if label.setdefault(i, k) == k:
                    todo += [j for j in near[i] if j in cores and j not in label]
    number = {root: i for i, root in enumerate(sorted(set(label.values())))}
    return {k: number[label[k]] if k in cores else min((number[label[j]] for j in near[k] if j in cores), default=-1) for k in points}


def frame(spark, points):
    dims = len(next(iter(points.values())))
    columns = [f"x{i}" for i in range(dims)]
    return spark.createDataFrame([(k, *p) for k, p in points.items()], "k int, " + ", ".join(f"{c} double" for c in columns)), columns


def blobs(n, dims, seed):
    rng = random.Random(seed)
    return {i: tuple(rng.gauss(i % 3 * 4 if d == 0 else 0, 0.6) for d in range(dims)) for i in range(n)} | {n + 10: (50.0,) * dims}


@pytest.mark.parametrize("dims,eps,min_pts", [(1, 0.2, 4), (2, 0.5, 4), (2, 1.3, 3), (5, 1.2, 4)])
def test_same_as_brute_force(spark, dims, eps, min_pts):
    points = blobs(120, dims, dims)
    df, columns = frame(spark, points)
    assert {r.k: r.cluster for r in N.dbscan(df, "k", columns, eps, min_pts).collect()} == brute(points, eps, min_pts)


def test_full_cells_that_only_just_touch(spark):
    """Cells whose nearest points to each other's middle are too far apart, but others are not."""
    left = {i: (0.05 * (i % 9), 0.69) if i < 9 else (0.0, 0.04 * (i - 9)) for i in range(27)}
    right = {100 + i: (0.97 + 0.04 * i, 0.69 - 0.03 * i) for i in range(9)}
    points = left | right
    df, columns = frame(spark, points)
    for eps in (0.5, 0.56, 0.58, 0.62, 0.9):
        assert {r.k: r.cluster for r in N.dbscan(df, "k", columns, eps, 4).collect()} == brute(points, eps, 4)


def test_equal_points_and_missing_coordinates(spark):
    points = {i: (1.0, 1.0) for i in range(1500)} | {2000 + i: (1.0 + 0.3 * i, 1.0) for i in range(6)}
    df, columns = frame(spark, points)
    wide = df.unionByName(spark.createDataFrame([(5000, None, 1.0), (5001, float("nan"), 1.0)], df.schema))
    want = brute({0: (1.0, 1.0), 1: (1.0, 1.0), 2: (1.0, 1.0), 3: (1.0, 1.0)} | {k: p for k, p in points.items() if k >= 2000}, 0.35, 3)
    found = {r.k: r.cluster for r in N.dbscan(wide, "k", columns, 0.35, 3).collect()}
    assert all(found[k] == want[min(k, 0) if k < 2000 else k] for k in points) and found[5000] == found[5001] == -1
    assert N.dbscan(df.limit(0), "k", columns, 0.35, 3).count() == 0
    assert {r.cluster for r in N.dbscan(df.where("k >= 2000"), "k", columns, 0.001, 4).collect()} == {-1}


@pytest.mark.parametrize("lot", [1000, 30])
def test_all_settings_same_as_one(spark, monkeypatch, lot):
    monkeypatch.setattr(N, "LOT", lot)
    points = blobs(100, 3, 8) | {300: (0.0, 0.0, 0.0), 301: (0.0, 0.0, 0.0)}
    df, columns = frame(spark, points)
    made = N.dbscan_settings(df, "k", columns, [0.3, 0.6, 0.9], [2, 3, 5]).collect()
    for eps in (0.3, 0.6, 0.9):
        for min_pts in (2, 3, 5):
            assert {r.k: r.cluster for r in made if (r.eps, r.min_pts) == (eps, min_pts)} == brute(points, eps, min_pts), (eps, min_pts)


def test_settings_of_nothing(spark):
    df, columns = frame(spark, {1: (0.0,), 2: (9.0,)})
    assert {(r.k, r.cluster) for r in N.dbscan_settings(df, "k", columns, [0.5], [2]).collect()} == {(1, -1), (2, -1)}
    assert N.dbscan_settings(df.limit(0), "k", columns, [0.5], [2]).count() == 0


def test_many_columns_are_compared_by_lots(spark, monkeypatch):
    """Nothing is spread over cells, which of many columns hold single points only."""
    monkeypatch.setattr(N, "product", None)
    monkeypatch.setattr(N, "LOT", 50)
    rng = random.Random(5)
    points = {i: tuple(rng.gauss(i % 3, 0.5) for _ in range(20)) for i in range(150)}
    points |= {300 + i: points[i] for i in range(20)} | {400: (1e9,) * 20}
    df, columns = frame(spark, points)
    for eps, min_pts in ((2.4, 3), (2.8, 4)):
        assert {r.k: r.cluster for r in N.dbscan(df, "k", columns, eps, min_pts).collect()} == brute(points, eps, min_pts)


@pytest.mark.parametrize("far", [1.0, 1e7])
def test_tasks_keep_the_nearest_and_a_forest(monkeypatch, far):
    monkeypatch.setattr(N, "TILE", 70)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(240, 6)), np.repeat(rng.normal(size=(1, 6)), 160, 0) + rng.normal(size=(160, 6)) * 1e-6])
    x[3] *= far
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    sizes, eps, n = [2, 4], [0.5, 1.0, 1.5], len(x)
    cores = np.sort(d, axis=1)[:, [1, 3]]
    order = rng.permutation(n)
    for a, b in ((order[:250], order[250:]), (order, order[:0])):
        ids, two = np.concatenate([a, b]), len(b) > 0
        lists = lambda v: pa.array(v[ids].tolist(), pa.list_(pa.float64()))  # noqa: B023, E731
        rows = pa.table({"number": ids, "x": lists(x), "w": np.ones(n, int), "cores": lists(cores), "i": np.zeros(n, int), "j": np.full(n, int(two)), "second": np.isin(ids, b)})
        want = {(p, q) for own, others in ([(a, b), (b, a)] if two else [(a, a)]) for p in own for q in others[np.lexsort((others, d[p, others]))[:4]] if d[p, q] <= 1.5}
        made = N._nearest(rows, 4, 1.5)
        assert set(zip(made["number"].to_pylist(), made["other"].to_pylist())) == want
        made = N._forest(rows, sizes, eps)
        assert made.num_rows <= 2 * (n - 1)
        p, q, size, reach = (made[c].to_numpy() for c in ("a", "b", "min_pts", "reach"))
        for k, e in ((k, e) for k in range(2) for e in eps):
            link, core = d <= e, cores[:, k] <= e
            if two:
                link = link & (np.isin(np.arange(n), a)[:, None] != np.isin(np.arange(n), a))
            classes = [np.arange(n), np.arange(n)]
            N._unite(classes[0], *np.nonzero(link & core[:, None] & core))
            use = (size == sizes[k]) & (reach <= e)
            N._unite(classes[1], p[use], q[use])
            assert (classes[0] == classes[1]).all()


@pytest.mark.parametrize("dims,one", [(2, 1 << 20), (10, 1 << 20), (2, 0)])
def test_groups_that_their_nearest_do_not_join(spark, monkeypatch, dims, one):
    """Groups of more points than a point keeps, in several lots: their links are found beside the nearest."""
    monkeypatch.setattr(N, "LOT", 40)
    monkeypatch.setattr(N, "ONE", one)
    rng = random.Random(dims)
    points = {g * 20 + i: (g % 5 * 0.5 + rng.random() * 0.1, g // 5 * 0.8 + rng.random() * 0.1, *(rng.random() * 0.05 for _ in range(dims - 2))) for g in range(15) for i in range(9)}
    points |= {1000: points[0], 1001: (9.0,) * dims}
    df, columns = frame(spark, points)
    eps, sizes = [0.2, 0.42, 0.5, 0.75], [2, 4]
    made = N.dbscan_settings(df, "k", columns, eps, sizes).collect()
    assert len(made) == len(points) * len(eps) * len(sizes)
    for e in eps:
        for k in sizes:
            assert {r.k: r.cluster for r in made if (r.eps, r.min_pts) == (e, k)} == brute(points, e, k), (e, k)


@pytest.mark.parametrize("dims,two", [(2, True), (2, False), (12, True), (12, False)])
def test_bridges_join_the_classes_that_links_join(monkeypatch, dims, two):
    monkeypatch.setattr(N, "NARROW", 7)
    monkeypatch.setattr(N, "TILE", 16)
    rng, n, eps = np.random.default_rng(dims), 240, [0.15, 0.3, 3.0]
    x = np.concatenate([rng.integers(0, 5, (n, 2)) * 0.5 + rng.random((n, 2)) * 0.25, rng.random((n, dims - 2)) * 0.02], axis=1)
    is_open, since = rng.random(n) < 0.6, rng.integers(0, 4, n)
    seeds = np.where(since[:, None] <= np.arange(3), np.where(is_open, np.arange(n) // 2 * 2 + 1000, 0)[:, None], -1)
    lists = lambda v, t: pa.array(v.tolist(), pa.list_(t))
    second = np.arange(n) >= (n // 2 if two else n)
    rows = {"number": np.arange(n), "x": lists(x, pa.float64()), "open": is_open, "seeds": lists(seeds, pa.int64()), "i": np.zeros(n, int), "j": np.full(n, int(two)), "second": second}
    made = N._bridges(pa.table(rows), eps)
    a, b, reach = (made[c].to_numpy() for c in ("a", "b", "reach"))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for e, far in enumerate(eps):
        link = (d <= far) & (seeds[:, e] >= 0)[:, None] & (seeds[:, e] >= 0) & (is_open[:, None] | is_open)
        if two:
            link = link & (second[:, None] != second)
        want, found = np.arange(2000), np.arange(2000)
        i, j = np.nonzero(link)
        N._unite(want, seeds[i, e], seeds[j, e])
        N._unite(found, a[reach == far], b[reach == far])
        assert (want == found).all() and (reach == far).sum() < len(np.unique(seeds[:, e]))


def test_points_go_to_lots_only_as_near_as_their_nearest(spark, monkeypatch):
    """What a task compares does not grow with the square of the points of few columns."""
    monkeypatch.setattr(N, "LOT", 500)
    rng = np.random.default_rng(3)
    x = rng.random((8000, 2))
    units = spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(x)], "number long, x array<double>, w long")
    sent, plain = [], N._sent
    monkeypatch.setattr(N, "_sent", lambda *a: sent.append(plain(*a).count()) or plain(*a))
    points, near, lots = N._near(units, len(x), 4, 1.4)
    assert lots >= 16 and sent[0] < 2 * len(x)  # of 8000 * (lots - 1) rows
    for r in near.where("number % 400 = 0").collect():
        d = np.sqrt(((x[r.number] - x) ** 2).sum(1))
        assert [n.other for n in r.near] == np.argsort(d)[:4].tolist()
    # Two lots of one class each at every eps are not compared, nor are points that only others ask.
    cells = []
    made = N._Squares.__call__
    monkeypatch.setattr(N._Squares, "__call__", lambda self, r, c: cells.append((r.stop - r.start) * (c.stop - c.start)) or made(self, r, c))
    n, lists = 4000, lambda v, t: pa.array(v.tolist(), pa.list_(t))
    common = {"number": np.arange(n), "x": lists(x[:n], pa.float64()), "i": np.zeros(n, int), "j": np.ones(n, int), "second": np.arange(n) >= n // 2}
    N._bridges(pa.table(common | {"open": np.ones(n, bool), "seeds": lists(np.zeros((n, 2), int), pa.int64())}), [0.1, 0.2])
    assert not cells
    N._nearest(pa.table(common | {"w": np.ones(n, int), "bound": np.where(np.arange(n) == 7, 0.1, -1.0)}), 4, 1.4)
    assert sum(cells) <= 512 * n // 2


@pytest.mark.parametrize("dims,lot,block", [(1, 1000, 8), (2, 1000, 8), (2, 10, 2), (4, 30, 5)])
def test_neighbours_are_counted_as_from_all_pairs(spark, monkeypatch, dims, lot, block):
    monkeypatch.setattr(K, "NEAR_LOT", lot)
    monkeypatch.setattr(K, "BLOCK", block)
    points = blobs(120, dims, 4) | {300 + i: (0.25 * i,) * dims for i in range(9)} | {500 + i: (0.5,) * dims for i in range(3)}
    df, columns = frame(spark, points)
    df = df.unionAll(spark.createDataFrame([(900, *[None] * dims), (901, *[float("nan")] * dims)], df.schema))
    for eps in (0.25, 1.0, 30.0):
        want = {k: [j for j, q in points.items() if math.dist(p, q) <= eps] for k, p in points.items()}
        made = {r.k: (r.n, r.last) for r in K.neighbour_counts(df, "k", columns, eps).collect()}
        assert made == {k: (len(near), max(near)) for k, near in want.items()}
    assert K.neighbour_counts(df.limit(0), "k", columns, 1.0).count() == 0


def test_no_pairs_are_made_of_suppliers_that_lie_together(spark, tmp_path):
    """200,000 suppliers at four places: 2.5e10 pairs, of which none is a row."""
    key = F.col("id")
    made = spark.range(200_000).select(key.alias("s_suppkey"), (key % 2).cast("int").alias("s_nationkey"), (key % 4 * 1000.0).alias("s_acctbal"))
    made.write.parquet(f"{tmp_path}/supplier.parquet")
    found = clusters.neighbours(spark, str(tmp_path)).groupBy("n", "last").agg(F.count("*").alias("rows")).collect()
    assert sorted(map(tuple, found)) == [(100_000, 199_997, 50_000), (100_000, 199_999, 50_000), (150_000, 199_998, 50_000), (150_000, 199_999, 50_000)]
