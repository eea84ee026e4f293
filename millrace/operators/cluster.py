"""Clusters: neighbours, silhouettes, tiers, scoring, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product
from math import ceil
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .checkpoints import written
from .columns import as_column

#: Points of a lot of an exact silhouette, two of which meet in a task, and of a side of a tile.
LOT, TILE = 16_000, 512
#: Sums that a task may hold for a lot, one for each point and cluster.
SUMS = 1 << 23
#: Lots that fewer points are dealt to, so that tasks share the work, and the least points of such a lot.
SPREAD, LEAST = 10, 500
#: Different points of a lot whose neighbours are counted, and of a block of it.
NEAR_LOT, BLOCK = 32_000, 64


def distance(columns: Sequence[str], a: str = "a", b: str = "b") -> Column:
    return F.sqrt(reduce(add, (F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(2.0)) for c in columns)))


def neighbours(points: DataFrame, key: str, columns: Sequence[str], eps: float) -> DataFrame:
    """(a, b) keys of all ordered pairs within ``eps``, a point with itself included.

    For points of which few lie within ``eps``, as its rows are those pairs; density.dbscan makes
    none inside a dense cell and neighbour_counts() none at all. Points meet in grid cells of side ``eps`` on up to three columns, so the join has an equal
    key and only neighbouring cells are compared.
    """
    grid = columns[: min(3, len(columns))]
    cell = [F.floor(F.col(c) / eps).alias(f"_g{i}") for i, c in enumerate(grid)]
    placed = points.select(key, *columns, *cell)
    near = F.array(*(F.struct(*(F.lit(d).alias(f"s{i}") for i, d in enumerate(step))) for step in product((-1, 0, 1), repeat=len(grid))))
    spread = placed.withColumn("_s", F.explode(near)).withColumns({f"_g{i}": F.col(f"_g{i}") + F.col(f"_s.s{i}") for i in range(len(grid))}).drop("_s")
    keys = [f"_g{i}" for i in range(len(grid))]
    left, right = spread.alias("a"), placed.alias("b")
    same = reduce(Column.__and__, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    return left.join(right, same).where(distance(columns) <= eps).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    """Places of rows that lie together, at most BLOCK each: halves along the widest column."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            done.append(at)
            continue
        own = x[at]
        order, half = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], len(at) // 2), len(at) // 2
        todo += [at[order[:half]], at[order[half:]]]
    return done


def _counted(left: pa.Table, right: pa.Table, columns: Sequence[str], eps: float) -> pa.Table:
    """Of each left point the weights of the right ones within ``eps`` and their largest key.

    A block of right points whose box is within ``eps`` of a left block's box adds its totals;
    points are compared where a box is neither wholly within nor wholly beyond.
    """
    n, last = np.zeros(left.num_rows, np.int64), np.full(left.num_rows, np.iinfo(np.int64).min)
    if left.num_rows and right.num_rows:
        a, b = (np.array([side[c].to_numpy() for c in columns], float).T for side in (left, right))
        blocks = _blocks(b)
        order, starts = np.concatenate(blocks), np.cumsum([0, *map(len, blocks)])
        b, w, top = b[order], right["w"].to_numpy()[order], right["last"].to_numpy()[order]
        low, high = np.minimum.reduceat(b, starts[:-1]), np.maximum.reduceat(b, starts[:-1])
        total, most = np.add.reduceat(w, starts[:-1]), np.maximum.reduceat(top, starts[:-1])
        for at in _blocks(a):
            own = a[at]
            least, greatest = own.min(0), own.max(0)
            gap = (np.maximum(0, np.maximum(low - greatest, least - high)) ** 2).sum(1)
            span = (np.maximum(high - least, greatest - low) ** 2).sum(1)
            whole = span <= eps * eps * (1 - 1e-9)
            if whole.any():
                n[at] += total[whole].sum()
                last[at] = np.maximum(last[at], most[whole].max())
            for k in np.flatnonzero(~whole & (gap <= eps * eps * (1 + 1e-9))):
                part = slice(starts[k], starts[k + 1])
                far = np.zeros((len(at), part.stop - part.start))
                for x, y in zip(own.T, b[part].T):
                    far += (x[:, None] - y) ** 2
                hit = np.sqrt(far) <= eps
                n[at] += hit @ w[part]
                last[at] = np.maximum(last[at], np.where(hit, top[part], np.iinfo(np.int64).min).max(1))
    found = n > 0
    return pa.table({**{c: left[c].to_numpy()[found] for c in columns}, "n": n[found], "last": last[found]})


def neighbour_counts(points: DataFrame, key: str, columns: Sequence[str], eps: float) -> DataFrame:
    """(key, n, last): how many points lie within ``eps`` of each, itself counted, and the largest
    whole-numbered key of them. Points without one of their coordinates have no row.

    What neighbours() makes as pairs is only counted: equal points are one with a weight and
    their largest key, and points meet in cells of side ``eps`` on up to three columns, where
    blocks of them are counted in whole. Cells of many points are dealt to lots that meet in pairs.
    """
    q = [f"q{i}" for i in range(len(columns))]
    grid = [f"g{i}" for i in range(min(3, len(columns)))]
    keyed = points.select(F.col(key).cast("long").alias("key"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, q)))
    keyed = keyed.where(reduce(Column.__and__, (F.col(n).isNotNull() & ~F.isnan(n) for n in q)))
    units = keyed.groupBy(*q).agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("w"))
    side = eps * (1 + 1e-9)  # so that rounding puts no two neighbours two cells apart
    units = written(units.withColumns({g: F.floor(F.col(n) / side) for g, n in zip(grid, q)}))
    lots = written(units.groupBy(*grid).agg(F.ceil(F.count(F.lit(1)) / NEAR_LOT).cast("int").alias("lots")))
    near = F.array(*(F.struct(*(F.lit(s).alias(g) for s, g in zip(shift, grid))) for shift in product((-1, 0, 1), repeat=len(grid))))
    # A point as the left one meets the cells beside its own; its lot is that of its own cell.
    own = units.join(lots, grid).withColumn("i", F.pmod(F.xxhash64(*q), F.col("lots")).cast("int"))
    cell, met, other = [F.col(g).alias(f"c{g}") for g in grid], [f"c{g}" for g in grid], F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
    sent = own.select("i", *q, *cell, F.explode(near).alias("s"), *grid)
    sent = sent.withColumns({g: F.col(g) + F.col(f"s.{g}") for g in grid}).drop("s").join(lots, grid).withColumn("j", other).drop("lots")
    beside = lots.select(*(F.col(g).alias(f"c{g}") for g in grid), F.col("lots").alias("all"), F.explode(near).alias("s"), *grid)
    beside = beside.select(*met, "all", *((F.col(g) + F.col(f"s.{g}")).alias(g) for g in grid))
    right = own.withColumnRenamed("i", "j").drop("lots").join(beside, grid).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).drop("all")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both sides come from one table
    pair = [*met, *grid, "i", "j"]
    counted = sent.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(lambda a, b: _counted(a, b, q, eps), ", ".join(f"{n} double" for n in q) + ", n long, last long")
    found = written(counted.groupBy(*q).agg(F.sum("n").alias("n"), F.max("last").alias("last")))
    each = keyed.join(found, q).groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return each.withColumnRenamed("key", key)


def _leave_out_own(count: np.ndarray, sums: np.ndarray, keys: pa.Array, x: np.ndarray, code: np.ndarray) -> None:
    """Takes each row itself, and rows that have its key too, off its counts and sums."""
    names = keys.dictionary_encode().indices.to_numpy()
    repeated = np.bincount(names)[names] > 1
    count[np.flatnonzero(~repeated), code[~repeated]] -= 1
    for at in np.flatnonzero(repeated):
        own = np.flatnonzero(names == names[at])
        np.subtract.at(count[at], code[own], 1)
        np.subtract.at(sums[at], code[own], np.sqrt(((x[own] - x[at]) ** 2).sum(1)))


def _to_clusters(rows: pa.Table, key: str) -> pa.Table:
    """Of each point of two lots the sum of distances to each cluster of the other lot, and how
    many points these are, itself left out."""
    rows = rows.combine_chunks()
    second = rows["second"].to_numpy()
    names = rows["cluster"].combine_chunks().dictionary_encode()
    code = names.indices.to_numpy()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    same = rows["i"][0] == rows["j"][0]
    # Rows of each side by cluster, so that a cluster's are one run.
    sides = [at[np.argsort(code[at], kind="stable")] for at in (np.flatnonzero(~second), np.flatnonzero(second))]
    if same:
        sides[1] = sides[0]
    n = [np.bincount(code[at], minlength=len(names.dictionary)) for at in sides]
    sums = [np.zeros((len(at), len(names.dictionary))) for at in sides]
    steps = [[slice(k, min(k + TILE, len(at))) for k in range(0, len(at), TILE)] for at in sides]
    runs = [[np.flatnonzero(np.diff(code[at[r]], prepend=-1)) for r in own] for at, own in zip(sides, steps)]
    for r, firsts_r in zip(steps[0], runs[0]):
        a = x[sides[0][r]]
        for c, firsts_c in zip(steps[1], runs[1]):
            b = x[sides[1][c]]
            far = np.zeros((len(a), len(b)))
            for u, v in zip(a.T, b.T):
                gap = u[:, None] - v
                gap *= gap
                far += gap
            np.sqrt(far, out=far)
            sums[0][r, code[sides[1][c]][firsts_c]] += np.add.reduceat(far, firsts_c, axis=1)
            if not same:
                sums[1][c, code[sides[0][r]][firsts_r]] += np.add.reduceat(far, firsts_r, axis=0).T
    made = []
    for one, other in ([(0, 0)] if same else [(0, 1), (1, 0)]):
        count = np.broadcast_to(n[other], sums[one].shape).copy()
        if same:
            _leave_out_own(count, sums[0], rows[key].combine_chunks().take(pa.array(sides[0])), x[sides[0]], code[sides[0]])
        i, j = np.nonzero(count)
        at = pa.array(sides[one][i])
        made.append(pa.table({key: rows[key].take(at), "cluster": rows["cluster"].take(at), "other": names.dictionary.take(pa.array(j)), "d": sums[one][i, j], "n": count[i, j]}))
    return pa.concat_tables(made)


def silhouette(points: DataFrame, key: str, cluster: str, columns: Sequence[str], noise: object = -1) -> DataFrame:
    """(key, cluster, silhouette) by Euclidean distances between all pairs of different keys.

    Noise is left out first; a point alone in its cluster has 0; one cluster alone gives nulls.
    A point without one of its coordinates is compared with none. Points are dealt to lots; a task
    compares two lots, tile by tile, and returns each point's sums by cluster, so that rows grow
    with points, lots and clusters. The time grows with the square of the points; silhouette_squared
    needs each cluster's sums only.
    """
    whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
    used = points.where((F.col(cluster) != F.lit(noise)) & F.col(key).isNotNull()).select(key, F.col(cluster).alias("cluster"), F.when(whole, F.array(*(F.col(c).cast("double") for c in columns))).alias("x"))
    n, clusters = used.agg(F.count(F.lit(1)), F.approx_count_distinct("cluster")).first()
    lots = max(1, ceil(n / LOT), ceil(n * clusters / SUMS), min(SPREAD, ceil(n / LEAST)))
    dealt = used.where("x is not null").withColumn("lot", F.pmod(F.xxhash64(key), F.lit(lots)).cast("int"))
    sent = dealt.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    sent = sent.select(key, "cluster", "x", F.least("lot", "_to").alias("i"), F.greatest("lot", "_to").alias("j"), (F.col("_to") < F.col("lot")).alias("second"))
    kinds = {f.name: f.dataType.simpleString() for f in used.schema}
    schema = f"`{key}` {kinds[key]}, cluster {kinds['cluster']}, other {kinds['cluster']}, d double, n long"
    sums = sent.repartition(lots * (lots + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(lambda rows: _to_clusters(rows, key), schema)
    means = sums.groupBy(key, "cluster", "other").agg((F.sum("d") / F.sum("n")).alias("d"))
    scored = means.groupBy(key, "cluster").agg(F.min(F.when(F.col("other") == F.col("cluster"), F.col("d"))).alias("own"), F.min(F.when(F.col("other") != F.col("cluster"), F.col("d"))).alias("next"))
    value = F.when(F.col("next").isNull(), F.lit(None)).when(F.col("own").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("next") - F.col("own"), F.greatest("next", "own")), F.lit(0.0)))
    # A point that is alone has no pair, and so no row.
    return used.where(F.lit(n > 1)).select(key, "cluster").distinct().join(scored, [key, "cluster"], "left").select(key, "cluster", value.alias("silhouette"))


def silhouette_squared(points: DataFrame, key: str, cluster: str, columns: Sequence[str], noise: object = -1, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, cluster, silhouette) by squared Euclidean distances, from each cluster's sums.

    The squared distances from x to a cluster's n points add up to n |x|^2 - 2 x . sum + sum of
    squares, so a point meets each cluster once and no pair of points is made. Noise, lone
    points and one cluster alone are as in silhouette(). ``by`` tells several clusterings of
    the same points apart.
    """
    used = points.where(F.col(cluster) != F.lit(noise)).select(*by, key, F.col(cluster).alias("cluster"), *columns)
    square = lambda of: reduce(add, (F.col(f"{of}{c}") * F.col(f"{of}{c}") for c in columns))
    clusters = used.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("cluster").alias("_other")).agg(F.count(F.lit(1)).alias("_n"), F.sum(square("")).alias("_square"), *(F.sum(c).alias(f"_sum_{c}") for c in columns))
    # one row a cluster
    met = used.join(F.broadcast(clusters), reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.lit(True)))
    dot = reduce(add, (F.col(c) * F.col(f"_sum_{c}") for c in columns))
    total = F.greatest(F.lit(0.0), F.col("_n") * square("") - 2 * dot + F.col("_square"))
    own = F.col("_other") == F.col("cluster")
    scored = met.groupBy(*by, key, "cluster").agg(F.min(F.when(own, F.try_divide(total, F.col("_n") - 1))).alias("own"), F.min(F.when(~own, total / F.col("_n"))).alias("next"))
    value = F.when(F.col("next").isNull(), F.lit(None)).when(F.col("own").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("next") - F.col("own"), F.greatest("next", "own")), F.lit(0.0)))
    return scored.select(*by, key, "cluster", value.alias("silhouette"))


def assign_tiers(df: DataFrame, cluster: str, score: Column, tiers: Sequence[str], noise: object | None = None) -> DataFrame:
    """Tier names to clusters by ascending mean score, ties by cluster; noise is its own tier.

    More clusters than tiers is an error, raised when the rows are made.
    """
    valid = df if noise is None else df.where(F.col(cluster) != F.lit(noise))
    means = valid.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.avg(score).alias("_m"))
    place = F.row_number().over(Window.orderBy("_m", cluster))
    named = means.withColumn("_i", place).select(cluster, F.when(F.col("_i") <= len(tiers), F.element_at(F.array(*map(F.lit, tiers)), F.least(F.col("_i"), F.lit(len(tiers))))).otherwise(F.raise_error(F.lit("more clusters than tiers"))).alias("tier"))
    joined = df.join(named, cluster, "left")
    return joined if noise is None else joined.withColumn("tier", F.when(F.col(cluster) == F.lit(noise), "Noise").otherwise(F.col("tier")))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to mean 0 and population deviation 1; a constant column becomes 0."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


def centroid_distance(df: DataFrame, key: str, columns: Sequence[str], out: str = "distance") -> DataFrame:
    """Euclidean distance to the group's mean over scaled columns."""
    means = df.groupBy(key).agg(*(F.avg(c).alias(f"_c_{c}") for c in columns))
    far = F.sqrt(reduce(add, (F.pow(F.col(c) - F.col(f"_c_{c}"), F.lit(2.0)) for c in columns)))
    return df.join(means, key).withColumn(out, far).select(*df.columns, out)


def score(df: DataFrame, centroids: Mapping[str, Sequence[float]], columns: Sequence[str], version: str) -> DataFrame:
    """Nearest centroid's name, confidence by the two nearest distances, and the model version."""
    spots = [F.struct(F.sqrt(reduce(add, (F.pow(as_column(c) - x, F.lit(2.0)) for c, x in zip(columns, xs)))).alias("d"), F.lit(name).alias("name")) for name, xs in centroids.items()]
    near = F.array_sort(F.array(*spots))
    sure = 1 - near[0]["d"] / (near[0]["d"] + near[1]["d"] + 1e-12)
    return df.withColumns({"tier": near[0]["name"], "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), "model_version": F.lit(version)})


def validate(df: DataFrame, rules: Mapping[str, tuple[str, float | None, float | None]]) -> DataFrame:
    """All rows with ``reasons``: empty for a valid row.

    A rule is (type, least, greatest); a column's value is missing, of a wrong type, too low
    or too high.
    """
    reasons = []
    for c, (kind, low, high) in rules.items():
        value = F.col(c).try_cast(kind)
        test = F.when(F.col(c).isNull(), F.lit(f"{c}: missing")).when(value.isNull(), f"{c}: not {kind}")
        if low is not None:
            test = test.when(value < low, f"{c}: below {low:g}")
        if high is not None:
            test = test.when(value > high, f"{c}: above {high:g}")
        reasons.append(test)
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def stability(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, modal, agreement): the commonest label over runs, the smaller on ties, and its share."""
    counts = labels.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("modal"), (F.max("n") / F.sum("n")).alias("agreement"))
