"""K-means for many settings at once: every round is one scan of the points for all of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that starting centres are drawn from; points have centres of all rows from then on.
SAMPLE_ROWS = 2000
ROUNDS, SETTLED = 50, 1e-9


class Setting(NamedTuple):
    """One run: its columns, number of clusters and seed."""

    variant: str
    k: int
    seed: int


Centres = dict[Setting, np.ndarray]


def _points(df: DataFrame, variants: Mapping[str, Sequence[str]], key: str | None = None) -> tuple[DataFrame, dict[str, list[int]]]:
    """Complete rows with all columns of the variants once, and where each variant's stand."""
    columns = list(dict.fromkeys(c for cs in variants.values() for c in cs))
    rows = df.select(*([F.col(key).cast("long").alias("key")] if key else []), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).dropna()
    return rows, {v: [columns.index(c) for c in cs] for v, cs in variants.items()}


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first on ties, and the squared distance to it."""
    away = np.empty((len(centres), len(x)))
    # A centre at a time over whole columns: the inner sum over a few coordinates is what costs.
    for total, centre in zip(away, centres):
        total[:] = _sum_of_squares(x, centre)
    at = away.argmin(0)
    return at, away[at, np.arange(len(x))]


def _sum_of_squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for column, middle in zip(x.T, centre):
        gap = column - middle
        gap *= gap
        total += gap
    return total


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Columns from ``first`` on, each in one piece of memory."""
    return np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)], float).T


def starts(df: DataFrame, key: str, variants: Mapping[str, Sequence[str]], ks: Sequence[int], seeds: Sequence[int]) -> Centres:
    """Starting centres by k-means++ on SAMPLE_ROWS rows, those of the least hashes of ``key``.

    The sample is what goes to the driver, whatever the number of points. Of fewer different
    rows than k a setting has as many centres as there are.
    """
    rows, at = _points(df.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS), variants)
    sample = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, len(rows.columns))
    found: Centres = {}
    for variant, columns in at.items():
        x = np.unique(sample[:, columns], axis=0)
        for seed in seeds:
            for k in ks:
                rng, chosen = np.random.default_rng([seed, k]), []
                for _ in range(min(k, len(x))):
                    weight = _nearest(x, np.array(chosen))[1] if chosen else np.ones(len(x))
                    chosen.append(x[rng.choice(len(x), p=weight / weight.sum())])
                found[Setting(variant, k, seed)] = np.array(chosen).reshape(-1, len(columns))
    return found


def _step(rows: DataFrame, at: Mapping[str, Sequence[int]], centres: Centres) -> dict[int, dict[int, tuple[float, ...]]]:
    """By setting and cluster: n, squared distances, sum of squares, sums of the coordinates.

    A partition gives one row a cluster; they are added up by Spark and one row a cluster
    comes to the driver.
    """
    order = list(centres)
    widest = max(len(c) for c in at.values())

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            whole = _matrix(batch, 0)
            for i in range(0, len(whole), 4096):
                for s, setting in enumerate(order):
                    x = whole[i : i + 4096, at[setting.variant]]
                    own, away = _nearest(x, centres[setting])
                    made = np.zeros((len(centres[setting]), 3 + widest))
                    of = lambda weights: np.bincount(own, weights, len(made))  # noqa: B023, E731
                    made[:, 0], made[:, 1], made[:, 2] = of(None), of(away), of(_sum_of_squares(x, np.zeros(x.shape[1])))
                    for k, column in enumerate(x.T):
                        made[:, 3 + k] = of(column)
                    for c in np.flatnonzero(made[:, 0]):
                        held[s, int(c)] = held.get((s, int(c)), 0) + made[c]
        for (s, c), made in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([c], pa.int32()), *(pa.array([v]) for v in made)], names=["s", "c", *(f"v{i}" for i in range(len(made)))])

    schema = "s int, c int, " + ", ".join(f"v{i} double" for i in range(3 + widest))
    sums = rows.mapInArrow(run, schema).groupBy("s", "c").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(3 + widest)))
    found: dict[int, dict[int, tuple[float, ...]]] = {}
    for r in sums.collect():
        found.setdefault(r["s"], {})[r["c"]] = tuple(r)[2:]
    return found


def fit(df: DataFrame, variants: Mapping[str, Sequence[str]], centres: Centres, rounds: int = ROUNDS) -> Centres:
    """Centres after Lloyd rounds, at most ``rounds``: one scan a round for all settings.

    Settings whose centres no longer move are left out of the next scan. A cluster without
    points keeps its centre. Rows with a null in a column take no part.
    """
    rows, at = _points(df, variants)
    centres, open_ = dict(centres), {s for s, c in centres.items() if len(c)}
    for _ in range(rounds):
        if not open_:
            break
        now = {s: centres[s] for s in centres if s in open_}
        found = _step(rows, at, now)
        for i, setting in enumerate(now):
            new = centres[setting].copy()
            for c, sums in found.get(i, {}).items():
                new[c] = np.array(sums[3 : 3 + new.shape[1]]) / sums[0]
            if np.abs(new - centres[setting]).max() <= SETTLED:
                open_.discard(setting)
            centres[setting] = new
    return centres


def score(df: DataFrame, variants: Mapping[str, Sequence[str]], centres: Centres) -> DataFrame:
    """(variant, k, seed, n_clusters, inertia, silhouette) of each setting, from two scans.

    The silhouette is the mean by squared distances, made from each cluster's sums: a point meets
    the clusters of a setting, not other points. It is null for one cluster alone.
    """
    rows, at = _points(df, variants)
    usable = {s: c for s, c in centres.items() if len(c)}
    sums, order = _step(rows, at, usable), list(usable)

    def run(batches):
        held = np.zeros((len(order), 2))
        for batch in batches:
            whole = _matrix(batch, 0)
            for i in range(0, len(whole), 4096):
                for s, setting in enumerate(order):
                    clusters = sums.get(s, {})
                    if len(clusters) < 2:
                        continue
                    x = whole[i : i + 4096, at[setting.variant]]
                    names = sorted(clusters)
                    n, square = (np.array([clusters[c][j] for c in names]) for j in (0, 2))
                    total = np.array([clusters[c][3 : 3 + x.shape[1]] for c in names])
                    away = np.maximum(0, n * (x * x).sum(1)[:, None] - 2 * x @ total.T + square)
                    own = np.searchsorted(names, _nearest(x, usable[setting])[0])
                    row = np.arange(len(x))
                    with np.errstate(all="ignore"):
                        mine, others = away[row, own] / (n[own] - 1), away / n
                        others[row, own] = np.inf
                        value = (others.min(1) - mine) / np.maximum(others.min(1), mine)
                    held[s] += np.where(n[own] > 1, np.nan_to_num(value), 0).sum(), len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(order)), pa.int32()), pa.array(held[:, 0]), pa.array(held[:, 1])], names=["s", "total", "n"])

    means = {r["s"]: r["total"] / r["n"] for r in rows.mapInArrow(run, "s int, total double, n double").groupBy("s").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect() if r["n"]}
    # One row a setting.
    made = [(*setting, len(sums.get(i, {})), float(sum(v[1] for v in sums.get(i, {}).values())), means.get(i)) for i, setting in enumerate(order)]
    return df.sparkSession.createDataFrame(made, "variant string, k int, seed int, n_clusters int, inertia double, silhouette double")


def assign(df: DataFrame, key: str, variants: Mapping[str, Sequence[str]], centres: Centres, name: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, variant, k, seed, label) of every row and setting from one scan.

    ``name`` gives each centre's label; by default they are numbered in order of their
    coordinates, so that runs agree on names.
    """
    rows, at = _points(df, variants, key)
    settings = [(s, c, (name or (lambda x: np.argsort(np.lexsort(x.T[::-1]))))(c)) for s, c in centres.items() if len(c)]

    def run(batches):
        for batch in batches:
            whole, keys = _matrix(batch, 1), batch.column(0)
            for s, c, names in settings:
                own = np.concatenate([names[_nearest(whole[i : i + 4096, at[s.variant]], c)[0]] for i in range(0, len(whole), 4096)]) if len(whole) else []
                n = len(keys)
                yield pa.RecordBatch.from_arrays([keys, pa.array([s.variant] * n, pa.string()), pa.array([s.k] * n, pa.int32()), pa.array([s.seed] * n, pa.int32()), pa.array(own, pa.int32())], names=["key", "variant", "k", "seed", "label"])

    return rows.mapInArrow(run, "key long, variant string, k int, seed int, label int").withColumnRenamed("key", key)
