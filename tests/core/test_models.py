"""Fitted models against plain versions and planted structure."""

import tracemalloc

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from millrace.operators import cluster as K, models as M, sweeps as V
from millrace.plans import clusters

COLUMNS = ["x", "y"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    return x, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double")


def plain_lloyd(x, centres, rounds):
    for _ in range(rounds):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def test_lloyd_rounds_of_all_settings_as_one_by_one(spark, blobs):
    x, df = blobs
    begun = {V.Setting("v", k, s): x[[(7 * i + s) % 120 for i in range(k)]] for k in (2, 3, 5) for s in (0, 1)}
    made = V.fit(df, {"v": COLUMNS}, begun, rounds=4)
    for setting, centres in begun.items():
        assert np.allclose(made[setting], plain_lloyd(x, centres, 4))
    scored = {(r.k, r.seed): r for r in V.score(df, {"v": COLUMNS}, made).collect()}
    for setting, centres in made.items():
        away = ((x[:, None] - centres) ** 2).sum(2)
        own = away.argmin(1)
        assert scored[setting.k, setting.seed].inertia == pytest.approx(away.min(1).sum())
        d = ((x[:, None] - x) ** 2).sum(2)
        means = np.array([[d[i][(own == c) & (np.arange(120) != i)].mean() if ((own == c) & (np.arange(120) != i)).any() else np.inf for c in range(setting.k)] for i in range(120)])
        value = []
        for i in range(120):
            if (own == own[i]).sum() == 1:
                value.append(0.0)
                continue
            mine, other = means[i, own[i]], min(means[i, c] for c in range(setting.k) if c != own[i] and (own == c).any())
            value.append((other - mine) / max(other, mine))
        assert scored[setting.k, setting.seed].silhouette == pytest.approx(np.mean(value), abs=1e-9)


def test_starts_find_planted_clusters_and_labels_agree(spark, blobs):
    x, df = blobs
    variants = {"v": COLUMNS}
    found = V.fit(df, variants, V.starts(df, "id", variants, [3], range(5)))
    labels = V.assign(df, "id", variants, found).groupBy("id").agg(F.countDistinct("label").alias("n"), F.min("label").alias("label")).collect()
    assert {r.n for r in labels} == {1} and {(r.id // 40, r.label) for r in labels} in ({(0, 0), (1, 2), (2, 1)}, {(0, 1), (1, 2), (2, 0)})
    few = V.starts(df.limit(2), "id", variants, [5], [1])
    assert len(few[V.Setting("v", 5, 1)]) == 2
    assert V.score(df, variants, V.fit(df, variants, V.starts(df, "id", variants, [1], [1]))).first().silhouette is None


def test_mixture_finds_planted_clusters(spark, blobs):
    x, df = blobs
    made = M.gmm(M.standardise(COLUMNS), 3).fit(df).transform(df).select("id", "prediction").collect()
    homes = {}
    for r in made:
        homes.setdefault(r.id // 40, set()).add(r.prediction)
    assert all(len(h) == 1 for h in homes.values()) and len(set.union(*homes.values())) == 3


def test_components_are_those_of_the_correlations(spark, blobs):
    x, df = blobs
    model = M.pca(COLUMNS, 2).fit(df)
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    shares = [r.variance for r in M.explained(model, df).orderBy("component").collect()]
    assert shares == pytest.approx((values[::-1] / 2).tolist())
    found = np.zeros((2, 2))
    for r in M.loadings(model, df, COLUMNS).collect():
        found[COLUMNS.index(r.feature), r.component - 1] = r.loading
    assert np.allclose(np.abs(found.T @ vectors[:, ::-1]), np.eye(2), atol=1e-6)
    assert np.allclose(found.T @ found, np.eye(2))


def test_one_hot_slots_and_unseen_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    assert sorted(map(tuple, M.level_counts(df, ["c"]).collect())) == [("c", "a", 1), ("c", "b", 2)]


def test_trees_use_what_matters_and_the_grid_is_searched(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(a > 0) * 10 + float(e), "u" if i % 2 else "w") for i, (a, b, e) in enumerate(rng.normal(size=(400, 3)) * [1, 1, 0.1])]
    df = spark.createDataFrame(rows, "a double, b double, y double, c string")
    judge = RegressionEvaluator(labelCol="y", metricName="rmse")
    for kind, grid in (("forest", {"maxDepth": [1, 3], "numTrees": [1, 5]}), ("boosted", {"maxDepth": [1, 2], "stepSize": [0.1, 1.0]})):
        extra = {"maxIter": 3} if kind == "boosted" else {}
        model = M.search(M.regressor(kind, ["a", "b"], "y", ["c"], **extra), grid, judge).fit(df)
        assert len(model.validationMetrics) == 4 and min(model.validationMetrics) < 2.5
        won = dict(w.split() for w in M.chosen(model, grid).split(", "))
        assert won.keys() == grid.keys() and all(float(won[n]) in map(float, grid[n]) for n in grid)
        best = M.importances(model.bestModel, model.bestModel.transform(df)).collect()
        assert best[0].feature.startswith("scaled_0") and best[0].importance > 0.9 and sum(r.importance for r in best) == pytest.approx(1)


def test_exact_silhouette_of_many_points(spark):
    df = spark.range(50_500).select("id", (F.col("id") % 2).alias("c"), (F.col("id") % 2 * 3.0).alias("x"))
    found = K.silhouette(df, "id", "c", ["x"]).agg(F.count("silhouette").alias("n"), F.min("silhouette").alias("low")).first()
    assert (found.n, found.low) == (50_500, 1.0)


def test_exact_silhouette_in_lots_as_from_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "LOT", 40)
    monkeypatch.setattr(K, "TILE", 7)
    rng = np.random.default_rng(6)
    rows = [(i if i != 9 else 8, "abcd"[i % 3], *map(float, rng.normal(size=2) + i % 3)) for i in range(120)]
    rows += [(500, "d", 1.0, 1.0), (501, "a", None, 2.0), (502, "noise", 0.0, 0.0), (503, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, c string, x double, y double")
    used = [r for r in rows if r[1] not in (None, "noise")]
    want = {}
    for k, c in {r[:2] for r in used}:
        means = {}
        for o in "abcd":
            d = [np.hypot(p[2] - q[2], p[3] - q[3]) for p in used for q in used if p[:2] == (k, c) and q[1] == o and q[0] != k and None not in p + q]
            if d:
                means[o] = np.mean(d)
        own, after = means.get(c), min((m for o, m in means.items() if o != c), default=None)
        want[k, c] = None if after is None else 0.0 if own is None else (after - own) / max(after, own)
    made = {(r.k, r.cluster): r.silhouette for r in K.silhouette(df, "k", "c", ["x", "y"], noise="noise").collect()}
    assert made.keys() == want.keys() and made[501, "a"] is None
    assert all(made[k] == (v if v is None else pytest.approx(v, abs=1e-12)) for k, v in want.items())
    assert K.silhouette(df.where("k = 500"), "k", "c", ["x", "y"], noise="noise").count() == 0


def test_nearest_centres_make_no_array_of_points_centres_and_columns():
    rng = np.random.default_rng(8)
    x, centres = np.asfortranarray(rng.normal(size=(4096, 40))), rng.normal(size=(9, 40))
    tracemalloc.start()
    own, away = V._nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far = ((x[:, None] - centres) ** 2).sum(2)
    assert (own == far.argmin(1)).all() and np.allclose(away, far.min(1)) and peak < 3 * far.nbytes


def test_fits_on_pooled_rows_are_those_on_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), "uvw"[b], float(a * a + 3 * b + e)) for i, (a, b, e) in enumerate(zip(rng.integers(0, 6, 4000), rng.integers(0, 3, 4000), rng.normal(size=4000)))]
    df = spark.createDataFrame(rows, "i long, a double, c string, y double")
    pooled = M.pool(df, ["a", "c"], "y", ["i"])
    assert pooled.count() <= 18 * M.LOTS and pooled.agg(F.sum(M.WEIGHT)).first()[0] == 4000
    assert M.pooled_mean(pooled, "y").first()[0] == pytest.approx(np.mean([r[3] for r in rows]))
    for kind, params in (("linear", {}), ("boosted", {"maxIter": 3, "maxDepth": 2})):
        one = M.regressor(kind, ["a"], "y", ["c"], **params).fit(df)
        other = M.regressor(kind, ["a"], "y", ["c"], weightCol=M.WEIGHT, **params).fit(pooled)
        a, b = ([r.prediction for r in m.transform(df).orderBy("i").collect()] for m in (one, other))
        assert np.allclose(a, b, atol=1e-9)
        judged = RegressionEvaluator(labelCol="y", metricName="rmse").evaluate(other.transform(df))
        assert M.PooledRmse("y").evaluate(other.transform(pooled)) == pytest.approx(judged)


def test_models_of_lines_are_fitted_on_pooled_ones(spark, tmp_path, monkeypatch):
    """20,000 lines of 12 different features."""
    i = F.col("id")
    made = spark.range(20_000).select(
        (i / 3).cast("long").alias("l_orderkey"), (i % 3).cast("int").alias("l_linenumber"), (i % 4 + 1.0).alias("l_quantity"), (i % 3 / 100).alias("l_discount"), (i % 2 / 100).alias("l_tax"),
        (i % 97 * 100.0).alias("l_extendedprice"), F.lit("A").alias("l_returnflag"),
    )
    made.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, fit = [], M.Pipeline.fit
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, df, *more: seen.append(df.count()) or fit(self, df, *more))
    assert {(r.model, r.better) for r in clusters.better_than_mean(spark, str(tmp_path)).collect()} == {(m, True) for m in ("linear", "forest", "boosted")}
    assert len(seen) == 3 and max(seen) <= 12 * M.LOTS


def test_mixture_of_a_small_file_is_shared_and_starts_the_same_whatever_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SHARE", 50)
    i = F.col("id")
    made = spark.range(300).select(i.alias("p_partkey"), (i * 7 % 50 + 1).cast("int").alias("p_size"), (900.0 + i * 31 % 101).alias("p_retailprice"))
    made.coalesce(1).write.parquet(f"{tmp_path}/one/part.parquet")
    made.orderBy(F.xxhash64("p_partkey")).repartition(3).write.parquet(f"{tmp_path}/three/part.parquet")
    shares, fit = [], M.Pipeline.fit
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, df, *more: shares.append(df.rdd.getNumPartitions()) or fit(self, df, *more))
    one, three = (sorted(map(tuple, clusters.gmm(spark, f"{tmp_path}/{files}").collect())) for files in ("one", "three"))
    assert shares == [6, 6] and one == three and sum(n for _, n in one) == 300
