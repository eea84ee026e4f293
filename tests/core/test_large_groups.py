"""Operators whose groups may hold most rows: ranks, quantiles, texts in parts, wide columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregate as A, documents as D, ordered as O, parts as P, series as Z, windows as W
from millrace.sources import files


def explained(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", [1 << 17, 5])
def test_quantiles_of_groups_and_hot_values(spark, few):
    rng = random.Random(4)
    rows = [("a", 7.0 if i % 3 else rng.expovariate(0.01), rng.random() * 10 ** rng.randrange(-8, 9)) for i in range(900)]
    rows += [("b", float(i % 5), None) for i in range(40)] + [(None, 1.0, -2.0), (None, 3.0, float("nan")), ("c", None, None), ("d", float("inf"), -1e308), ("d", float("-inf"), 1e308), ("d", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    made = {(r.g, r.column_name): r for r in O.quantiles(df, ["x", "y"], (0.0, 0.25, 0.5, 0.9, 1.0), ["g"], few).collect()}
    for g in ("a", "b", "c", "d", None):
        for i, c in enumerate("xy", 1):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]]
            if not values:
                assert (g, c) not in made
            elif g != "d":
                assert list(made[g, c][2:]) == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.9, 1])), rel=1e-12)
            else:
                assert (made[g, c].q0, made[g, c].q2, made[g, c].q4) == (min(values), sorted(values)[1], max(values))
    whole = O.quantiles(df, ["x"], (0.5,)).first()
    assert whole.q0 == np.median([r[1] for r in rows if r[1] is not None]) and O.quantiles(df.limit(0), ["x"], (0.5,)).count() == 0


def test_quantiles_shuffle_counts_only(spark):
    """Nine tenths of the rows have one value: it reaches the last step as one row a task."""
    df = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, F.rand(3)).otherwise(0.5).alias("x"))
    assert O.quantiles(df, ["x"], (0.05, 0.5, 0.95), few=1000).first().q1 == 0.5


def test_group_rank_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("g"), F.xxhash64("id").alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    plain, split = (W.group_rank(df, ["g"], order, one_task=n) for n in (1 << 20, 100))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = O.ranges(df, ["g", *order]).where("g = -1")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert sorted((r.v, r.place) for r in W.group_rank(nulls, ["g"], [F.asc("v")], one_task=1).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_best_rows_are_chosen_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    best = W.top1(df, ["g"], [F.desc("id")])
    assert sorted(map(tuple, best.collect())) == [(0, 999), (1, 997), (2, 998)]
    assert "WindowGroupLimit" in explained(best) and "Partial" in explained(best)


def test_text_in_parts_of_bounded_length(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("k"), "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t"))
    line = F.concat(F.col("_position").cast("string"), F.lit(":"), F.col("t"))
    made = P.text_parts(df, ["k"], ["id"], F.char_length("t"), line, "\n", part=1000).collect()
    for k, ids in (("hot", range(2900)), ("cold", range(2900, 3000))):
        texts = [r for r in sorted(made, key=lambda r: r.part) if r.k == k]
        assert "\n".join(r.text for r in texts) == "\n".join(f"{i}:{'x' * (n % 50)}" for i, n in enumerate(ids))
        assert max(len(r.text) for r in texts) < 2000 and sum(r.n for r in texts) == len(ids)
    parts = P.text_parts(df, ["k"], ["id"], F.char_length("t"), F.col("t"), "\n", part=1000)
    P.write_parts(parts, str(tmp_path / "out"), ["k", "part"])
    written = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert written == "".join("x" * (n % 50) + "\n" for n in [*range(2900, 3000), *range(2900)])


def test_records_and_files_in_parts(spark, tmp_path):
    df = spark.createDataFrame([("u", i, f"r{i}") for i in range(9)] + [("v", 0, None)], "u string, i int, t string")
    made = P.render_records(df, "u", "%s", [F.col("t")], ["i"], part=8).orderBy("u", "part").collect()
    assert "\n".join(r.text for r in made if r.u == "u") == "RECORDS (9)\n" + "\n".join(f"r{i}" for i in range(9))
    assert {r.n for r in made if r.u == "u"} == {9} and len(made) > 3
    (tmp_path / "a.csv").write_text("n\n" + "\n".join(str(i) for i in range(500)) + "\n")
    read = files.read_texts(spark, str(tmp_path / "a.csv"), "csv", 100).orderBy("part").collect()
    assert "\n".join(r.content for r in read) == "\n".join(f'{{"n":"{i}"}}' for i in range(500)) and len(read) > 20


def test_two_thousand_columns(spark):
    n, rng = 2000, np.random.default_rng(1)
    x = rng.normal(size=(60, n))
    x[:, 7] = 3.0
    x[5, 3] = np.nan
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").select(*(F.col("v")[i].alias(f"c{i}") for i in range(n)))
    found = A.corr_matrix(df, df.columns).where("b in ('c3', 'c9', 'c1999', 'c7') and a in ('c0', 'c3', 'c300')").collect()
    assert len(found) == 8
    for r in found:
        i, j = int(r.a[1:]), int(r.b[1:])
        both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
        assert r["corr"] is None if 7 in (i, j) else r["corr"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    top = A.top_features(df, "c0", [f"c{i}" for i in range(1, n)], 3).collect()
    want = sorted((-abs(np.corrcoef(x[:, 0], x[:, i])[0, 1]), f"c{i}") for i in range(1, n) if i not in (3, 7))[:3]
    assert [(r.feature, round(abs(r["corr"]), 9)) for r in top] == [(f, round(-c, 9)) for c, f in want]


def test_distinct_counts_without_a_copy_for_each_column(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, None), ("b", 2, "x"), (None, 3, "y")], "g string, n int, s string")
    made = A.distinct_profile(df, ["n", "s"])
    assert sorted(map(tuple, made.collect())) == [("n", 3), ("s", 2)] and "Expand" not in explained(made)
    by = A.profile_by(df, ["g"], ["n", "s"])
    assert sorted(map(tuple, by.collect())) == [("a", 1, 1, 2, 1), ("b", 1, 1, 1, 1)] and "Expand" not in explained(by)
    assert sorted(map(tuple, A.distinct_profile(df.limit(0), ["n"]).collect())) == [("n", 0)]
    many = spark.range(20_000).select((F.col("id") % 7919).alias("x"))
    assert abs(A.approx_distinct(many, ["x"]).first().n_distinct - 7919) < 7919 * 0.08


def test_reach_of_a_long_chain_has_a_short_plan(spark):
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(60)] + [("p3", "p1")], "url string, link string")
    found = D.reach(links, "p0", 50)
    assert {(r.url, r.depth) for r in found.collect()} == {(f"p{i}", i) for i in range(51)} and len(explained(found)) < 4000
    assert D.reach(links, "p0", 50, 5).count() == 5


def test_nearest_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, x[4].tolist())], "id long, v array<double>")
    made = D.top_k(df.where("id % 10 = 4"), df, 4, "id", "v", block_rows=40).collect()
    norm = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(4, 300, 10):
        score = [(-float(s), i) for i, s in enumerate(norm @ norm[q]) if i != q] + [(-float(norm[q] @ norm[4]), 902)]
        assert [r.id for r in sorted((r for r in made if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in sorted((round(s, 12), i) for s, i in score)[:4]]


def test_arima_recovers_its_coefficients(spark):
    rng, d, e, y, rows = random.Random(1), 0.0, 0.0, 0.0, []
    for t in range(6000):
        new = rng.gauss(0, 1)
        d, e = 0.2 + 0.5 * d + new + 0.3 * e, new
        y += d
        rows.append(("s", t, y))
    fit = Z.arima_fit(spark.createDataFrame(rows + [("short", 0, 4.0), ("short", 1, 6.0)], "k string, t int, y double"), "k", "t", "y")
    got = {r.k: r for r in fit.collect()}
    assert got["s"].ar == pytest.approx(0.5, abs=0.08) and got["s"].ma == pytest.approx(0.3, abs=0.12) and got["s"].level == pytest.approx(0.2, abs=0.08)
    steps = {(r.k, r.step): r.forecast for r in Z.arima_forecast(fit, "k", 2).collect()}
    assert steps["short", 1] == 6.0 + got["short"].level and len(steps) == 4
