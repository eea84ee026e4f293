"""Edge cases of the operators."""

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions import geo, text as T
from millrace.operators import aggregate as A, bands as B, cluster as K, columns as C, documents as D, joins as J, models as M, reshape as R, series as Z, splits as S, windows as W
from millrace.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_bands_are_right_closed(spark):
    label, ordinal = B.band("x", *B.PACK_TIME, include_lowest=True)
    made = {r.x: (r.l, r.o) for r in column(spark, [0.0, 1.0, 1.5, 7.0, 1e9, -0.1, None]).select("x", label.alias("l"), ordinal.alias("o")).collect()}
    assert made == {0.0: ("< 1 hour", 0), 1.0: ("< 1 hour", 0), 1.5: ("1-2 hours", 1), 7.0: ("6-7 hours", 6), 1e9: ("> 7 hours", 7), -0.1: (None, None), None: (None, None)}
    open_low = B.band("x", *B.OPERATOR_SPEED)[0]
    assert [r[0] for r in column(spark, [0.0, 4.0, 24.0, 24.1, float("nan")]).select(open_low).collect()] == [None, "0 - 4", "20 - 24", None, None]


def test_empty_bands_stay(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "b", 1), (2, "b", 1)], "k int, band string, ordinal int")
    assert [tuple(r) for r in B.band_summary(df, "band", "ordinal", "k", ["a", "b", "c"]).orderBy("ordinal").select("band", "n_members", "proportion", "cumulative").collect()] == [("a", 0, 0.0, 0.0), ("b", 2, 100.0, 100.0), ("c", 0, 0.0, 100.0)]
    assert {r.proportion for r in B.band_summary(df.limit(0), "band", "ordinal", "k", ["a", "b"]).collect()} == {None}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-5, 30, allow_nan=False), min_size=1, max_size=40))
def test_band_counts_sum_to_rows_inside(spark, values):
    df = column(spark, values)
    label, _ = B.band("x", *B.OPERATOR_SPEED)
    assert df.where(label.isNotNull()).count() == sum(0 < v <= 24 for v in values)


def test_rules_last_wins_and_rates(spark):
    df = spark.createDataFrame([("NAG", "EACH", 5.0), ("NAG", "GRAM", 5.0), ("X", "X", 1.0)], "t string, u string, q double")
    found = df.select(C.rules([(F.col("t") == "NAG", 0.0), (F.col("u") == "EACH", F.col("q"))]))
    assert [r[0] for r in found.collect()] == [5.0, 0.0, None]
    pairs = spark.createDataFrame([(6.0, 2.0), (6.0, 0.0), (0.0, 0.0), (None, 1.0)], "n double, h double")
    assert [r[0] for r in pairs.select(C.rate("n", "h")).collect()] == [3.0, 0.0, None, None]
    assert [r[0] for r in pairs.select(C.ratio("n", "h")).collect()] == [3.0, None, None, None]


def test_whole_days_floor(spark):
    stamp = lambda s: dt.datetime.fromisoformat(s)
    df = spark.createDataFrame([(stamp("2024-01-01 23:00:00"), stamp("2024-01-02 01:00:00")), (stamp("2024-01-02 01:00:00"), stamp("2024-01-01 23:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(C.whole_days("a", "b")).collect()] == [0, -1]


def test_codes_numbers_maps_and_casts(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string")
    assert rows(C.category_code(df, "s", "code")) == [("a", 0), ("b", 1), ("b", 1), (None, -1)]
    assert rows(C.group_number(df, ["s"], "n")) == [("a", 1), ("b", 2), ("b", 2), (None, 0)]
    assert [r[0] for r in df.select(C.map_values("s", {"a": 1})).collect()] == [None, 1, None, None]
    assert [r[0] for r in C.cast_all(column(spark, ["1", "x", None], "string"), {"x": "int"}).collect()] == [1, None, None]
    assert C.select_like(spark.createDataFrame([(1, 2)], "target_a int, b int"), "target") == ["target_a"]


def test_day_explosion(spark):
    day = lambda n: dt.datetime(2024, 1, n, 12)
    stays = spark.createDataFrame([(1, day(1), day(3)), (2, day(5), day(4)), (3, day(2), None), (4, day(6), day(6))], "k int, a timestamp_ntz, b timestamp_ntz")
    assert R.explode_days(stays, "a", "b", "day").groupBy("k").count().orderBy("k").collect() == [(1, 3), (2, 1), (3, 1), (4, 1)]
    assert R.explode_days(stays, "a", "b", "day", outer=False).count() == 4
    assert [r.day.day for r in R.explode_days(stays, "a", "b", "day", "2024-01-02", "2024-01-02", outer=False).collect()] == [2]


def test_joins(spark):
    left = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "k int, v string")
    right = spark.createDataFrame([(1, "found"), (1, "again"), (2, "other"), (None, "null")], "k int, v string")
    assert rows(J.recover(left, right, ["k"], "v")) == [(1, "again"), (1, "found"), (2, "x"), (None, None)]
    renamed = right.select(F.col("k").alias("rk"), F.col("v").alias("w"))
    assert J.left_join(left, renamed, [("k", "rk")]).where("k is null").collect()[0].w is None
    assert J.left_join(left, renamed, [("k", "rk")], null_safe=True).where("k is null").collect()[0].w == "null"
    ok, counts = J.reject_nulls(left, ["k", "v"])
    assert ok.count() == 1 and tuple(counts.first()) == (1, 2)
    assert rows(J.in_dimension(left, "k", right, "k", "known")) == [(1, None, True), (2, "x", True), (None, None, False)]
    assert J.argmax_rows(right, "k").count() == 1
    assert rows(J.union_fill([left, right.withColumn("z", F.lit(1))], {"z": 0}).select("z").distinct()) == [(0,), (1,)]


def test_coverage_includes_last_day(spark):
    at = lambda s: dt.datetime.fromisoformat(s)
    days = spark.createDataFrame([(at("2024-01-01 10:00"),), (at("2024-01-03 01:00"),)], "d timestamp_ntz")
    df = spark.createDataFrame([(at("2024-01-01 00:00"),), (at("2024-01-03 23:00"),), (at("2024-01-04 00:00"),), (None,)], "t timestamp_ntz")
    assert J.coverage_filter(df, "t", days, "d").count() == 2
    assert J.coverage_filter(df, "t", days, "d", strict=True).count() == 1


def test_windows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, None, None), (5, "b", 7.0)], "k int, g string, v double")
    assert {r.k: r.v for r in W.impute_group_mean(df, ["v"], ["g"]).collect()} == {1: 1.0, 2: 3.0, 3: 2.0, 4: None, 5: 7.0}
    scaled = {r.k: r.s for r in W.group_minmax(df.where("v is not null"), "v", ["g"], "s").collect()}
    assert scaled == {1: 0.0, 2: 1.0, 5: None}
    assert {r.k: r.o for r in W.borderline(df.where("v is not null"), "v", ["g"], 0.5, "o").collect()} == {1: False, 2: True, 5: False}
    assert [r.k for r in W.dedup_first(df, ["g"], [F.desc("k")]).orderBy("k").collect()] == [3, 4, 5]
    assert W.repeated_rows(df, ["g"], [F.col("k")]).count() == 2 and tuple(W.duplicates(df, ["g"]).first()) == (1, 2)
    assert tuple(W.duplicates(df.limit(0), ["g"]).first()) == (0, 0)


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", None)], "g string, v double")
    assert rows(A.multi_agg(df, ["g"], ["v"], ["mean", "count"])) == [("a", 1.0, 1), ("b", None, 0)]
    assert rows(A.null_profile(df)) == [("g", 1, 4), ("v", 2, 4)] and rows(A.null_profile(df.limit(0))) == [("g", 0, 0), ("v", 0, 0)]
    assert df.agg(A.sum_if("v", F.col("g") == "z"), A.mean_if(F.col("g") == "a")).first() == (0.0, 0.5)
    assert rows(A.value_share(df, [], "g"))[0][:2] == ("a", 2)
    assert rows(A.with_total(df, "g", "g")) == [("Total", 3, 100.0), ("a", 2, 66.67), ("b", 1, 33.33)]
    assert rows(A.histogram(column(spark, [5.0, 5.0]), "x", 3).select("bin", "n")) == [(0, 2), (1, 0), (2, 0)]
    assert rows(A.histogram(column(spark, [0.0, 1.0, 2.0]), "x", 2).select("bin", "n")) == [(0, 1), (1, 2)]
    box = A.box_stats(column(spark, [1.0, 2.0, 3.0, 4.0, 100.0]).withColumn("g", F.lit(1)), "x", ["g"]).first()
    assert (box.median, box.whisker_high, box.n_outliers) == (3.0, 4.0, 1)
    assert A.regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double"), "y", "p").first().r2 is None
    none = A.binary_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p", 1).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0.0, 0.0, 0.0, 1.0)
    perfect = A.auc(A.roc(spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "y int, s double"), "y", "s")).first().auc
    assert perfect == pytest.approx(1.0)


def test_splits(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 37)
    assert S.split_groups(df, ["g"], 0.3).groupBy("g").agg(F.countDistinct("is_test").alias("n")).where("n > 1").count() == 0
    assert rows(S.split(df, ["id"], 0.2).where("is_test")) == rows(S.split(df.repartition(7), ["id"], 0.2).where("is_test"))
    assert S.kfold(df, ["id"], 5).agg(F.countDistinct("fold")).first()[0] == 5
    assert [r.id for r in S.shuffle(df, ["id"]).limit(5).collect()] == [r.id for r in S.shuffle(df.repartition(3), ["id"]).limit(5).collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 10])
def test_simpson_weights(spark, n):
    df = spark.range(n).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("y"))
    total = Z.integrate_simpson(df, ["key"], "x", "y").first().integral
    assert total == pytest.approx({1: 0.0, 2: 0.5}.get(n, (n - 1) ** 3 / 3))


def test_log_bands_and_regrid(spark):
    block, middle = Z.log_bands("x", 1.0, 100.0, 10.0)
    found = [tuple(r) for r in column(spark, [1.0, 10.0, 100.0, 0.5, None]).select(block, F.round(middle, 6)).collect()]
    assert found == [(0, round(math.sqrt(10), 6)), (1, round(10 * math.sqrt(10), 6)), (1, round(10 * math.sqrt(10), 6)), (None, None), (None, None)]
    df = spark.createDataFrame([("a", 2, 5.0)], "k string, p long, y double")
    assert rows(Z.regrid(df, "k", "p", "y")) == [("a", 0, 0.0), ("a", 1, 0.0), ("a", 2, 5.0)]
    assert Z.off_grid(column(spark, [0.0, 0.52]), "x", 0.5).first()[0] == pytest.approx(0.02)


def test_ar1_short_series(spark):
    df = spark.createDataFrame([("one", 1, 5.0), ("two", 1, 1.0), ("two", 2, 3.0)], "k string, t int, y double")
    assert rows(Z.ar1_forecast(df, "k", "t", "y", 2)) == [("one", 1, 5.0), ("one", 2, 5.0), ("two", 1, 5.0), ("two", 2, 7.0)]


def test_geohash_known_cells(spark):
    df = spark.createDataFrame([(57.64911, 10.40744), (-90.0, -180.0), (90.0, 180.0), (None, 1.0), (91.0, 0.0)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.geohash("lat", "lon", 9)).collect()] == ["u4pruydqq", "000000000", "zzzzzzzzz", None, None]
    levels = df.limit(1).select(*(geo.geohash("lat", "lon", n).alias(str(n)) for n in range(2, 10))).first()
    assert all("u4pruydqq".startswith(v) for v in levels)


@settings(max_examples=8, deadline=None)
@given(st.text(max_size=400).filter(lambda t: "\ud800" > max(t, default="a") or min(t) > "\udfff"), st.integers(5, 60))
def test_chunks_rebuild_the_text(spark, text, size):
    overlap = size // 5
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    found = column(spark, [text], "string").select(T.chunk_array("x", size, overlap)).first()[0] or []
    assert "".join([*found[:1], *(c[overlap:] for c in found[1:])]) == text
    assert all(0 < len(c) <= size for c in found)


def test_chunks_at_breaks(spark):
    text = "aaa bbb\nccc ddd\n\neee " + "f" * 25
    found = column(spark, [text], "string").select(T.chunk_at_breaks("x", 10)).first()[0]
    assert "".join(found) == text and max(map(len, found)) <= 10 and found[0] == "aaa bbb\n"


def test_html_and_links(spark):
    html = '<html><STYLE>p{}</STYLE><script>var t="</p>";</script><p>One &amp; two</p>\n  three  four<!-- no --><a class="x" href="/a">l</a><a href="b?q#f">m</a><a href="//o.org/c">n</a><a href="#z">o</a></html>'
    df = spark.createDataFrame([("http://h.org/d/e", html)], "url string, html string")
    assert df.select(T.html_text("html")).first()[0] == "One & two three fourlmno"
    assert [r[0] for r in df.select(F.explode(T.links("html")).alias("l"), "url").select(T.resolve("l", "url")).collect()] == ["http://h.org/a", "http://h.org/d/b?q#f", "http://o.org/c", "http://h.org/d/e#z"]
    assert rows(D.page_links(df)) == [("http://h.org/d/e", "http://h.org/a"), ("http://h.org/d/e", "http://h.org/d/b?q"), ("http://h.org/d/e", "http://h.org/d/e")]


def test_character_references(spark):
    cases = {"a &lt;b&gt; &amp;lt; c": "a <b> &lt; c", "it&#8217;s &#x2019; &#39;x&#39;": "it\u2019s \u2019 'x'", "&copy;&middot;&euro;&Omega;&apos;": "\u00a9\u00b7\u20ac\u03a9'", "x&nbsp;y&#160;z": "x y z", "&#128512;": "\U0001f600", "&#0;&#xD800;&#1114112;": "\ufffd" * 3, "&nope; & &amp &;": "&nope; & &amp &;", "": "", "&": "&"}
    made = [r[0] for r in column(spark, list(cases), "string").select(T.unescaped("x")).collect()]
    assert made == list(cases.values()) and column(spark, [None], "string").select(T.unescaped("x")).first()[0] is None


def test_reach_smallest_depth_and_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "url string, link string")
    assert rows(D.reach(links, "a", 2)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(D.reach(links, "a", 2, 2)) == [("a", 0), ("b", 1)]


def test_top_k_and_context(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0, 0.0])], "id int, v array<double>")
    assert [(r.rank, r.id) for r in D.top_k(vectors.where("id = 1"), vectors, 3, "id", "v").orderBy("rank").collect()] == [(1, 2), (2, 5), (3, 4)]
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, rank int, chunk string")
    assert D.context(hits, "q", "rank", "chunk", "|").first().context == "a|b"


def test_event_stamps(spark):
    found = [str(r[0]) for r in column(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+01:00", "2024-01-02", "2024-01-02T03:04:05", "x", None], "string").select(T.event_start("x").cast("string")).collect()]
    assert found == ["2024-01-02 03:04:05", "2024-01-02 02:04:05", "2024-01-02 00:00:00", "2024-01-02 03:04:05", "None", "None"]


def test_silhouette_bounds_and_singletons(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (3, 1, 9.0), (4, -1, 5.0)], "k int, c int, x double")
    found = {r.k: r.silhouette for r in K.silhouette(df, "k", "c", ["x"]).collect()}
    assert found == {1: pytest.approx(8 / 9), 2: pytest.approx(7 / 8), 3: 0.0}


def test_tiers(spark):
    df = spark.createDataFrame([(7, 1.0), (7, 3.0), (3, 9.0), (-1, 5.0)], "c int, s double")
    assert rows(K.assign_tiers(df, "c", F.col("s"), ["low", "high"], noise=-1).select("c", "tier").distinct()) == [(-1, "Noise"), (3, "high"), (7, "low")]
    with pytest.raises(Exception, match="more clusters than tiers"):
        K.assign_tiers(df, "c", F.col("s"), ["low"], noise=-1).collect()


def test_validation_edges(spark):
    rules = {"n": ("int", 0, None), "d": ("double", 0, 1)}
    df = spark.createDataFrame([("0", "0"), ("3", "1"), ("-1", "0.5"), ("2", "1.5"), (None, "0.5"), ("x", "0.5")], "n string, d string")
    found = [r.reasons for r in K.validate(df, rules).collect()]
    assert found == [[], [], ["n: below 0"], ["d: above 1"], ["n: missing"], ["n: not int"]]
    scored = K.score(spark.createDataFrame([(0.0,), (5.0,)], "x double"), {"a": [0.0], "b": [10.0]}, ["x"], "v").collect()
    assert [(r.tier, round(r.confidence, 6)) for r in scored] == [("a", 1.0), ("a", 0.5)]


def test_stability_and_baseline(spark):
    runs = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 1), (2, 0)], "k int, label int")
    assert rows(K.stability(runs, "k", "label")) == [(1, 0, 2 / 3), (2, 0, 0.5)]
    train = spark.createDataFrame([(1,), (1,), (0,)], "y int")
    assert M.majority_baseline(train, train, "y").select("prediction").distinct().collect() == [(1,)]


def test_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a;b\n1;x\nbad;y\n")
    df = files.read_csv(spark, str(tmp_path / "in.csv"), "a int, b string, broken string", ";", "broken").cache()
    assert [(r.a, r.b, r.broken) for r in df.collect()] == [(1, "x", None), (None, "y", "bad;y")]
    files.write_csv(df.select("a", "b"), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), "a int, b string").count() == 2
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [files.materialise(make, spark, str(tmp_path / "m")).count() for _ in range(2)] == [3, 3] and calls == [1]
    (tmp_path / "f.json").write_text('{"feature_sets": {"small": ["b", "a", "t"], "big": ["c"]}, "targets": ["t"]}')
    meta = files.feature_sets(spark, str(tmp_path / "f.json"))
    assert files.feature_columns(meta, "small", drop=["t"]) == ["b", "a"]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert [r.content for r in files.read_texts(spark, str(tmp_path / "t.txt")).collect()] == ["one\ntwo"]
    assert files.read_texts(spark, str(tmp_path / "in.csv"), "csv").first().content.count("\n") == 1


def test_saved_model_gives_the_same(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(2 * i), "a" if i % 2 else "b") for i in range(20)], "x double, y double, c string")
    model = M.regressor("linear", ["x"], "y", ["c"]).fit(df)
    files.save_model(model, str(tmp_path / "m"))
    again = files.load_model(str(tmp_path / "m"))
    assert rows(again.transform(df).select("prediction")) == rows(model.transform(df).select("prediction"))
    unseen = model.transform(spark.createDataFrame([(1.0, 2.0, "new")], "x double, y double, c string")).first()
    assert math.isfinite(unseen.prediction)
