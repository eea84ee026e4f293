"""Clusters, tiers and fitted models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregate as A, cluster as K, columns as C, density as N, models as M, splits as S, sweeps as V, windows as W
from ..operators.checkpoints import written
from .common import long, rounded, table

FEATURES = ["internal", "hospitals", "pharmacies", "diversity", "density"]
WEIGHTS = dict(zip(FEATURES, (0.3, 0.2, 0.15, 0.2, 0.15)))
TIERS = ["Basic", "Standard", "Premium"]
SEEDS = tuple(range(42, 52))
LINES = ["l_quantity", "l_discount", "l_tax"]


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as research centres: five features from size, price and key, three fixed clusters."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        size.cast("double").alias("internal"),
        (key * 7 % 13).cast("double").alias("hospitals"),
        (key * 5 % 11).cast("double").alias("pharmacies"),
        (F.col("p_retailprice") % 100 / 100).alias("diversity"),
        (size % 10 / 10.0).alias("density"),
        F.when(size <= 15, 2).when(size <= 35, 0).otherwise(1).alias("cluster"),
    )


CENTRES = """
p as (select p_partkey, p_size::double as internal, (p_partkey * 7 % 13)::double as hospitals, (p_partkey * 5 % 11)::double as pharmacies, p_retailprice % 100 / 100 as diversity, p_size % 10 / 10.0::double as density,
  case when p_size <= 15 then 2 when p_size <= 35 then 0 else 1 end as cluster from part)"""
_QUALITY = "internal * 0.3::double + hospitals * 0.2::double + pharmacies * 0.15::double + diversity * 0.2::double + density * 0.15::double"


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = K.assign_tiers(centres(spark, sf_dir), "cluster", C.weighted_score(WEIGHTS), TIERS, noise=-1)
    return made.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), *(rounded(F.avg(c)).alias(c) for c in FEATURES))


TIERS_SQL = f"""
with {CENTRES}, m as (select cluster, row_number() over (order by avg({_QUALITY}), cluster) as place from p group by 1)
select ['Basic', 'Standard', 'Premium'][place] as tier, count(*) as n, {", ".join(f"round(avg({c}), 4) as {c}" for c in FEATURES)} from p join m using (cluster) group by 1"""


def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each centre to its cluster's mean over scaled features, and who is borderline."""
    scaled = K.standardised(centres(spark, sf_dir), FEATURES)
    made = W.borderline(K.centroid_distance(scaled, "cluster", FEATURES), "distance", ["cluster"], 1.5, "borderline")
    return made.select("p_partkey", rounded("distance", 5).alias("distance"), "borderline")


DISTANCES_SQL = f"""
with {CENTRES}, s as (select p_partkey, cluster, {", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as {c}" for c in FEATURES)} from p),
d as (select p_partkey, cluster, sqrt({" + ".join(f"({c} - m_{c}) ** 2" for c in FEATURES)}) as distance from s join (select cluster, {", ".join(f"avg({c}) as m_{c}" for c in FEATURES)} from s group by 1) using (cluster))
select p_partkey, round(distance, 5) as distance, distance > avg(distance) over w + 1.5 * stddev_samp(distance) over w as borderline from d window w as (partition by cluster)"""


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact silhouettes of suppliers by their nation's region, over balance and key."""
    points = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    points = points.select("s_suppkey", F.col("n_regionkey").alias("cluster"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 17).cast("double").alias("y"))
    made = K.silhouette(points, "s_suppkey", "cluster", ["x", "y"])
    return made.select("s_suppkey", rounded("silhouette", 5).alias("silhouette"))


SILHOUETTE_SQL = """
with p as (select s_suppkey as k, n_regionkey as c, s_acctbal / 1000 as x, (s_suppkey % 17)::double as y from supplier join nation on s_nationkey = n_nationkey),
d as (select a.k, a.c, b.c as o, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as d from p a join p b on a.k <> b.k group by 1, 2, 3),
m as (select k, c, min(d) filter (o = c) as own, min(d) filter (o <> c) as nxt from d group by 1, 2)
select k as s_suppkey, round(case when nxt is null then null when own is null then 0 else (nxt - own) / greatest(nxt, own) end, 5) as silhouette from m"""


def silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes of all parts by squared distances, from each cluster's sums."""
    made = K.silhouette_squared(centres(spark, sf_dir), "p_partkey", "cluster", FEATURES)
    return made.select("p_partkey", rounded("silhouette", 5).alias("silhouette"))


SILHOUETTE_SQUARED_SQL = f"""
with {CENTRES}, d as (select a.p_partkey as k, a.cluster as c, b.cluster as o, avg({" + ".join(f"(a.{c} - b.{c}) ** 2" for c in FEATURES)}) as d from p a join p b on a.p_partkey <> b.p_partkey group by 1, 2, 3),
m as (select k, c, min(d) filter (o = c) as own, min(d) filter (o <> c) as nxt from d group by 1, 2)
select k as p_partkey, round(case when nxt is null then null when own is null then 0 else (nxt - own) / greatest(nxt, own) end, 5) as silhouette from m"""


def noise_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = centres(spark, sf_dir).withColumn("cluster", F.when(F.col("p_partkey") % 9 == 0, -1).otherwise(F.col("cluster")))
    made = A.noise_contrast(points, "cluster", FEATURES)
    return made.select(long("cluster").alias("cluster"), "feature", *(rounded(c).alias(c) for c in ("cluster_mean", "noise_mean", "difference")))


NOISE_SQL = f"with {CENTRES}, q as (select *, case when p_partkey % 9 = 0 then -1 else cluster end as k from p) " + " union all ".join(
    f"select cast(k as bigint) as cluster, '{c}' as feature, round(avg({c}), 4) as cluster_mean, round((select avg({c}) from q where k = -1), 4) as noise_mean, round(avg({c}) - (select avg({c}) from q where k = -1), 4) as difference from q where k <> -1 group by 1" for c in FEATURES
)


def tier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature means of tiers scaled between the tiers' least and greatest."""
    means = tiers(spark, sf_dir).unpivot(["tier"], FEATURES, "feature", "mean")
    return W.group_minmax(means, "mean", ["feature"], "scaled").select("tier", "feature", "mean", rounded("scaled").alias("scaled"))


TIER_PROFILE_SQL = f"with t as ({TIERS_SQL}), u as (unpivot t on {', '.join(FEATURES)} into name feature value mean) select tier, feature, mean, round((mean - min(mean) over w) / nullif(max(mean) over w - min(mean) over w, 0), 4) as scaled from u window w as (partition by feature)"


DIMS = [f"d{i}" for i in range(64)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)))


def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by all their dimensions."""
    made = N.dbscan(vectors(spark, sf_dir), "vec_id", DIMS, 1.1, 3)
    return made.select("vec_id", long("cluster").alias("cluster"))


def _dbscan_sql(points: str, out: str, eps: float, min_pts: int, rounds: int) -> str:
    """Labels spread over links of cores, ``rounds`` times; ``points``: k, x."""
    return f"""
with recursive pts as ({points}), pr as (select a.k as a, b.k as b from pts a join pts b on list_distance(a.x, b.x) <= {eps}::double),
core as (select a from pr group by a having count(*) >= {min_pts}), ed as (select a, b from pr where a in (select a from core) and b in (select a from core)),
lab as (select 0 as it, a, a as label from core union all select it + 1, ed.a, min(label) from lab join ed on lab.a = ed.b where it < {rounds} group by 1, 2),
own as (select a, label from lab where it = {rounds}),
found as (select a, label from own union all select pr.a, min(label) from pr join own on pr.b = own.a where pr.a not in (select a from core) group by 1),
num as (select label, row_number() over (order by label) - 1 as cluster from (select distinct label from own))
select k as {out}, coalesce(cluster, -1) as cluster from pts left join found on k = a left join num using (label)"""


DBSCAN_SQL = _dbscan_sql("select vec_id as k, embedding::double[] as x from embeddings", "vec_id", 1.1, 3, 30)


def dbscan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance, in quarters of 500, and nation: many equal points, full cells."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.floor(F.col("c_acctbal") / 125) / 4.0).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return N.dbscan(rows, "c_custkey", ["x", "y"], 0.6, 4).select("c_custkey", long("cluster").alias("cluster"))


DBSCAN_CELLS_SQL = _dbscan_sql("select c_custkey as k, [floor(c_acctbal / 125) / 4.0::double, c_nationkey::double] as x from customer", "c_custkey", 0.6, 4, 120)


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers lie within a distance of each, itself counted."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return K.neighbour_counts(rows, "s_suppkey", ["x", "y"], 1.5)


NEIGHBOURS_SQL = "select a.s_suppkey, count(*) as n, max(b.s_suppkey) as last from supplier a join supplier b on sqrt(((a.s_acctbal - b.s_acctbal) / 1000) ** 2 + (a.s_nationkey - b.s_nationkey) ** 2) <= 1.5 group by 1"
EPS, MIN_PTS = [round(0.1 * i, 1) for i in range(1, 15)], range(2, 6)
SCORES = ["silhouette_scaled", "noise_scaled", "score", "group_silhouette", "group_noise", "group_score"]


def dbscan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings on vectors and on scaled suppliers: clusters, noise, silhouette without noise.

    Settings with two to six clusters are scored, by squared distances; those of a positive
    silhouette are scaled over all and inside their number of clusters, and ranked there by
    silhouette less noise.
    """
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 17).cast("double").alias("z"))
    experiments = {"vectors": (vectors(spark, sf_dir), "vec_id", DIMS), "suppliers": (K.standardised(suppliers, ["x", "y", "z"]), "s_suppkey", ["x", "y", "z"])}
    rows, by = [], ["eps", "min_pts"]
    for name, (points, key, columns) in experiments.items():
        found = written(N.dbscan_settings(points, key, columns, EPS, MIN_PTS))
        noise = F.count_if(F.col("cluster") == -1)
        each = found.groupBy(*by).agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), noise.alias("n_noise"), (noise * 100 / F.count(F.lit(1))).alias("noise_pct"))
        scored = found.join(each.where("n_clusters between 2 and 6").select(*by), by, "left_semi").join(points, key)
        means = K.silhouette_squared(scored, key, "cluster", columns, by=by).groupBy(*by).agg(rounded(F.avg("silhouette"), 9).alias("silhouette"))
        rows.append(each.join(means, by, "left").select(F.lit(name).alias("experiment"), "*"))
    made = reduce(DataFrame.unionByName, rows)
    made = made.withColumns({"n_clusters": F.when(F.col("silhouette").isNull(), 0).otherwise(F.col("n_clusters")), "silhouette": F.coalesce("silhouette", F.lit(-1.0))}).checkpoint()
    good = W.minmax(made.where("silhouette > 0"), ["silhouette", "noise_pct"]).withColumnRenamed("noise_pct_scaled", "noise_scaled")
    good = W.group_minmax(W.group_minmax(good, "silhouette", ["n_clusters"], "group_silhouette"), "noise_pct", ["n_clusters"], "group_noise")
    good = good.withColumns({"score": F.col("silhouette_scaled") - F.col("noise_scaled"), "group_score": rounded(F.col("group_silhouette") - F.col("group_noise"), 6)})
    good = W.group_rank(good, ["n_clusters"], [F.desc("group_score"), F.asc("min_pts"), F.asc("experiment"), F.asc("eps")], "group_rank")
    whole = made.join(good.select("experiment", *by, *SCORES, "group_rank"), ["experiment", *by], "left")
    return whole.select("experiment", "eps", long("min_pts").alias("min_pts"), long("n_clusters").alias("n_clusters"), "n_noise", *(rounded(c, 6).alias(c) for c in ("noise_pct", "silhouette", *SCORES)), long("group_rank").alias("group_rank"))


_SCALED = ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()" for c in ("s_acctbal", "s_nationkey", "(s_suppkey % 17)"))
DBSCAN_GRID_SQL = f"""
with recursive pts as (select 'vectors' as experiment, vec_id as k, embedding::double[] as x from embeddings union all select 'suppliers', s_suppkey, [{_SCALED}] from supplier),
pr as (select a.experiment, a.k as a, b.k as b, list_distance(a.x, b.x) as d from pts a join pts b on a.experiment = b.experiment),
st as (select e / 10.0::double as eps, m as min_pts from range(1, 15) x(e), range(2, 6) y(m)),
core as (select experiment, eps, min_pts, a from pr join st on d <= eps group by 1, 2, 3, 4 having count(*) >= min_pts),
ed as (select c.experiment, c.eps, c.min_pts, c.a, p.b from core c join pr p on p.experiment = c.experiment and p.a = c.a and p.d <= c.eps join core o on o.experiment = c.experiment and o.eps = c.eps and o.min_pts = c.min_pts and o.a = p.b),
lab as (select 0 as it, experiment, eps, min_pts, a, a as label from core
  union all select it + 1, ed.experiment, ed.eps, ed.min_pts, ed.a, min(label) from lab join ed on lab.experiment = ed.experiment and lab.eps = ed.eps and lab.min_pts = ed.min_pts and lab.a = ed.b where it < 25 group by 1, 2, 3, 4, 5),
own as (select * from lab where it = 25),
fnd as (select experiment, eps, min_pts, a, label from own union all
  select p.experiment, o.eps, o.min_pts, p.a, min(label) from pr p join own o on o.experiment = p.experiment and o.a = p.b and p.d <= o.eps
  where not exists (select 1 from core c where c.experiment = p.experiment and c.eps = o.eps and c.min_pts = o.min_pts and c.a = p.a) group by 1, 2, 3, 4),
tot as (select experiment, count(*) as n from pts group by 1),
each as (select t.experiment, st.eps, st.min_pts, count(distinct label) as n_clusters, t.n - count(f.a) as n_noise, t.n from tot t cross join st left join fnd f on f.experiment = t.experiment and f.eps = st.eps and f.min_pts = st.min_pts group by 1, 2, 3, t.n),
sc as (select f.* from fnd f join each e on e.experiment = f.experiment and e.eps = f.eps and e.min_pts = f.min_pts where n_clusters between 2 and 6),
dd as (select x.experiment, x.eps, x.min_pts, x.a, x.label as c, y.label as o, avg(d * d) as d from sc x join sc y on x.experiment = y.experiment and x.eps = y.eps and x.min_pts = y.min_pts and x.a <> y.a join pr on pr.experiment = x.experiment and pr.a = x.a and pr.b = y.a group by 1, 2, 3, 4, 5, 6),
mm as (select experiment, eps, min_pts, a, c, min(d) filter (o = c) as own, min(d) filter (o <> c) as nxt from dd group by 1, 2, 3, 4, 5),
sil as (select experiment, eps, min_pts, round(avg(case when nxt is null then null when own is null then 0 else (nxt - own) / greatest(nxt, own) end), 9) as s from mm group by 1, 2, 3),
made as (select e.experiment, e.eps, e.min_pts, case when s is null then 0 else n_clusters end as n_clusters, n_noise, n_noise * 100.0::double / n as noise_pct, coalesce(s, -1) as silhouette from each e left join sil on sil.experiment = e.experiment and sil.eps = e.eps and sil.min_pts = e.min_pts),
good as (select *, (silhouette - min(silhouette) over ()) / nullif(max(silhouette) over () - min(silhouette) over (), 0) as silhouette_scaled, (noise_pct - min(noise_pct) over ()) / nullif(max(noise_pct) over () - min(noise_pct) over (), 0) as noise_scaled,
  (silhouette - min(silhouette) over w) / nullif(max(silhouette) over w - min(silhouette) over w, 0) as group_silhouette, (noise_pct - min(noise_pct) over w) / nullif(max(noise_pct) over w - min(noise_pct) over w, 0) as group_noise from made where silhouette > 0 window w as (partition by n_clusters)),
rnk as (select *, silhouette_scaled - noise_scaled as score, round(group_silhouette - group_noise, 6) as group_score from good)
select m.experiment, m.eps, m.min_pts, m.n_clusters, m.n_noise, round(m.noise_pct, 6) as noise_pct, round(m.silhouette, 6) as silhouette, {", ".join(f"round(r.{c}, 6) as {c}" for c in SCORES)}, r.group_rank
from made m left join (select *, row_number() over (partition by n_clusters order by group_score desc nulls last, min_pts, experiment, eps) as group_rank from rnk) r on r.experiment = m.experiment and r.eps = m.eps and r.min_pts = m.min_pts"""


def sweep_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Centres with scaled features and two component scores, and the variants' columns."""
    scaled = K.standardised(centres(spark, sf_dir), FEATURES)
    scored = M.vector_columns(M.pca(FEATURES, 2).fit(scaled).transform(scaled), "scores", ["s0", "s1"])
    return written(scored.select("p_partkey", *FEATURES, "s0", "s1")), {"scaled": FEATURES, "pca2": ["s0", "s1"]}


def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two to nine clusters of scaled features and of two components, ranked by silhouette."""
    rows, variants = sweep_points(spark, sf_dir)
    found = V.fit(rows, variants, V.starts(rows, "p_partkey", variants, range(2, 10), [42]))
    swept = V.score(rows, variants, found).drop("seed", "n_clusters")
    return W.group_rank(swept, ["k"], [F.desc("silhouette"), F.asc("variant")])


def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round from the first parts as centres, for all numbers of clusters at once."""
    rows = written(K.standardised(centres(spark, sf_dir), FEATURES))
    first = np.array([tuple(r) for r in rows.orderBy("p_partkey").limit(9).select(*FEATURES).collect()])
    variants = {"scaled": FEATURES}
    moved = V.fit(rows, variants, {V.Setting("scaled", k, 0): first[:k] for k in range(2, 10)}, rounds=1)
    return V.score(rows, variants, moved).select(long("k").alias("k"), rounded("inertia", 4).alias("inertia"), rounded("silhouette", 6).alias("silhouette"))


_FAR = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) ** 2))"
LLOYD_SQL = f"""
with {CENTRES}, s as (select p_partkey as i, [{", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()" for c in FEATURES)}] as x from p),
k as (select unnest(range(2, 10)) as k), f as (select row_number() over (order by i) - 1 as c, x from s), c0 as (select k, c, x from k join f on c < k),
a0 as (select k, c.c, p.i, p.x, row_number() over (partition by k, p.i order by {_FAR}, c.c) as r from s p cross join c0 c),
m0 as (select k, c, [{", ".join(f"avg(x[{i + 1}])" for i in range(len(FEATURES)))}] as x from a0 where r = 1 group by 1, 2), c1 as (select k, c, coalesce(m0.x, c0.x) as x from c0 left join m0 using (k, c)),
a1 as (select k, c.c, p.i, p.x, {_FAR} as d, row_number() over (partition by k, p.i order by {_FAR}, c.c) as r from s p cross join c1 c), own as (select * from a1 where r = 1),
g as (select k, c, count(*) as n, sum({" + ".join(f"x[{i + 1}] ** 2" for i in range(len(FEATURES)))}) as q, [{", ".join(f"sum(x[{i + 1}])" for i in range(len(FEATURES)))}] as x from own group by 1, 2),
w as (select p.k, p.i, p.c, g.c as o, g.n, greatest(0, g.n * ({" + ".join(f"p.x[{i + 1}] ** 2" for i in range(len(FEATURES)))}) - 2 * ({" + ".join(f"p.x[{i + 1}] * g.x[{i + 1}]" for i in range(len(FEATURES)))}) + g.q) as t from own p join g on p.k = g.k),
v as (select k, i, min(t / nullif(n - 1, 0)) filter (o = c) as mine, min(t / n) filter (o <> c) as other, max(n) filter (o = c) as n from w group by 1, 2)
select k, round(inertia, 4) as inertia, round(sil, 6) as silhouette from (select k, sum(d) as inertia from own group by 1) join (select k, avg(case when n > 1 then coalesce((other - mine) / nullif(greatest(other, mine), 0), 0) else 0 end) as sil from v group by 1) using (k)"""


def gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.spread(centres(spark, sf_dir), "p_partkey")
    made = M.gmm(M.standardise(FEATURES), 3).fit(rows).transform(rows)
    return made.groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sweep_points(spark, sf_dir)
    variants = {"scaled": FEATURES}
    found = V.fit(rows, variants, V.starts(rows, "p_partkey", variants, [3], SEEDS))
    return K.stability(V.assign(rows, "p_partkey", variants, found), "p_partkey", "label")


def modal_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's commonest order priority, as labels of repeated runs."""
    runs = table(spark, sf_dir, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("label"))
    return K.stability(runs, "o_custkey", "label").select("o_custkey", long("modal").alias("modal"), rounded("agreement", 6).alias("agreement"))


MODAL_SQL = """
with c as (select o_custkey, cast(substr(o_orderpriority, 1, 1) as bigint) as label, count(*) as n from orders group by 1, 2),
r as (select *, sum(n) over (partition by o_custkey) as total, row_number() over (partition by o_custkey order by n desc, label) as place from c)
select o_custkey, label as modal, round(n / total, 6) as agreement from r where place = 1"""


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.level_counts(table(spark, sf_dir, "lineitem"), HOT)


HOT = ["l_returnflag", "l_linestatus"]
ONE_HOT_SQL = " union all ".join(f"select '{c}' as column_name, {c} as level, count(*) as n from lineitem where {c} is not null group by 2" for c in HOT)


def pca_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of all features from all their components."""
    rows = centres(spark, sf_dir)
    made = M.rebuilt_correlations(M.pca(FEATURES, len(FEATURES)).fit(rows), rows, FEATURES)
    return made.select("a", "b", rounded("corr", 6).alias("corr"))


PCA_REBUILT_SQL = f"with {CENTRES} " + " union all ".join(f"select '{min(a, b)}' as a, '{max(a, b)}' as b, round(corr({a}, {b}), 6) as corr from p" for i, a in enumerate(FEATURES) for b in FEATURES[i:])


def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centres(spark, sf_dir)
    model = M.pca(FEATURES, 3).fit(rows)
    return M.loadings(model, rows, FEATURES).join(M.explained(model, rows), "component")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_groups(table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000), ["l_orderkey"], 0.3)


def pooled_lines(rows: DataFrame, label: str, by: tuple | list = ()) -> DataFrame:
    """Lines of equal features pooled: of over 100 million there are some 15,000 different ones."""
    return M.pool(rows, [*LINES, "l_returnflag"], label, ["l_orderkey", "l_linenumber"], by)


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of price on quantity, as a one-feature fit finds it."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = M.regressor("linear", ["l_quantity"], "l_extendedprice").fit(rows)
    fitted = model.transform(rows)
    return fitted.agg(rounded(F.regr_slope("prediction", "l_quantity"), 3).alias("slope"), rounded(F.avg("prediction"), 3).alias("mean"))


LINEAR_SQL = "select round(regr_slope(l_extendedprice, l_quantity), 3) as slope, round(avg(l_extendedprice), 3) as mean from lineitem"


def regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out metrics of three regressors and the training mean on lines' prices.

    Depth and trees of the forest are searched by three folds of orders, depth and rate of the
    boosted trees by one split; the settings that won and their score are beside the metrics.
    """
    rows = lines(spark, sf_dir)
    train, test, judge = pooled_lines(S.kfold(rows.where("not is_test"), ["l_orderkey"], 3), "price", ["fold"]), rows.where("is_test"), M.PooledRmse("price")
    forest = M.search(M.regressor("forest", LINES, "price", ["l_returnflag"], weightCol=M.WEIGHT), FOREST_GRID, judge, folds=3, fold_col="fold", parallelism=4).fit(train)
    boosted = M.search(M.regressor("boosted", LINES, "price", ["l_returnflag"], maxIter=5, weightCol=M.WEIGHT), BOOSTED_GRID, judge, parallelism=4).fit(train)
    linear = M.regressor("linear", LINES, "price", ["l_returnflag"], weightCol=M.WEIGHT).fit(train)
    mean = test.crossJoin(F.broadcast(M.pooled_mean(train, "price")))
    found = {"linear": linear.transform(test), "forest": forest.transform(test), "boosted": boosted.transform(test), "mean": mean}
    made = A.model_table({name: A.regression_metrics(df, "price", "prediction") for name, df in found.items()})
    best = spark.createDataFrame([("forest", M.chosen(forest, FOREST_GRID), float(min(forest.avgMetrics))), ("boosted", M.chosen(boosted, BOOSTED_GRID), float(min(boosted.validationMetrics)))], "model string, setting string, searched_rmse double")
    return made.join(F.broadcast(best), "model", "left")


FOREST_GRID, BOOSTED_GRID, CLASSIFIER_GRID = {"maxDepth": [3, 6], "numTrees": [5, 10]}, {"maxDepth": [2, 4], "stepSize": [0.1, 0.3]}, {"maxDepth": [3, 6], "numTrees": [10, 20]}


def better_than_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mean's error of a charge that follows from a line's numbers, on held-out
    lines, and whether small models of each kind have less."""
    charge = F.col("l_quantity") * 2 + F.col("l_discount") * 100 + F.col("price") / 10
    rows = lines(spark, sf_dir).withColumn("charge", charge)
    train, test = pooled_lines(rows.where("not is_test"), "charge"), rows.where("is_test")
    weight = {"weightCol": M.WEIGHT}
    fits = {"linear": M.regressor("linear", LINES, "charge", **weight), "forest": M.regressor("forest", LINES, "charge", numTrees=3, maxDepth=3, **weight), "boosted": M.regressor("boosted", LINES, "charge", maxIter=2, maxDepth=3, **weight)}
    made = A.model_table({name: A.regression_metrics(fit.fit(train).transform(test), "charge", "prediction") for name, fit in fits.items()})
    mean = test.crossJoin(F.broadcast(M.pooled_mean(train, "charge")))
    base = A.regression_metrics(mean, "charge", "prediction").select(F.col("rmse").alias("mean_rmse"), F.col("mae").alias("mean_mae"))
    return made.crossJoin(F.broadcast(base)).select("model", "n", (F.col("rmse") < F.col("mean_rmse")).alias("better"), rounded("mean_rmse", 6).alias("mean_rmse"), rounded("mean_mae", 6).alias("mean_mae"))


def per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out metrics of a linear model of line number and price for each of three targets."""
    rows = lines(spark, sf_dir)
    make = lambda target: M.regressor("linear", ["l_linenumber", "price"], target)
    made = M.per_target(rows.where("not is_test"), rows.where("is_test"), LINES, make)
    return made.select("target", *(rounded(c, 6).alias(c) for c in ("mae", "mse", "rmse", "r2")), "n")


_LINES_SQL = "l as (select *, l_extendedprice / 1000 as price, cast('0x' || substr(md5(concat_ws('|', l_orderkey, '42')), 1, 8) as bigint) % 1000000 < 300000 as is_test from lineitem)"
PER_TARGET_SQL = f"with {_LINES_SQL} " + " union all ".join(
    f"""select '{t}' as target, round(avg(abs({t} - p)), 6) as mae, round(avg(({t} - p) ** 2), 6) as mse, round(sqrt(avg(({t} - p) ** 2)), 6) as rmse, round(1 - avg(({t} - p) ** 2) / var_pop({t}), 6) as r2, count(*) as n from (
  select l.{t}, my + (cxy * vz - czy * cxz) / (vx * vz - cxz * cxz) * (l_linenumber - mx) + (czy * vx - cxy * cxz) / (vx * vz - cxz * cxz) * (price - mz) as p from l, (
    select avg({t}) as my, avg(l_linenumber) as mx, avg(price) as mz, covar_pop(l_linenumber, {t}) as cxy, covar_pop(price, {t}) as czy, covar_pop(l_linenumber, price) as cxz, var_pop(l_linenumber) as vx, var_pop(price) as vz from l where not is_test) where is_test)"""
    for t in LINES
)


BETTER_SQL = f"""
with {_LINES_SQL}, h as (select is_test, l_quantity * 2 + l_discount * 100 + price / 10 as charge from l), e as (select charge - (select avg(charge) from h where not is_test) as e from h where is_test)
select model, count(*) as n, true as better, round(sqrt(avg(e * e)), 6) as mean_rmse, round(avg(abs(e)), 6) as mean_mae from e cross join (values ('linear'), ('forest'), ('boosted')) m(model) group by 1"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of held-out lines with truth, error and accuracy band."""
    rows = lines(spark, sf_dir)
    model = M.regressor("linear", LINES, "price").fit(rows.where("not is_test"))
    made = M.ledger(model, rows.where("is_test"), ["l_orderkey", "l_linenumber"], "price")
    from ..operators.bands import accuracy_band

    made = made.withColumn("pct", C.pct_error("truth", "prediction"))
    made = made.withColumn("band", accuracy_band("pct"))
    return made.select("l_orderkey", "l_linenumber", rounded("truth", 5).alias("truth"), rounded("prediction", 5).alias("prediction"), rounded("pct", 4).alias("pct"), "band")


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_COV = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
_SLOPES = [_det([[f"y{i}" if j == k else _COV[i][j] for j in range(3)] for i in range(3)]) + f" / {_det(_COV)}" for k in range(3)]
LEDGER_SQL = f"""
with {_LINES_SQL}, m as (select avg(price) as my, {", ".join(f"avg({c}) as m{i}, covar_pop({c}, price) as y{i}" for i, c in enumerate(LINES))}, {", ".join(f"covar_pop({a}, {b}) as c{i}{j}" for i, a in enumerate(LINES) for j, b in enumerate(LINES))} from l where not is_test),
b as (select *, {", ".join(f"{e} as b{k}" for k, e in enumerate(_SLOPES))} from m),
p as (select l_orderkey, l_linenumber, price as truth, my + {" + ".join(f"b{i} * ({c} - m{i})" for i, c in enumerate(LINES))} as prediction from l, b where is_test),
e as (select *, (prediction - truth) / truth * 100 as pct from p)
select l_orderkey, l_linenumber, round(truth, 5) as truth, round(prediction, 5) as prediction, round(pct, 4) as pct, case when pct <= -15 then 'Extreme Underforecast' when pct <= -5 then 'Underforecast' when pct <= 5 then 'Correct' when pct <= 15 then 'Overforecast' when pct > 15 then 'Extreme Overforecast' end as band from e"""


def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's loss of a constant prediction: square below one unit, straight beyond."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("truth"), F.lit(2.5).alias("guess"))
    huber = lambda e: F.when(F.abs(e) <= 1, e * e / 2).otherwise(F.abs(e) - 0.5)
    return A.mean_loss(rows, "truth", "guess", huber, ["l_returnflag"]).select("l_returnflag", rounded("loss", 6).alias("loss"), "n")


MEAN_LOSS_SQL = "with e as (select l_returnflag, abs(l_quantity / 10 - 2.5) as e from lineitem) select l_returnflag, round(avg(case when e <= 1 then e * e / 2 else e - 0.5 end), 6) as loss, count(*) as n from e group by 1"


def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the training labels' commonest value on the test rows."""
    rows = S.split(table(spark, sf_dir, "labels"), ["doc_id"], 0.2)
    made = A.binary_metrics(M.majority_baseline(rows.where("not is_test"), rows.where("is_test"), "quality"), "quality", "prediction", 1)
    return made.select("tp", "fp", "fn", "tn", *(rounded(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


MAJORITY_SQL = """
with l as (select *, cast('0x' || substr(md5(concat_ws('|', doc_id, '42')), 1, 8) as bigint) % 1000000 < 200000 as is_test from labels),
b as (select quality as guess from l where not is_test and quality is not null group by 1 order by count(*) desc, 1 limit 1),
m as (select count(*) filter (quality = 1 and guess = 1) as tp, count(*) filter (quality <> 1 and guess = 1) as fp, count(*) filter (quality = 1 and guess <> 1) as fn, count(*) filter (quality <> 1 and guess <> 1) as tn, avg((quality = guess)::int) as accuracy from l, b where is_test and quality is not null)
select tp, fp, fn, tn, round(accuracy, 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from m"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.range_of(table(spark, sf_dir, "lineitem"), {"l_quantity": (1, 50), "l_discount": (0, 0.05), "l_tax": (0, 1)})


RANGES_SQL = " union all ".join(f"select '{c}' as column_name, min({c})::double as low, max({c})::double as high, min({c}) >= {a} and max({c}) <= {b} as inside from lineitem" for c, a, b in (("l_quantity", 1, 50), ("l_discount", 0, 0.05), ("l_tax", 0, 1)))


def classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality from simple counts: the best of a grid of forests by folds and the majority
    baseline, held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.length(F.regexp_replace("text", "[^|#%&$!]", "")).alias("marks"))
    rows = S.split_stratified(table(spark, sf_dir, "labels").join(docs, "doc_id").select("*", F.col("quality").cast("double").alias("y")), "doc_id", "quality", 0.2)
    train, test = S.kfold(rows.where("not is_test"), ["doc_id"], 3), rows.where("is_test")
    pipeline = M.classifier(["n_chars", "marks"], "y", ["lang"])
    judge = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    model = M.search(pipeline, CLASSIFIER_GRID, judge, folds=3, fold_col="fold", parallelism=4).fit(train)
    found = {"forest": model.transform(test), "majority": M.majority_baseline(train, test, "y")}
    made = A.model_table({name: A.binary_metrics(df, "y", "prediction", 1.0) for name, df in found.items()})
    own = F.col("model") == "forest"
    return made.withColumns({"cv_accuracy": F.when(own, F.lit(float(max(model.avgMetrics)))), "setting": F.when(own, F.lit(M.chosen(model, CLASSIFIER_GRID)))})


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    train = pooled_lines(rows.where("not is_test"), "price")
    model = M.regressor("forest", LINES, "price", ["l_returnflag"], numTrees=5, maxDepth=4, weightCol=M.WEIGHT).fit(train)
    return M.importances(model, model.transform(rows))


QUERIES = {
    "tiers": (tiers, TIERS_SQL),
    "tier_profile": (tier_profile, TIER_PROFILE_SQL),
    "centroid_distance": (centroid_distances, DISTANCES_SQL),
    "silhouette": (silhouette, SILHOUETTE_SQL),
    "silhouette_squared": (silhouette_squared, SILHOUETTE_SQUARED_SQL),
    "noise_contrast": (noise_contrast, NOISE_SQL),
    "dbscan": (dbscan, DBSCAN_SQL),
    "dbscan_cells": (dbscan_cells, DBSCAN_CELLS_SQL),
    "dbscan_grid": (dbscan_grid, DBSCAN_GRID_SQL),
    "neighbours": (neighbours, NEIGHBOURS_SQL),
    "kmeans_sweep": (kmeans_sweep, None),
    "gmm": (gmm, None),
    "lloyd_step": (lloyd_step, LLOYD_SQL),
    "stability": (stability, None),
    "modal_label": (modal_label, MODAL_SQL),
    "one_hot": (one_hot, ONE_HOT_SQL),
    "pca": (pca, None),
    "pca_rebuilt": (pca_rebuilt, PCA_REBUILT_SQL),
    "better_than_mean": (better_than_mean, BETTER_SQL),
    "linear": (linear, LINEAR_SQL),
    "regressors": (regressors, None),
    "per_target": (per_target, PER_TARGET_SQL),
    "ledger": (ledger, LEDGER_SQL),
    "mean_loss": (mean_loss, MEAN_LOSS_SQL),
    "majority": (majority, MAJORITY_SQL),
    "ranges": (ranges, RANGES_SQL),
    "classifier": (classifier, None),
    "importances": (importances, None),
}
