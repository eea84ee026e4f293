"""Profiles, totals, shares, ranks, errors and metrics."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregate as A, bands as B, columns as C, joins as J, reshape as R, windows as W
from .common import long, rounded, table

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with some nulls and sentinel values."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_orderkey") % 5 == 0, "unknown").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_orderkey") % 11 == 0, -1).otherwise(F.col("l_linenumber")).alias("line"),
    )


HOLED = """
with h as (select l_orderkey, case when l_orderkey % 7 <> 0 then l_quantity end as quantity, case when l_orderkey % 5 = 0 then 'unknown' else l_returnflag end as flag,
                  case when l_orderkey % 11 = 0 then -1 else l_linenumber end as line from lineitem)"""


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.null_profile(holed(spark, sf_dir), ["quantity", "flag", "line"])


NULL_SQL = f"""{HOLED}
select 'quantity' as column_name, count(*) - count(quantity) as nulls, count(*) as n_rows from h union all
select 'flag', count(*) - count(flag), count(*) from h union all select 'line', count(*) - count(line), count(*) from h"""


def sentinel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sentinel_profile(holed(spark, sf_dir), ["flag", "line"], ["unknown", "-1"])


SENTINEL_SQL = f"""{HOLED}
select 'flag' as column_name, count(*) filter (flag = 'unknown') as n_sentinel, round(count(*) filter (flag = 'unknown') * 100 / count(*), 2) as pct from h union all
select 'line', count(*) filter (line = -1), round(count(*) filter (line = -1) * 100 / count(*), 2) from h"""


def distinct_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_profile(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


DISTINCT_SQL = """select 'p_brand' as column_name, count(distinct p_brand) as n_distinct from part union all select 'p_type', count(distinct p_type) from part union all select 'p_size', count(distinct p_size) from part"""


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATES_SQL = """select count(*) filter (n > 1) as n_repeated_keys, cast(sum(n - 1) as bigint) as n_extra_rows from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)"""


def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missing_report(holed(spark, sf_dir), "quantity", F.col("flag") == "N")


MISSING_SQL = f"""{HOLED}
select 'before' as step, count(*) as n_rows, count(*) - count(quantity) as n_missing, round((count(*) - count(quantity)) * 100.0 / count(*), 2) as pct_missing from h union all
select 'after', count(*), count(*) - count(quantity), round((count(*) - count(quantity)) * 100.0 / count(*), 2) from h where flag = 'N'"""


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.describe(table(spark, sf_dir, "lineitem"), LINE_COLUMNS, ["l_returnflag"])
    return made.select("l_returnflag", "column_name", "n", *(rounded(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))


DESCRIBE_SQL = " union all ".join(
    f"""select l_returnflag, '{c}' as column_name, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(quantile_cont({c}, 0.25), 4) as q25,
    round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75, round(max({c}), 4) as max from lineitem group by 1"""
    for c in LINE_COLUMNS
)


def multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.multi_agg(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_totalprice", "o_custkey"], ["mean", "min", "max", "nunique"])
    return made.select("o_orderpriority", *(rounded(c, 3).alias(c) for c in made.columns[1:]))


MULTI_SQL = "select o_orderpriority, " + ", ".join(f"round(cast({f}({d}{c}) as double), 3) as {c}_{n}" for c in ("o_totalprice", "o_custkey") for n, f, d in (("mean", "avg", ""), ("min", "min", ""), ("max", "max", ""), ("nunique", "count", "distinct "))) + " from orders group by 1"


def profile_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.profile_by(holed(spark, sf_dir), ["flag"], ["quantity", "line"])


PROFILE_BY_SQL = f"{HOLED} select flag, count(distinct quantity) as quantity_nunique, count(distinct line) as line_nunique, count(quantity) as quantity_count, count(line) as line_count from h where flag is not null group by 1"


def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_total(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


TOTAL_SQL = """
with t as (select case when grouping(o_orderpriority) = 1 then 'Total' else o_orderpriority end as o_orderpriority, count(o_orderkey) as n, grouping(o_orderpriority) as g from orders group by rollup (o_orderpriority))
select o_orderpriority, n, round(n * 100 / (select n from t where g = 1), 2) as pct from t"""


def customers_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))


def multi_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = [F.count(F.lit(1)).alias("n"), rounded(F.avg("c_acctbal"), 6).alias("mean_balance")]
    made = A.grouping_levels(customers_by_place(spark, sf_dir), [["r_name"], ["n_name"], ["c_mktsegment"]], measures)
    return made.select("level", F.coalesce("r_name", "n_name", "c_mktsegment").alias("cell"), "n", "mean_balance")


MULTI_LEVEL_SQL = """
with c as (select * from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select 'r_name' as level, r_name as cell, count(*) as n, round(avg(c_acctbal), 6) as mean_balance from c group by 2 union all
select 'n_name', n_name, count(*), round(avg(c_acctbal), 6) from c group by 2 union all select 'c_mktsegment', c_mktsegment, count(*), round(avg(c_acctbal), 6) from c group by 2"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices and a fixed formula that predicts them from quantity and retail price."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    truth = F.when(F.col("l_orderkey") % 50 == 0, 0.0).otherwise(F.col("l_extendedprice"))
    guess = F.when(F.col("l_orderkey") % 50 == 0, (F.col("l_linenumber") - 4) * 0.05).otherwise(F.col("l_quantity") * F.col("p_retailprice") * (1 + (F.col("p_size") % 7 - 3) * 0.03))
    return lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.quarter("l_shipdate").alias("quarter"), truth.alias("truth"), guess.alias("predicted"))


PREDICTED = """
p as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, quarter(l_shipdate) as quarter, case when l_orderkey % 50 = 0 then 0.0::double else l_extendedprice end as truth,
        case when l_orderkey % 50 = 0 then (l_linenumber - 4) * 0.05::double else l_quantity * p_retailprice * (1 + (p_size % 7 - 3) * 0.03::double) end as predicted
      from lineitem join part on l_partkey = p_partkey)"""


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by flag, by flag and status, and by quarter, flag and status."""
    rows = predicted(spark, sf_dir)
    variance = rows.agg(F.var_pop("truth").alias("v"))
    rows = rows.crossJoin(F.broadcast(variance)).withColumns(C.error_columns("truth", "predicted", "v"))
    measures = [rounded(F.avg(c), 3).alias(c) for c in ("mae", "mse", "rmse", "r2")] + [F.count("predicted").alias("n")]
    made = A.grouping_levels(rows, [["l_returnflag"], ["l_returnflag", "l_linestatus"], ["quarter", "l_returnflag", "l_linestatus"]], measures, level=None)
    return made.withColumns({"l_linestatus": F.coalesce("l_linestatus", F.lit("All")), "quarter": F.coalesce(F.col("quarter").cast("string"), F.lit("Year Round"))})


ERROR_REPORT_SQL = f"""
with {PREDICTED}, e as (select *, abs(predicted - truth) as mae, (predicted - truth) ** 2 as mse, 1 - (predicted - truth) ** 2 / var_pop(truth) over () as r2 from p)
select l_returnflag, coalesce(l_linestatus, 'All') as l_linestatus, coalesce(cast(quarter as varchar), 'Year Round') as quarter, round(avg(mae), 3) as mae, round(avg(mse), 3) as mse,
  round(avg(sqrt(mse)), 3) as rmse, round(avg(r2), 3) as r2, count(predicted) as n
from e group by grouping sets ((l_returnflag), (l_returnflag, l_linestatus), (quarter, l_returnflag, l_linestatus))"""


def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many predictions fall in each accuracy band, by both bandings, and their share."""
    rows = predicted(spark, sf_dir).withColumns({"pct": C.pct_error("truth", "predicted"), "reverse": C.pct_error("truth", "predicted", -1)})
    rows = rows.withColumns({"by_five": B.accuracy_band("pct"), "by_ten": B.accuracy_band_or_zero(F.col("reverse"), F.col("truth"), F.col("predicted"))})
    long_rows = rows.unpivot([], ["by_five", "by_ten"], "banding", "band").where("band is not null")
    made = A.value_share(long_rows, ["banding"], "band")
    return made.select("banding", "band", "n", C.fmt_int("n").alias("n_text"), rounded("pct", 2).alias("pct"))


ERROR_BANDS_SQL = f"""
with {PREDICTED}, e as (select *, case when truth <> 0 then (predicted - truth) / truth * 100 end as pct from p),
b as (select 'by_five' as banding, case when pct <= -15 then 'Extreme Underforecast' when pct <= -5 then 'Underforecast' when pct <= 5 then 'Correct' when pct <= 15 then 'Overforecast' when pct > 15 then 'Extreme Overforecast' end as band from e
  union all select 'by_ten', case when truth = 0 then case when abs(predicted) <= 0.01 then 'Accurate' when predicted > 0.1 then 'Extreme Overforecast' when predicted > 0.01 then 'Overforecast' when predicted < -0.1 then 'Extreme Underforecast' else 'Underforecast' end
    when -pct <= -10 then 'Extreme Underforecast' when -pct <= -5 then 'Underforecast' when -pct <= 5 then 'Accurate' when -pct <= 10 then 'Overforecast' when -pct > 10 then 'Extreme Overforecast' end from e)
select banding, band, count(*) as n, format('{{:,}}', count(*)) as n_text, round(count(*) * 100.0 / sum(count(*)) over (partition by banding), 2) as pct from b where band is not null group by 1, 2"""


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the formula and of a constant baseline, with a verdict on their halves."""
    rows = predicted(spark, sf_dir).withColumn("half", F.col("l_orderkey") % 2)
    mean = rows.agg(F.avg("truth").alias("mean"))
    base = rows.crossJoin(F.broadcast(mean)).withColumn("predicted", F.col("mean"))
    made = A.model_table({name: A.regression_metrics(df, "truth", "predicted", ["half"]) for name, df in {"formula": rows, "baseline": base}.items()})
    sides = made.groupBy("model").agg(*(F.max(F.when(F.col("half") == h, F.col(c))).alias(f"{c}_{h}") for c in ("mse", "r2", "rmse", "mae") for h in (0, 1)))
    verdict = B.fit_verdict(F.col("mse_0"), F.col("mse_1"), F.col("r2_0"), F.col("r2_1"))
    return sides.select("model", *(rounded(f"{c}_{h}", 2).alias(f"{c}_{h}") for c in ("rmse", "mae", "r2") for h in (0, 1)), verdict.alias("verdict"))


MODEL_TABLE_SQL = f"""
with {PREDICTED}, b as (select 'formula' as model, l_orderkey % 2 as half, truth, predicted from p union all select 'baseline', l_orderkey % 2, truth, avg(truth) over () from p),
m as (select model, half, avg((truth - predicted) ** 2) as mse, avg(abs(truth - predicted)) as mae, 1 - avg((truth - predicted) ** 2) / var_pop(truth) as r2 from b group by 1, 2),
s as (select model, {", ".join(f"max({c}) filter (half = {h}) as {c}_{h}" for c in ("mse", "mae", "r2") for h in (0, 1))} from m group by 1)
select model, round(sqrt(mse_0), 2) as rmse_0, round(sqrt(mse_1), 2) as rmse_1, round(mae_0, 2) as mae_0, round(mae_1, 2) as mae_1, round(r2_0, 2) as r2_0, round(r2_1, 2) as r2_1,
  case when mse_0 < mse_1 * 0.7 then 'overfit' when r2_0 < 0.6 and r2_1 < 0.6 then 'underfit' else 'good fit' end as verdict from s"""


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_counts(table(spark, sf_dir, "events"), "event_type")


def value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types inside each user's hours, then their mean share by hour."""
    events = table(spark, sf_dir, "events").withColumn("hour", long(F.hour("ts")))
    return A.value_share(events, ["user_id", "hour"], "event_type").groupBy("hour", "event_type").agg(F.sum("n").alias("n"), rounded(F.avg("pct"), 3).alias("pct"))


VALUE_SHARE_SQL = """
with c as (select user_id, hour(ts) as hour, event_type, count(*) as n from events group by 1, 2, 3), s as (select *, n * 100.0 / sum(n) over (partition by user_id, hour) as pct from c)
select hour, event_type, cast(sum(n) as bigint) as n, round(avg(pct), 3) as pct from s group by 1, 2"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pivot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", STATUSES, F.count(F.lit(1)))


PIVOT_SQL = "select o_orderpriority, " + ", ".join(f"count(*) filter (o_orderstatus = '{s}') as {s}" for s in STATUSES) + " from orders group by 1"


def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.transpose(pivot_counts(spark, sf_dir), "o_orderpriority", PRIORITIES, "o_orderstatus")


TRANSPOSE_SQL = "select o_orderstatus, " + ", ".join(f"count(*) filter (o_orderpriority = '{p}') as \"{p}\"" for p in PRIORITIES) + " from orders group by 1"


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


CROSSTAB_SQL = "select *, cast(sum(n) over (partition by o_orderpriority) as bigint) as total from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2)"


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in a fixed order that also has a priority which does not occur."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return R.reindex(counts, "o_orderpriority", ["6-NONE", *PRIORITIES[::-1]]).withColumn("position", long("position"))


REINDEX_SQL = "select p.o_orderpriority, position, coalesce(n, 0) as n from (values " + ", ".join(f"('{p}', {i}::bigint)" for i, p in enumerate(["6-NONE", *PRIORITIES[::-1]])) + ") p(o_orderpriority, position) left join (select o_orderpriority, count(*) as n from orders group by 1) c on p.o_orderpriority = c.o_orderpriority"


def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.corr_matrix(table(spark, sf_dir, "lineitem"), LINE_COLUMNS)
    return made.select("a", "b", rounded("corr").alias("corr"))


CORR_SQL = " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as corr from lineitem" for i, a in enumerate(LINE_COLUMNS) for b in LINE_COLUMNS[i + 1 :])


DIMENSIONS = 64


def wide_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the vectors' dimensions."""
    dims = [f"d{i}" for i in range(DIMENSIONS)]
    rows = table(spark, sf_dir, "embeddings").select(*(F.col("embedding")[i].alias(d) for i, d in enumerate(dims)))
    return A.corr_matrix(rows, dims).select("a", "b", rounded("corr", 6).alias("corr"))


WIDE_CORR_SQL = f"""
with v as (select unnest(range(1, {DIMENSIONS + 1})) as i, embedding from embeddings), c as (select i, embedding, embedding[i]::double as x, unnest(range(i + 1, {DIMENSIONS + 1})) as j from v)
select 'd' || (i - 1) as a, 'd' || (j - 1) as b, round(corr(x, embedding[j]::double), 6) as corr from c group by i, j"""


def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_features(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], 2).select("feature", rounded("corr").alias("corr"))


TOP_SQL = "select * from (" + " union all ".join(f"select '{c}' as feature, round(corr({c}, l_extendedprice), 4) as corr from lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")) + ") order by abs(corr) desc, feature limit 2"


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20, ["l_returnflag"])
    return made.select("l_returnflag", long("bin").alias("bin"), rounded("left_edge", 3).alias("left_edge"), "n")


HISTOGRAM_SQL = """
with e as (select min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem),
c as (select l_returnflag, least(19, floor((l_extendedprice - low) / ((high - low) / 20)))::bigint as bin, count(*) as n from lineitem, e group by 1, 2)
select f.l_returnflag, b.bin, round(low + b.bin * ((high - low) / 20), 3) as left_edge, coalesce(n, 0) as n
from (select distinct l_returnflag from lineitem) f cross join e cross join (select unnest(range(20)) as bin) b left join c on c.l_returnflag = f.l_returnflag and c.bin = b.bin"""


def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.box_stats(table(spark, sf_dir, "events"), "value", ["event_type"])
    return made.select("event_type", *(rounded(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")), "n_outliers")


BOX_SQL = """
with b as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by 1)
select event_type, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, round(min(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as whisker_low,
  round(max(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as whisker_high, count(*) filter (value not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers
from events join b using (event_type) group by event_type, q1, median, q3"""


def group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation: scaled balance, share, rank and whether it stands out."""
    rows = W.group_minmax(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"], "scaled")
    rows = W.group_share(rows, "s_acctbal", ["s_nationkey"], "share")
    rows = W.group_rank(rows, ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")])
    rows = W.borderline(rows, "s_acctbal", ["s_nationkey"], 1.0, "borderline")
    return rows.select("s_suppkey", rounded("scaled", 6).alias("scaled"), rounded("share", 6).alias("share"), long("place").alias("place"), "borderline")


GROUP_RANKS_SQL = """
select s_suppkey, round((s_acctbal - min(s_acctbal) over w) / nullif(max(s_acctbal) over w - min(s_acctbal) over w, 0), 6) as scaled, round(s_acctbal / nullif(sum(s_acctbal) over w, 0), 6) as share,
  row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as place, coalesce(s_acctbal > avg(s_acctbal) over w + stddev_samp(s_acctbal) over w, false) as borderline
from supplier window w as (partition by s_nationkey)"""


def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest part of each brand, and whether it is as dear as any."""
    parts = table(spark, sf_dir, "part")
    best = W.top1(parts, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")])
    most = J.argmax_rows(parts, "p_retailprice").select(F.col("p_partkey").alias("k"))
    return best.join(most, F.col("p_partkey") == F.col("k"), "left").select("p_brand", "p_partkey", "p_retailprice", F.col("k").isNotNull().alias("is_most"))


BEST_SQL = """
select p_brand, p_partkey, p_retailprice, p_retailprice = (select max(p_retailprice) from part) as is_most
from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place from part) where place = 1"""


def union_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at two levels under each other, missing keys filled."""
    orders = table(spark, sf_dir, "orders")
    one = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    two = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))
    return J.union_fill([one, two], {"o_orderstatus": "All", "o_orderpriority": "All", "customers": 0})


UNION_SQL = "select o_orderstatus, 'All' as o_orderpriority, count(*) as n, 0::bigint as customers from orders group by 1 union all select 'All', o_orderpriority, count(*), count(distinct o_custkey) from orders group by 2"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a score of the documents' length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = F.floor(F.col("n_chars") % 1000 / 10) / 100.0
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", "toxic", score.alias("score"), (score >= 0.4).cast("int").alias("predicted"))


JUDGED = "with j as (select doc_id, quality, toxic, (n_chars % 1000 // 10) / 100.0::double as score, ((n_chars % 1000 // 10) / 100.0::double >= 0.4)::int as predicted from labels join documents using (doc_id))"


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.binary_metrics(judged(spark, sf_dir), "quality", "predicted", 1)
    return made.select("tp", "fp", "fn", "tn", *(rounded(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


BINARY_SQL = f"""{JUDGED}, c as (select count(*) filter (quality = 1 and predicted = 1) as tp, count(*) filter (quality <> 1 and predicted = 1) as fp, count(*) filter (quality = 1 and predicted <> 1) as fn, count(*) filter (quality <> 1 and predicted <> 1) as tn from j)
select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c"""


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(judged(spark, sf_dir), "quality", "predicted").select(long("quality").alias("quality"), long("predicted").alias("predicted"), "n")


CONFUSION_SQL = f"{JUDGED}, l as (select unnest([0, 1]) as x) select cast(a.x as bigint) as quality, cast(b.x as bigint) as predicted, count(doc_id) as n from l a cross join l b left join j on quality = a.x and predicted = b.x group by 1, 2"


def roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.roc(judged(spark, sf_dir), "quality", "score")
    return points.crossJoin(F.broadcast(A.auc(points))).select("score", rounded("tpr", 6).alias("tpr"), rounded("fpr", 6).alias("fpr"), rounded("auc", 6).alias("auc"))


ROC_SQL = f"""{JUDGED}, s as (select score, sum(quality) as p, sum(1 - quality) as q from j group by 1),
r as (select score, sum(p) over w / sum(p) over () as tpr, sum(q) over w / sum(q) over () as fpr from s window w as (order by score desc)),
a as (select (fpr - lag(fpr, 1, 0) over w) * (tpr + lag(tpr, 1, 0) over w) / 2 as a from r window w as (order by fpr, tpr))
select score, round(tpr, 6) as tpr, round(fpr, 6) as fpr, (select round(sum(a), 6) from a) as auc from r"""


def non_converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max((F.col("value") > 50) & (F.col("event_type") == "purchase")).cast("int").alias("bought"))
    return A.non_converters(events, "user_id", "bought")


NON_SQL = "select cast(count(distinct user_id) - sum(b) as bigint) as n from (select user_id, max((value > 50 and event_type = 'purchase')::int) as b from events group by 1)"


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted score of lines, and its mean by flag with conditional sums and shares."""
    lines = table(spark, sf_dir, "lineitem").withColumn("score", C.weighted_score({"l_quantity": 0.3, "l_discount": 20.0, "l_tax": 15.0}))
    made = lines.groupBy("l_returnflag").agg(rounded(F.avg("score")).alias("score"), rounded(A.sum_if("l_quantity", F.col("l_linestatus") == "F"), 2).alias("f_quantity"), rounded(F.sum("l_quantity"), 2).alias("quantity"), rounded(A.mean_if(F.col("l_discount") > 0.05)).alias("discounted"))
    return made.withColumn("share", rounded(C.ratio("f_quantity", "quantity")))


QUALITY_SQL = """
select *, round(f_quantity / quantity, 4) as share from (select l_returnflag, round(avg(l_quantity * 0.3 + l_discount * 20 + l_tax * 15), 4) as score, round(sum(l_quantity) filter (l_linestatus = 'F'), 2) as f_quantity,
  round(sum(l_quantity), 2) as quantity, round(avg((l_discount > 0.05)::int), 4) as discounted from lineitem group by 1)"""

def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types as two methods' experiments, their mean price as a score."""
    parts = table(spark, sf_dir, "part").withColumn("k", long(F.col("p_size") % 4 + 2))
    tried = lambda c: parts.groupBy(F.col(c).alias("experiment"), "k").agg(rounded(F.avg("p_retailprice") / 2000 - 0.3, 6).alias("score"))
    made = A.leaderboard({"brands": tried("p_brand"), "types": tried("p_type")}, "score", "k", 3, ["experiment"])
    return made.withColumn("gain", rounded("gain"))


LEADERBOARD_SQL = """
with t as (select 'brands' as method, p_brand as experiment, p_size % 4 + 2 as k, round(avg(p_retailprice) / 2000 - 0.3, 6) as score from part group by 2, 3
  union all select 'types', p_type, p_size % 4 + 2, round(avg(p_retailprice) / 2000 - 0.3, 6) from part group by 2, 3),
s as (select *, 'overall' as scope from t where score > 0 union all select *, 'k=3' from t where score > 0 and k = 3),
b as (select *, row_number() over (partition by method, scope order by score desc, experiment) as place from s),
w as (select method, scope, experiment, cast(k as bigint) as k, score from b where place = 1),
g as (select a.*, (a.score - (select max(o.score) from w o where o.scope = a.scope and o.method <> a.method)) * 100 as gain from w a)
select * replace (round(gain, 4) as gain), case when gain is null then 'alone' when gain > 0 then 'outperforms' else 'does not outperform' end as verdict from g"""


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by mean price less their share of small parts, both scaled; prices beside by id."""
    parts = table(spark, sf_dir, "part")
    rows = parts.groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"), A.mean_if(F.col("p_size") < 10).alias("small"))
    made = W.combined_score(rows, "price", "small", "score")
    most = parts.groupBy("p_brand").agg(F.max("p_retailprice").alias("most"))
    zipped = J.attach(J.zip_on_id([made, most], "p_brand"), C.flags(parts, {"is_huge": ("p_size", 50)}).groupBy("p_brand").agg(F.max("is_huge").alias("has_huge")), "p_brand")
    return zipped.select("p_brand", rounded("score", 6).alias("score"), "most", "has_huge")


COMBINED_SQL = """
with b as (select p_brand, avg(p_retailprice) as price, avg((p_size < 10)::int) as small, max(p_retailprice) as most, bool_or(p_size = 50) as has_huge from part group by 1)
select p_brand, round((price - min(price) over ()) / (max(price) over () - min(price) over ()) - (small - min(small) over ()) / (max(small) over () - min(small) over ()), 6) as score, most, has_huge from b"""

QUERIES = {
    "leaderboard": (leaderboard, LEADERBOARD_SQL),
    "combined_score": (combined, COMBINED_SQL),
    "null_profile": (null_profile, NULL_SQL),
    "sentinel_profile": (sentinel_profile, SENTINEL_SQL),
    "distinct_profile": (distinct_profile, DISTINCT_SQL),
    "duplicates": (duplicates, DUPLICATES_SQL),
    "missing_report": (missing_report, MISSING_SQL),
    "describe": (describe, DESCRIBE_SQL),
    "multi_agg": (multi_agg, MULTI_SQL),
    "profile_by": (profile_by, PROFILE_BY_SQL),
    "total_rows": (total_rows, TOTAL_SQL),
    "multi_level": (multi_level, MULTI_LEVEL_SQL),
    "error_report": (error_report, ERROR_REPORT_SQL),
    "error_bands": (error_bands, ERROR_BANDS_SQL),
    "model_table": (model_table, MODEL_TABLE_SQL),
    "value_counts": (value_counts, "select event_type, count(*) as n from events where event_type is not null group by 1"),
    "value_share": (value_share, VALUE_SHARE_SQL),
    "pivot_counts": (pivot_counts, PIVOT_SQL),
    "transpose": (transposed, TRANSPOSE_SQL),
    "crosstab": (crosstab, CROSSTAB_SQL),
    "reindex": (reindexed, REINDEX_SQL),
    "corr_matrix": (corr_matrix, CORR_SQL),
    "wide_corr": (wide_corr, WIDE_CORR_SQL),
    "top_features": (top_features, TOP_SQL),
    "histogram": (histogram, HISTOGRAM_SQL),
    "box_stats": (box_stats, BOX_SQL),
    "group_ranks": (group_ranks, GROUP_RANKS_SQL),
    "best_rows": (best_rows, BEST_SQL),
    "union_fill": (union_fill, UNION_SQL),
    "binary_metrics": (binary_metrics, BINARY_SQL),
    "confusion": (confusion, CONFUSION_SQL),
    "roc": (roc, ROC_SQL),
    "non_converters": (non_converters, NON_SQL),
    "weighted_quality": (quality, QUALITY_SQL),
}
