"""Files written from the tables and read back: what comes back is what the tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import columns as C, models as M
from ..operators.checkpoints import ensure
from ..operators.parts import text_parts, write_parts
from ..sources import files
from .common import long, rounded, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    ensure(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files/{name}-{uuid.uuid4().hex}"


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return files.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")


CSV_SQL = "select cast(s_suppkey as bigint) as s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, cast(s_acctbal as double) as s_acctbal from supplier"


def csv_semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with semicolons; what is no number becomes null and its line is kept."""
    path = folder(spark, "semicolons")
    balance = F.when(F.col("c_custkey") % 10 == 0, F.lit("unknown")).otherwise(F.col("c_custkey").cast("string"))
    table(spark, sf_dir, "customer").select("c_custkey", balance.alias("number"), "c_mktsegment").write.option("header", True).option("sep", ";").csv(path)
    read = files.read_csv(spark, path, "c_custkey long, number long, c_mktsegment string, line string", sep=";", corrupt="line")
    return read.select("c_custkey", "number", "c_mktsegment", F.col("line").isNotNull().alias("is_corrupt"))


SEMICOLONS_SQL = "select cast(c_custkey as bigint) as c_custkey, cast(case when c_custkey % 10 <> 0 then c_custkey end as bigint) as number, c_mktsegment, c_custkey % 10 = 0 as is_corrupt from customer"


def parquet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = files.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return read.groupBy("l_returnflag").agg(rounded(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("n"))


PROJECTION_SQL = "select l_returnflag, round(cast(sum(l_quantity) as double), 2) as quantity, count(*) as n from lineitem group by 1"


def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of part types by brand, written as one JSON value and read as rows."""
    path = folder(spark, "sets")
    # a brand's types and the brands are bounded by the catalogue, not by the rows
    sets = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("types"))
    sets.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("p_brand", "types"))).alias("feature_sets"))).alias("value")).write.text(path)
    return files.feature_sets(spark, path).select("set_name", long("position").alias("position"), "feature")


SETS_SQL = "select p_brand as set_name, row_number() over (partition by p_brand order by p_type) - 1 as position, p_type as feature from (select distinct p_brand, p_type from part)"


def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by a set's names from a JSON file, without two targets, read and added up."""
    path = folder(spark, "names")
    names = {"small": ["l_quantity", "l_tax", "l_discount", "l_linenumber"], "all": ["l_orderkey"]}
    value = F.to_json(F.struct(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v))))).alias("feature_sets")))
    spark.range(1).select(value.alias("value")).write.text(path)
    chosen = files.feature_columns(files.feature_sets(spark, path), "small", drop=["l_tax", "l_linenumber"])
    read = files.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", *chosen])
    return read.groupBy("l_returnflag").agg(*(rounded(F.sum(c), 2).alias(c) for c in chosen))


PROJECTED_SQL = "select l_returnflag, round(cast(sum(l_quantity) as double), 2) as l_quantity, round(cast(sum(l_discount) as double), 2) as l_discount from lineitem group by 1"


def reused_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary that is made once: the second call finds it and makes nothing."""
    path = folder(spark, "reused")
    make = lambda: table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    files.materialise(make, spark, path)
    return files.materialise(lambda: make().where("n < 0"), spark, path)


REUSED_SQL = "select o_orderstatus, count(*) as n from orders group by 1"


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of rows as text of JSON lines, in parts of about 500 characters."""
    path = folder(spark, "texts")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1).orderBy("n_nationkey").write.option("header", True).csv(path)
    read = files.read_texts(spark, path, "csv", 500)
    return read.select("part", F.md5("content").alias("md5"), long(F.length("content")).alias("n_chars"))


TEXTS_SQL = """
with t as (select n_nationkey as k, '{"n_nationkey":"' || n_nationkey || '","n_name":"' || n_name || '"}' as line from nation),
n as (select *, sum(length(line) + 1) over (order by k) - length(line) - 1 as start from t),
g as (select start // 500 as part, string_agg(line, chr(10) order by k) as content from n group by 1)
select cast(part as bigint) as part, md5(content) as md5, length(content) as n_chars from g"""


def written_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order comments as one long text, written as files in order and read back line by line."""
    path = folder(spark, "parts")
    orders = table(spark, sf_dir, "orders")
    line = F.format_string("%d %s", "o_orderkey", "o_orderpriority")
    parts = text_parts(orders, ["o_orderstatus"], ["o_orderkey"], F.char_length(line) + 1, line, "\n", 20_000)
    write_parts(parts, path, ["o_orderstatus", "part"])
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), "value")
    return lines.select(F.split("value", " ", 2).alias("v")).select(long(F.col("v")[0]).alias("o_orderkey"), F.col("v")[1].alias("o_orderpriority"))


WRITTEN_SQL = "select o_orderkey, o_orderpriority from orders"


def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline saved, loaded and applied."""
    path = folder(spark, "model")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    files.save_model(M.regressor("linear", ["size"], "p_retailprice").fit(rows), path)
    made = files.load_model(path).transform(rows)
    return made.select("p_partkey", rounded("prediction", 3).alias("prediction"))


SAVED_SQL = "select p_partkey, round(a + b * p_size, 3) as prediction from part, (select regr_intercept(p_retailprice, p_size) as a, regr_slope(p_retailprice, p_size) as b from part)"


def selected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by a part of their name, and a flag set anew for some rows."""
    nations = table(spark, sf_dir, "nation")
    regional = (F.col("n_regionkey") == 2).alias("is_asian")
    made = nations.select(*C.select_like(nations, "key"), "n_name", regional)
    return made.select(long("n_nationkey").alias("n_nationkey"), long("n_regionkey").alias("n_regionkey"), C.override("is_asian", F.col("n_name").contains("RUSSIA"), True).alias("is_asian"))


SELECTED_SQL = "select cast(n_nationkey as bigint) as n_nationkey, cast(n_regionkey as bigint) as n_regionkey, n_name like '%RUSSIA%' or n_regionkey = 2 as is_asian from nation"

QUERIES = {
    "csv_roundtrip": (csv_roundtrip, CSV_SQL),
    "csv_semicolons": (csv_semicolons, SEMICOLONS_SQL),
    "parquet_projection": (parquet_projection, PROJECTION_SQL),
    "feature_sets": (feature_sets, SETS_SQL),
    "feature_projection": (feature_projection, PROJECTED_SQL),
    "reused_table": (reused_table, REUSED_SQL),
    "whole_texts": (whole_texts, TEXTS_SQL),
    "written_parts": (written_parts, WRITTEN_SQL),
    "saved_model": (saved_model, SAVED_SQL),
    "selected_columns": (selected_columns, SELECTED_SQL),
}
