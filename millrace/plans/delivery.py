"""Order picking: cleaning, delivery time bands, operator speed.

Lines stand for picks: return flag A for not-available goods, R for general ones, N for normal
picks; line status F for goods by weight, O for goods by piece; a year for an hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bands as B, columns as C, windows as W
from ..operators.aggregate import span_hours
from .common import long, rounded, table

YEAR = 365.0
ORDER = ("l_linenumber", "l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def clean_lines(lines: DataFrame) -> DataFrame:
    """First line of each order and product, general goods out, quantities by rule."""
    first = W.dedup_first(lines, ["l_orderkey", "l_partkey"], [F.col(c) for c in ORDER])
    kept = first.where(~F.col("l_returnflag").isin("R"))
    weighed = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")
    quantity = C.rules([(F.col("l_returnflag") == "A", 0.0), (weighed, F.col("l_quantity")), (F.col("l_linestatus") == "O", F.col("l_quantity"))])
    return kept.withColumn("final_qty", quantity)


def deliveries(clean: DataFrame) -> DataFrame:
    made = clean.groupBy("l_orderkey").agg(
        (span_hours("l_shipdate") / (24 * YEAR)).alias("pack_time"),
        F.countDistinct("l_suppkey").alias("operator_count"),
        F.countDistinct("l_partkey").alias("product_count"),
        F.coalesce(F.sum("final_qty"), F.lit(0.0)).alias("units_count"),
    )
    label, ordinal = B.band("pack_time", *B.PACK_TIME, include_lowest=True)
    return made.withColumns({"band": label, "ordinal": ordinal, "picking_speed": C.rate("units_count", "pack_time")})


def delivery_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deliveries(clean_lines(table(spark, sf_dir, "lineitem")))
    made = B.band_summary(found, "band", "ordinal", "l_orderkey", B.PACK_TIME[1])
    return made.select("band", long("ordinal").alias("ordinal"), "n_members", "proportion", "cumulative")


def delivery_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deliveries(clean_lines(table(spark, sf_dir, "lineitem")))
    return found.select("l_orderkey", rounded("pack_time", 6).alias("pack_time"), "operator_count", "product_count", rounded("units_count").alias("units_count"), rounded("picking_speed", 3).alias("picking_speed"))


CLEAN = """
clean as (
  select *, case when l_linestatus = 'O' then l_quantity when l_linestatus = 'F' and l_returnflag = 'N' then l_quantity
                 when l_returnflag = 'A' then 0.0 end as final_qty
  from (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_shipdate, l_suppkey, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as place from lineitem)
  where place = 1 and l_returnflag <> 'R'),
deliveries as (
  select l_orderkey, date_diff('second', min(l_shipdate), max(l_shipdate)) / 3600.0 / (24 * 365.0) as pack_time,
         count(distinct l_suppkey) as operator_count, count(distinct l_partkey) as product_count, coalesce(sum(final_qty), 0.0) as units_count
  from clean group by l_orderkey)"""
BANDS = "(values (0, '< 1 hour'), (1, '1-2 hours'), (2, '2-3 hours'), (3, '3-4 hours'), (4, '4-5 hours'), (5, '5-6 hours'), (6, '6-7 hours'), (7, '> 7 hours'))"
DELIVERY_BANDS_SQL = f"""
with {CLEAN},
counted as (select case when pack_time <= 1 then 0 when pack_time > 7 then 7 else cast(ceil(pack_time) as int) - 1 end as ordinal, count(distinct l_orderkey) as n
            from deliveries where pack_time >= 0 group by 1),
shares as (select b.ordinal, b.band, coalesce(n, 0) as n_members, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) over (), 2) as proportion
           from {BANDS} b(ordinal, band) left join counted c on b.ordinal = c.ordinal)
select band, cast(ordinal as bigint) as ordinal, n_members, cast(proportion as double) as proportion, round(cast(sum(proportion) over (order by ordinal) as double), 2) as cumulative from shares"""
DELIVERY_SPEED_SQL = f"""
with {CLEAN}
select l_orderkey, round(pack_time, 6) as pack_time, operator_count, product_count, round(units_count, 4) as units_count,
       round(case when pack_time <> 0 then units_count / pack_time when units_count <> 0 then 0.0 end, 3) as picking_speed from deliveries"""


def operators(events: DataFrame) -> DataFrame:
    """Distinct orders of each operator and hour, then the mean hour of each operator."""
    hours = events.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.countDistinct("event_id").alias("orders"))
    return hours.groupBy("user_id").agg(F.avg("orders").alias("orders_per_hour"))


def operator_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = W.cum_rank_pct(operators(table(spark, sf_dir, "events")), "orders_per_hour", ["user_id"], "pct_cumsum")
    label, _ = B.band("orders_per_hour", *B.OPERATOR_SPEED)
    return made.select("user_id", rounded("orders_per_hour").alias("orders_per_hour"), long("position").alias("position"), rounded("pct_cumsum").alias("pct_cumsum"), label.alias("band"))


def operator_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, ordinal = B.band("orders_per_hour", *B.OPERATOR_SPEED)
    banded = operators(table(spark, sf_dir, "events")).withColumns({"band": label, "ordinal": ordinal})
    made = B.band_summary(banded, "band", "ordinal", "user_id", B.OPERATOR_SPEED[1], descending=True)
    return made.select("band", long("ordinal").alias("ordinal"), "n_members", "proportion", "cumulative")


SPEED = """
with hours as (select user_id, hour(ts) as h, count(distinct event_id) as orders from events group by 1, 2),
speed as (select user_id, avg(orders) as orders_per_hour from hours group by 1)"""
OPERATOR_SPEED_SQL = f"""{SPEED},
placed as (select *, row_number() over (order by orders_per_hour, user_id) - 1 as position from speed)
select user_id, round(orders_per_hour, 4) as orders_per_hour, position,
       round(sum(position) over (order by position) * 100.0 / nullif(sum(position) over (), 0), 4) as pct_cumsum,
       case when orders_per_hour <= 0 or orders_per_hour > 24 then null when orders_per_hour <= 4 then '0 - 4' when orders_per_hour <= 8 then '4 - 8'
            when orders_per_hour <= 12 then '8 - 12' when orders_per_hour <= 16 then '12 - 16' when orders_per_hour <= 20 then '16 - 20' else '20 - 24' end as band
from placed"""
OPERATOR_BANDS_SQL = f"""{SPEED},
counted as (select cast(ceil(orders_per_hour / 4) as int) - 1 as ordinal, count(distinct user_id) as n from speed where orders_per_hour > 0 and orders_per_hour <= 24 group by 1),
full_bands as (select b.ordinal, b.band, coalesce(n, 0) as n
  from (values (0, '0 - 4'), (1, '4 - 8'), (2, '8 - 12'), (3, '12 - 16'), (4, '16 - 20'), (5, '20 - 24')) b(ordinal, band) left join counted c on b.ordinal = c.ordinal)
select band, cast(ordinal as bigint) as ordinal, n as n_members, cast(round(n * 100.0 / sum(n) over (), 2) as double) as proportion,
       cast(round(sum(n) over (order by ordinal desc) * 100.0 / sum(n) over (), 2) as double) as cumulative from full_bands"""

QUERIES = {
    "delivery_bands": (delivery_bands, DELIVERY_BANDS_SQL),
    "delivery_speed": (delivery_speed, DELIVERY_SPEED_SQL),
    "operator_speed": (operator_speed, OPERATOR_SPEED_SQL),
    "operator_bands": (operator_bands, OPERATOR_BANDS_SQL),
}
