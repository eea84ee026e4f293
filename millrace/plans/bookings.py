"""Bookings and flights: recovery, coverage, occupied days, the master tables.

Orders stand for bookings, the customer's region for the terminal and market segment for the
car park, the order date for the start, the first line's ship date for the end. Lines stand for
flights by ship date and the supplier's region. The first of each month is a holiday.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import columns as C, joins as J, reshape as R
from ..operators.aggregate import mean_if, sum_if
from .common import long, rounded, table

FIRST, LAST = "1995-01-01", "1995-03-31"


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("closed_at"))


def stay_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays on each day of the window, and stays without a day in it as a null day."""
    stays = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("started_at")).join(ends(spark, sf_dir), "o_orderkey", "left")
    days = R.explode_days(stays, "started_at", "closed_at", "day", FIRST, LAST)
    return days.groupBy("day").agg(F.count("o_orderkey").alias("n_stays"), rounded(F.sum("o_totalprice"), 2).alias("revenue"))


STAY_DAYS_SQL = f"""
with ends as (select l_orderkey, min(l_shipdate) as closed_at from lineitem group by 1),
stays as (select o_orderkey, o_totalprice, greatest(cast(o_orderdate as date), date '{FIRST}') as low,
                 case when closed_at is not null then least(cast(closed_at as date), date '{LAST}') end as high
          from orders left join ends on o_orderkey = l_orderkey),
days as (select o_orderkey, o_totalprice, unnest(generate_series(low, high, interval 1 day)) as day from stays where high >= low
         union all select o_orderkey, o_totalprice, null from stays where high is null or high < low)
select cast(day as date) as day, count(o_orderkey) as n_stays, round(sum(o_totalprice), 2) as revenue from days group by 1"""


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("carpark"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("terminal"))
    made = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(ends(spark, sf_dir), "o_orderkey", "left")
    created = F.col("o_orderdate") - F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"), F.lit(6))
    return made.select(
        "o_orderkey",
        "terminal",
        "carpark",
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("booking_status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_discount"),
        F.col("o_orderdate").alias("started_at"),
        "closed_at",
        C.whole_days("o_orderdate", "closed_at").alias("duration_days"),
        C.whole_days(created, "o_orderdate").alias("lead_days"),
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("terminal"))
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.where((F.col("l_shipdate") >= F.lit(FIRST).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.date_add(F.lit(LAST).cast("date"), 1).cast("timestamp_ntz")))
    lines = C.cast_all(lines, {"l_returnflag": "string"}).withColumns({"is_international": F.col("l_returnflag") == "R", "is_europe": F.col("l_linestatus") == "F"})
    made = lines.groupBy(F.to_date("l_shipdate").alias("day"), "terminal").agg(
        F.countDistinct("l_orderkey").alias("total_flights"),
        F.sum("l_quantity").alias("total_passengers"),
        F.sum(C.flag(F.col("is_international"))).alias("intl_flights"),
        sum_if("l_quantity", F.col("is_international")).alias("intl_pax"),
        sum_if("l_quantity", F.col("is_europe")).alias("europe_pax"),
    )
    return made.withColumns({"intl_share": C.ratio("intl_pax", "total_passengers"), "europe_share": C.ratio("europe_pax", "total_passengers")})


def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily master table. The window clips stays before they explode."""
    days = R.explode_days(bookings(spark, sf_dir), "started_at", "closed_at", "day", FIRST, LAST, outer=False)
    daily = days.groupBy("day", "terminal", "carpark").agg(
        F.count("day").alias("occupancy"),
        F.sum("amount").alias("total_revenue"),
        F.avg("duration_days").alias("avg_duration"),
        F.min("duration_days").alias("min_duration"),
        F.avg("lead_days").alias("avg_lead"),
        F.sum(C.flag(F.col("is_discount"))).alias("discounted"),
        mean_if(F.col("is_discount")).alias("discount_ratio"),
        mean_if(F.col("booking_status") == "F").alias("cancel_ratio"),
    )
    parts = {"dow": F.weekday("day"), "month": F.month("day"), "is_weekend": F.weekday("day").isin(5, 6).cast("int"), "week": F.weekofyear("day"), "quarter": F.quarter("day"), "iso_year": F.extract(F.lit("YEAROFWEEK"), F.col("day"))}
    joined = J.left_join(daily.withColumns(parts), flights(spark, sf_dir), [("day", "day"), ("terminal", "terminal")])
    calendar = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("holiday_date")).distinct()
    flagged = J.calendar_flag(joined, "day", calendar, "holiday_date", "holiday")
    filled = flagged.na.fill(0, ["total_flights", "total_passengers", "intl_flights", "intl_share", "europe_share"])
    # Codes come from the dimensions, so that the daily table is made once.
    terminals = table(spark, sf_dir, "region").select(F.col("r_name").alias("terminal"))
    carparks = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("carpark"))
    return C.category_code(C.category_code(filled, "terminal", "terminal_num", levels=terminals), "carpark", "carpark_num", levels=carparks)


def occupancy_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = occupancy(spark, sf_dir)
    whole = ["occupancy", "min_duration", "discounted", "dow", "month", "is_weekend", "week", "quarter", "iso_year", "total_flights", "intl_flights", "holiday", "terminal_num", "carpark_num"]
    real = ["total_revenue", "avg_duration", "avg_lead", "discount_ratio", "cancel_ratio", "total_passengers", "intl_share", "europe_share"]
    return made.select("day", "terminal", "carpark", *(long(c).alias(c) for c in whole), *(rounded(c).alias(c) for c in real))


def occupancy_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c: F.min_by(c, "day")
    made = occupancy(spark, sf_dir).groupBy("iso_year", "week", "terminal", "carpark").agg(
        F.sum("occupancy").alias("occupancy"),
        rounded(F.sum("total_revenue")).alias("total_revenue"),
        rounded(F.avg("avg_duration")).alias("avg_duration"),
        F.min("min_duration").alias("min_duration"),
        rounded(F.avg("discount_ratio")).alias("discount_ratio"),
        long(first("dow")).alias("dow"),
        long(F.max("holiday")).alias("holiday"),
        F.sum("total_flights").alias("total_flights"),
        rounded(F.avg("intl_share")).alias("intl_share"),
        long(first("terminal_num")).alias("terminal_num"),
    )
    return made.withColumns({"iso_year": long("iso_year"), "week": long("week")})


MASTER = f"""
with ends as (select l_orderkey, min(l_shipdate) as closed_at from lineitem group by 1),
bookings as (select o.*, r_name as terminal, c_mktsegment as carpark, closed_at,
    floor(date_diff('second', o_orderdate, closed_at) / 86400.0) as duration_days,
    floor(date_diff('second', o_orderdate - to_days(cast(o_orderkey % 30 as int)) - interval 6 hour, o_orderdate) / 86400.0) as lead_days
  from orders o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  left join ends on o_orderkey = l_orderkey),
clipped as (select *, greatest(cast(o_orderdate as date), date '{FIRST}') as low, case when closed_at is not null then least(cast(closed_at as date), date '{LAST}') end as high from bookings),
days as (select *, cast(unnest(generate_series(low, high, interval 1 day)) as date) as day from clipped where high >= low),
daily as (select day, terminal, carpark, count(*) as occupancy, sum(o_totalprice) as total_revenue, avg(duration_days) as avg_duration, min(duration_days) as min_duration,
    avg(lead_days) as avg_lead, count(*) filter (o_orderpriority = '1-URGENT') as discounted, avg(case when o_orderpriority = '1-URGENT' then 1.0 else 0.0 end) as discount_ratio,
    avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as cancel_ratio from days group by 1, 2, 3),
flights as (select cast(l_shipdate as date) as day, r_name as terminal, count(distinct l_orderkey) as total_flights, sum(l_quantity) as total_passengers,
    count(*) filter (l_returnflag = 'R') as intl_flights, coalesce(sum(l_quantity) filter (l_returnflag = 'R'), 0) as intl_pax, coalesce(sum(l_quantity) filter (l_linestatus = 'F'), 0) as europe_pax
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2),
holidays as (select distinct cast(date_trunc('month', o_orderdate) as date) as holiday_date from orders),
terminals as (select terminal, row_number() over (order by terminal) - 1 as terminal_num from (select distinct terminal from daily)),
carparks as (select carpark, row_number() over (order by carpark) - 1 as carpark_num from (select distinct carpark from daily)),
master as (select d.*, cast(isodow(d.day) - 1 as bigint) as dow, month(d.day) as month, case when isodow(d.day) > 5 then 1 else 0 end as is_weekend, weekofyear(d.day) as week,
    quarter(d.day) as quarter, isoyear(d.day) as iso_year, coalesce(total_flights, 0) as total_flights, coalesce(total_passengers, 0) as total_passengers, coalesce(intl_flights, 0) as intl_flights,
    coalesce(intl_pax / nullif(total_passengers, 0), 0) as intl_share, coalesce(europe_pax / nullif(total_passengers, 0), 0) as europe_share,
    case when holiday_date is not null then 1 else 0 end as holiday, terminal_num, carpark_num
  from daily d left join flights f on d.day = f.day and d.terminal = f.terminal left join holidays on d.day = holiday_date
  join terminals t on d.terminal = t.terminal join carparks c on d.carpark = c.carpark)"""
OCCUPANCY_MASTER_SQL = f"""{MASTER}
select day, terminal, carpark, occupancy, cast(min_duration as bigint) as min_duration, discounted, dow, cast(month as bigint) as month, cast(is_weekend as bigint) as is_weekend,
  cast(week as bigint) as week, cast(quarter as bigint) as quarter, cast(iso_year as bigint) as iso_year, total_flights, intl_flights, cast(holiday as bigint) as holiday, terminal_num, carpark_num,
  round(total_revenue, 4) as total_revenue, round(avg_duration, 4) as avg_duration, round(avg_lead, 4) as avg_lead, round(discount_ratio, 4) as discount_ratio, round(cancel_ratio, 4) as cancel_ratio,
  round(cast(total_passengers as double), 4) as total_passengers, round(intl_share, 4) as intl_share, round(europe_share, 4) as europe_share from master"""
OCCUPANCY_WEEKLY_SQL = f"""{MASTER}
select cast(iso_year as bigint) as iso_year, cast(week as bigint) as week, terminal, carpark, cast(sum(occupancy) as bigint) as occupancy, round(sum(total_revenue), 4) as total_revenue,
  round(avg(avg_duration), 4) as avg_duration, cast(min(min_duration) as bigint) as min_duration, round(avg(discount_ratio), 4) as discount_ratio, cast(min_by(dow, day) as bigint) as dow,
  cast(max(holiday) as bigint) as holiday, cast(sum(total_flights) as bigint) as total_flights, round(avg(intl_share), 4) as intl_share, cast(min_by(terminal_num, day) as bigint) as terminal_num
from master group by 1, 2, 3, 4"""


def recover_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the lines lose their supplier's nation; a reference of solvent suppliers gives
    some of them back."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(suppliers.drop("s_acctbal"), "l_suppkey", "left")
    holed = lines.withColumn("nation", F.when(F.col("l_orderkey") % 7 != 0, F.col("nation")))
    found = J.recover(holed, suppliers.where("s_acctbal > 2000"), ["l_suppkey"], "nation")
    return found.groupBy(long("nation").alias("nation")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 2).alias("quantity"))


RECOVER_SQL = """
with s as (select l_orderkey, l_quantity, case when l_orderkey % 7 <> 0 then s_nationkey end as had, case when s_acctbal > 2000 then s_nationkey end as found
           from lineitem left join supplier on l_suppkey = s_suppkey)
select cast(coalesce(had, found) as bigint) as nation, count(*) as n, round(sum(l_quantity), 2) as quantity from s group by 1"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed orders on the days that shipped lines cover."""
    lines = table(spark, sf_dir, "lineitem")
    kept = J.coverage_filter(table(spark, sf_dir, "orders"), "o_orderdate", lines, "l_shipdate", F.col("o_orderstatus") == "F")
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


COVERAGE_SQL = """
with ends as (select min(cast(l_shipdate as date)) as low, max(cast(l_shipdate as date)) as high from lineitem)
select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders, ends
where o_orderstatus = 'F' and o_orderdate >= low and o_orderdate < high + interval 1 day group by 1"""


def melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator columns of each line's flag melted to one name each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", *(C.flag(F.col("l_returnflag") == x).alias(f"flag_{x}") for x in "ANR"))
    made = R.melt_indicators(lines, ["flag_A", "flag_N", "flag_R"], "flag_name")
    return made.groupBy("flag_name").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 2).alias("quantity"))


MELTED_SQL = "select 'flag_' || l_returnflag as flag_name, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem where l_returnflag in ('A', 'N', 'R') group by 1"

QUERIES = {
    "stay_days": (stay_days, STAY_DAYS_SQL),
    "occupancy_master": (occupancy_master, OCCUPANCY_MASTER_SQL),
    "occupancy_weekly": (occupancy_weekly, OCCUPANCY_WEEKLY_SQL),
    "recover_attribute": (recover_attribute, RECOVER_SQL),
    "coverage_filter": (coverage, COVERAGE_SQL),
    "melt_indicators": (melted, MELTED_SQL),
}
