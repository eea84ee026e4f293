"""Derived features, validity checks, imputation and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo
from ..operators import bands as B, cluster as K, columns as C, joins as J, splits as S, windows as W
from ..operators.aggregate import grouping_levels, mean_if, names_by
from .common import long, rounded, table

# Seasons of months and steadiness of segments.
SEASONS = {m: s for s, months in {"winter": (1, 2, 12), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}.items() for m in months}
STEADINESS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "MACHINERY": 3}


def bank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their last order: bands, season, debt, ratios and scores."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("campaign"), F.max("o_orderdate").alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("previous"))
    df = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["campaign", "previous"])
    age, call = (F.col("c_custkey") % 110).cast("double"), (F.col("c_custkey") * 7 % 900).cast("double")
    debt, owns = F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") % 3 == 0
    rich = (F.col("c_acctbal") > 5000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    made = {
        "age_group": B.band(age, *B.AGE)[0],
        "balance_level": B.band("c_acctbal", *B.BALANCE)[0],
        "call_length": B.band(call, *B.CALL_LENGTH)[0],
        "season": C.map_values(F.month("last"), SEASONS),
        "job_stability": long(C.map_values("c_mktsegment", STEADINESS)),
        "has_debt": long(C.flag(debt | owns)),
        "high_value": long(C.flag(rich)),
        "risk_score": long(C.flag_score(debt, owns, F.col("c_acctbal") < 0)),
        "is_month_end": long(C.flag(F.dayofmonth("last") > 25)),
        "contact_ratio": rounded(C.guarded_ratio("previous", "campaign"), 6),
    }
    return df.select("c_custkey", *(c.alias(n) for n, c in made.items()))


BANK_SQL = """
with d as (select c.*, coalesce(campaign, 0) as campaign, coalesce(previous, 0) as previous, last from customer c left join
  (select o_custkey, count(*) as campaign, count(*) filter (o_orderstatus = 'F') as previous, max(o_orderdate) as last from orders group by 1) on c_custkey = o_custkey)
select c_custkey,
  case when c_custkey % 110 = 0 or c_custkey % 110 > 100 then null when c_custkey % 110 <= 30 then 'young' when c_custkey % 110 <= 45 then 'adult' when c_custkey % 110 <= 60 then 'middle' else 'senior' end as age_group,
  case when c_acctbal <= 0 then 'negative' when c_acctbal <= 1000 then 'low' when c_acctbal <= 10000 then 'medium' else 'high' end as balance_level,
  case when c_custkey * 7 % 900 = 0 then null when c_custkey * 7 % 900 <= 60 then 'very_short' when c_custkey * 7 % 900 <= 180 then 'short' when c_custkey * 7 % 900 <= 600 then 'medium' else 'long' end as call_length,
  case when month(last) in (12, 1, 2) then 'winter' when month(last) <= 5 then 'spring' when month(last) <= 8 then 'summer' when month(last) <= 11 then 'autumn' end as season,
  cast(case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1 when 'FURNITURE' then 2 when 'MACHINERY' then 3 end as bigint) as job_stability,
  cast(c_nationkey % 2 = 0 or c_nationkey % 3 = 0 as bigint) as has_debt,
  cast(c_acctbal > 5000 and c_mktsegment in ('BUILDING', 'MACHINERY') as bigint) as high_value,
  cast((c_nationkey % 2 = 0)::int + (c_nationkey % 3 = 0)::int + (c_acctbal < 0)::int as bigint) as risk_score,
  cast(coalesce(day(last) > 25, false) as bigint) as is_month_end, round(cast(previous as double) / (campaign + 1), 6) as contact_ratio from d"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic "name, code" strings judged against the two-letter codes of nations."""
    nations = table(spark, sf_dir, "nation")
    codes = nations.select(F.upper(F.substring("n_name", 1, 2)).alias("abbr"))
    raw = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    letters = (F.col("c_custkey") % 3 + 1).cast("int")
    raw = raw.select("c_custkey", F.concat(F.lower("n_name"), F.lit(", "), F.substr(F.lower(F.col("n_name")), (F.col("c_custkey") % 2 + 1).cast("int"), letters)).alias("raw_name"))
    parts = F.split("raw_name", ",")
    made = raw.select("c_custkey", parts[0].alias("location"), F.trim(F.upper(parts[1])).alias("abbreviation"))
    made = made.withColumns({"words": F.size(F.split("location", " ")), "correct_length": F.length("abbreviation") == 2, "has_digit": F.col("abbreviation").rlike("[0-9]")})
    return J.in_dimension(made, "abbreviation", codes, "abbr", "known").withColumn("valid", F.col("correct_length") & F.col("known"))


def state_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(mean_if(F.col(c)) * 100, 2).alias(f"pct_{c}")
    return places(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), share("correct_length"), share("known"), share("valid"), share("has_digit"), F.countDistinct("location").alias("n_locations"), long(F.max("words")).alias("most_words"))


def state_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 51 valid places, an inclusive slice to position 50."""
    return places(spark, sf_dir).where("valid").orderBy("c_custkey").limit(51).select("c_custkey", F.upper("location").alias("city"), F.col("abbreviation").alias("state"))


PLACES = """
with raw as (select c_custkey, lower(n_name) as location, upper(substr(lower(n_name), cast(c_custkey % 2 + 1 as int), cast(c_custkey % 3 + 1 as int))) as abbreviation from customer join nation on c_nationkey = n_nationkey),
p as (select *, len(string_split(location, ' ')) as words, length(trim(abbreviation)) = 2 as correct_length, regexp_matches(abbreviation, '[0-9]') as has_digit,
  trim(abbreviation) in (select upper(substr(n_name, 1, 2)) from nation) as known from raw)"""
STATE_VALIDITY_SQL = f"""{PLACES}
select count(*) as n, round(avg(correct_length::int) * 100, 2) as pct_correct_length, round(avg(known::int) * 100, 2) as pct_known, round(avg((correct_length and known)::int) * 100, 2) as pct_valid,
  round(avg(has_digit::int) * 100, 2) as pct_has_digit, count(distinct location) as n_locations, cast(max(words) as bigint) as most_words from p"""
STATE_SAMPLE_SQL = f"{PLACES} select c_custkey, upper(location) as city, trim(abbreviation) as state from p where correct_length and known order by c_custkey limit 51"


def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 11 != 0, F.col("user_id")).alias("user_id"), "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    filled = W.impute_group_mean(events, ["value"], ["user_id", "event_type"])
    return filled.select("event_id", rounded("value", 9).alias("value"))


IMPUTE_SQL = """
with e as (select event_id, case when user_id % 11 <> 0 then user_id end as u, event_type, case when event_id % 7 <> 0 then value end as v from events)
select event_id, round(case when v is not null then v when u is not null then avg(v) over (partition by u, event_type) end, 9) as value from e"""


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"))
    return J.reject_nulls(events, ["value", "kind"])[1]


REJECTS_SQL = "select count(*) filter (event_id % 7 <> 0 and event_id % 5 <> 0 and value is not null) as n_kept, count(*) filter (event_id % 7 = 0 or event_id % 5 = 0 or value is null) as n_dropped from events"


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks and years of a counter, its group number, and the value per hundred."""
    position, number = C.period_parts(F.col("event_id") + 1, 52)
    events = table(spark, sf_dir, "events").where("event_id is not null")
    made = events.select("event_id", "event_type", long(position).alias("week_no"), long(number).alias("year_horizon"), rounded(F.col("value") * 100, 2).alias("scaled"))
    return C.group_number(made, ["event_type", "week_no"], "group_no")


PERIODS_SQL = """
select event_id, event_type, event_id % 52 + 1 as week_no, event_id // 52 + 1 as year_horizon, round(value * 100, 2) as scaled, dense_rank() over (order by event_type, event_id % 52 + 1) - 1 as group_no from events"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's side in a random, a group and a stratified split, its fold and a random label."""
    made = S.split(table(spark, sf_dir, "events"), ["event_id"], 0.3, out="random")
    made = S.split_groups(made, ["user_id"], 0.3, out="grouped")
    made = S.split_stratified(made, "event_id", "event_type", 0.2, out="stratified")
    made = S.random_labels(S.kfold(made, ["event_id"], 5), ["event_id"], 3, seed=7)
    return made.select("event_id", "random", "grouped", "stratified", long("fold").alias("fold"), long("label").alias("label"))


def _hashed(keys: str, seed: int) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {keys}, '{seed}')), 1, 8) as bigint)"


SPLITS_SQL = f"""
select event_id, {_hashed("event_id", 42)} % 1000000 < 300000 as random, {_hashed("user_id", 42)} % 1000000 < 300000 as grouped,
  percent_rank() over (partition by event_type order by md5(concat_ws('|', event_id, '42')), event_id) < 0.2 as stratified, {_hashed("event_id", 42)} % 5 as fold, {_hashed("event_id", 7)} % 3 as label from events"""


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in a random order, with the place that each one has."""
    from ..operators.ordered import numbered

    made = S.shuffle(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    return numbered(made.withColumn("digest", S.digest(["s_suppkey"], 42)), ["digest", "s_suppkey"]).select("s_suppkey", long("_position").alias("place"))


SHUFFLED_SQL = "select s_suppkey, row_number() over (order by md5(concat_ws('|', s_suppkey, '42')), s_suppkey) - 1 as place from supplier"


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies around each customer: orders and suppliers of the nation, their sum and who has none."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    near = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    made = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(near, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return made.select("c_custkey", long(C.external_score("orders", "suppliers")).alias("external"), long(C.no_access("orders", "suppliers")).alias("deficit"))


ACCESS_SQL = """
select c_custkey, coalesce(orders, 0) + coalesce(suppliers, 0) as external, cast(coalesce(orders, 0) + coalesce(suppliers, 0) = 0 as bigint) as deficit from customer
left join (select o_custkey, count(*) as orders from orders group by 1) on c_custkey = o_custkey left join (select s_nationkey, count(*) as suppliers from supplier where s_acctbal > 9000 group by 1) on c_nationkey = s_nationkey"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at made-up coordinates."""
    lat, lon = (F.col("c_custkey") * 37 % 18000).cast("double") / 100 - 90, (F.col("c_custkey") * 101 % 36000).cast("double") / 100 - 180
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", lat.alias("lat"), lon.alias("lon"))


def geohashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = geo.cartesian("lat", "lon")
    made = points(spark, sf_dir).withColumn("geohash_9", geo.geohash("lat", "lon"))
    return made.select("c_custkey", "geohash_9", *(c.alias(n) for n, c in geo.geohash_levels("geohash_9", range(2, 6)).items()), rounded(x, 6).alias("x"), rounded(y, 6).alias("y"), rounded(z, 6).alias("z"))


POINTS = """
with p as (select c_custkey, c_acctbal, (c_custkey * 37 % 18000) / 100.0::double - 90 as lat, (c_custkey * 101 % 36000) / 100.0::double - 180 as lon from customer),
cells as (select *, least((1 << 23) - 1, floor((lon + 180) / 360 * (1 << 23))::bigint) as cx, least((1 << 22) - 1, floor((lat + 90) / 180 * (1 << 22))::bigint) as cy from p),
hashes as (select *, list_aggregate([substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + cast(list_sum([
    ((case when (44 - (5 * i + k)) % 2 = 0 then cx else cy end) >> cast((44 - (5 * i + k)) // 2 as int) & 1) * (1 << cast(4 - k as int)) for k in range(5)]) as int), 1) for i in range(9)], 'string_agg', '') as geohash_9 from cells)"""
GEOHASH_SQL = f"""{POINTS}
select c_custkey, geohash_9, geohash_9[:2] as geohash_2, geohash_9[:3] as geohash_3, geohash_9[:4] as geohash_4, geohash_9[:5] as geohash_5,
  round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 as x, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 as y, round(sin(radians(lat)), 6) + 0.0 as z from hashes"""


def geo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = points(spark, sf_dir).withColumn("g", geo.geohash("lat", "lon", 4)).select("c_acctbal", *(c.alias(n) for n, c in geo.geohash_levels("g", range(2, 5)).items()))
    found = grouping_levels(made, [["geohash_2"], ["geohash_3"], ["geohash_4"]], [F.count(F.lit(1)).alias("n"), rounded(F.avg("c_acctbal"), 6).alias("mean_balance")])
    return found.select("level", F.coalesce("geohash_2", "geohash_3", "geohash_4").alias("cell"), "n", "mean_balance")


GEO_LEVELS_SQL = f"""{POINTS}
select level, cell, count(*) as n, round(avg(c_acctbal), 6) as mean_balance from (
  select unnest(['geohash_2', 'geohash_3', 'geohash_4']) as level, unnest([geohash_9[:2], geohash_9[:3], geohash_9[:4]]) as cell, c_acctbal from hashes) group by 1, 2"""


def nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names_by(table(spark, sf_dir, "nation"), "n_regionkey", "n_name").select(long("n_regionkey").alias("n_regionkey"), "names")


NAMES_SQL = "select cast(n_regionkey as bigint) as n_regionkey, string_agg(distinct n_name, ',' order by n_name) as names from nation group by 1"

RULES = {"p_size": ("int", 5, 45), "p_retailprice": ("double", 0, 1500), "p_brand": ("string", None, None)}
SPOTS = {"Basic": (5.0, 950.0), "Standard": (25.0, 1200.0), "Premium": (45.0, 1600.0)}


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = K.validate(table(spark, sf_dir, "part"), RULES)
    return made.select("p_partkey", F.array_join("reasons", "; ").alias("reasons"))


VALIDATE_SQL = """
select p_partkey, concat_ws('; ', case when p_size is null then 'p_size: missing' when p_size < 5 then 'p_size: below 5' when p_size > 45 then 'p_size: above 45' end,
  case when p_retailprice is null then 'p_retailprice: missing' when p_retailprice < 0 then 'p_retailprice: below 0' when p_retailprice > 1500 then 'p_retailprice: above 1500' end,
  case when p_brand is null then 'p_brand: missing' end) as reasons from part"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = K.score(table(spark, sf_dir, "part").withColumns({"p_size": F.col("p_size").cast("double")}), SPOTS, ["p_size", "p_retailprice"], "v1")
    return made.select("p_partkey", "tier", rounded("confidence", 6).alias("confidence"), "model_version")


SCORE_SQL = """
with d as (select p_partkey, list_sort([{'d': sqrt((p_size - 5.0::double) ** 2 + (p_retailprice - 950) ** 2), 'name': 'Basic'}, {'d': sqrt((p_size - 25.0::double) ** 2 + (p_retailprice - 1200) ** 2), 'name': 'Standard'},
  {'d': sqrt((p_size - 45.0::double) ** 2 + (p_retailprice - 1600) ** 2), 'name': 'Premium'}]) as near from part)
select p_partkey, near[1].name as tier, round(greatest(0, least(1, 1 - near[1].d / (near[1].d + near[2].d + 1e-12))), 6) as confidence, 'v1' as model_version from d"""

QUERIES = {
    "bank_features": (bank_features, BANK_SQL),
    "state_validity": (state_validity, STATE_VALIDITY_SQL),
    "state_sample": (state_sample, STATE_SAMPLE_SQL),
    "impute_group_mean": (impute, IMPUTE_SQL),
    "reject_nulls": (rejects, REJECTS_SQL),
    "period_parts": (periods, PERIODS_SQL),
    "splits": (splits, SPLITS_SQL),
    "shuffled": (shuffled, SHUFFLED_SQL),
    "access": (access, ACCESS_SQL),
    "geohash": (geohashes, GEOHASH_SQL),
    "geo_levels": (geo_levels, GEO_LEVELS_SQL),
    "names_by": (nation_names, NAMES_SQL),
    "validate": (validated, VALIDATE_SQL),
    "score": (scored, SCORE_SQL),
}
