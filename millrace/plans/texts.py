"""Pages, chunks, retrieval, events and series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import documents as D, series as Z
from ..operators.parts import render_pages, render_records as records_text
from .common import long, rounded, table

NOW = "2024-01-15 12:00:00"
TEMPLATE = "Use the context to answer.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text("html").alias("content"))


_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"
# The references that the tables have, and a few more.
_DECODED = f"replace(replace(replace(replace(replace(replace(replace(replace({_STRIPPED}, '&middot;', '\u00b7'), '&copy;', '\u00a9'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
HTML_SQL = rf"select page_id, list_aggregate(list_filter(list_transform(regexp_split_to_array({_DECODED}, '\r\n|\r|\n|  '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 'string_agg', ' ') as content from pages"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_links(table(spark, sf_dir, "pages"))


LINKS_SQL = r"""
with raw as (select url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) as l, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as root, regexp_extract(url, '^([^?#]*)', 1) as page from pages),
r as (select url, regexp_replace(case when regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') then l when starts_with(l, '//') then regexp_extract(url, '^([^:]*:)', 1) || l when starts_with(l, '/') then root || l when l = '' then url
   when starts_with(l, '#') then regexp_extract(url, '^([^#]*)', 1) || l when starts_with(l, '?') then page || l when page = root then root || '/' || l else regexp_replace(page, '[^/]*$', '') || l end, '#.*$', '') as link from raw)
select distinct url, link from r where regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"""


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations reachable over trade: a customer's and a supplier's nation are linked where they
    share more lines than nations do on average."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    made = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = made.groupBy(F.col("c_nationkey").cast("string").alias("url"), F.col("s_nationkey").cast("string").alias("link")).agg(F.count(F.lit(1)).alias("n"))
    mean = pairs.agg(F.avg("n").alias("mean"))
    links = pairs.crossJoin(F.broadcast(mean)).where("url != link and n > mean").select("url", "link")
    return D.reach(links, "0", 3).select("url", long("depth").alias("depth"))


REACH_SQL = """
with recursive pairs as (select cast(c_nationkey as varchar) as url, cast(s_nationkey as varchar) as link, count(*) as n from orders join customer on o_custkey = c_custkey join lineitem on o_orderkey = l_orderkey
  join supplier on l_suppkey = s_suppkey group by 1, 2), links as (select url, link from pairs where url <> link and n > (select avg(n) from pairs)),
r as (select '0' as url, 0 as depth union select link, depth + 1 from r join links using (url) where depth < 3)
select url, cast(min(depth) as bigint) as depth from r group by 1"""


def reach_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred orders by steps from the first, over customers' orders in key order."""
    return D.reach(order_links(spark, sf_dir), "1", 50, 100).select("url", long("depth").alias("depth"))


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order k leads to 2 k and 2 k + 1 where there are such orders of another customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    to = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    made = orders.withColumn("k", F.explode(F.array(F.col("o_orderkey") * 2, F.col("o_orderkey") * 2 + 1))).join(to, "k").where("c != o_custkey")
    return made.select(F.col("o_orderkey").cast("string").alias("url"), F.col("k").cast("string").alias("link"))


REACH_CAPPED_SQL = """
with recursive l as (select cast(a.o_orderkey as varchar) as url, cast(b.o_orderkey as varchar) as link from orders a join orders b on b.o_orderkey // 2 = a.o_orderkey and a.o_custkey <> b.o_custkey),
r as (select '1' as url, 0 as depth union select link, depth + 1 from r join l using (url) where depth < 50)
select url, cast(min(depth) as bigint) as depth from r group by 1 order by 2, 1 limit 100"""
PART = 20_000


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each host's pages under headers, in parts of about PART characters."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.host("url").alias("host"), "url", T.html_text("html").alias("content"), (F.col("page_id") % 3).cast("int").alias("depth"))
    return render_pages(pages, "host", "url", "content", "depth", ["page_id"], PART)


PAGES_SQL = rf"""
with c as ({HTML_SQL}), p as (select page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host, coalesce(content, '') as content from pages join c using (page_id)),
n as (select *, row_number() over w as i, sum(length(content)) over w - length(content) as start from p window w as (partition by host order by page_id))
select host, cast(start // {PART} as bigint) as part, string_agg('--- Page ' || i || ': ' || url || ' (Depth ' || (page_id % 3) || ') ---' || chr(10) || content || chr(10) || chr(10), '' order by i) as text, count(*) as n from n group by 1, 2"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = D.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("doc_id", long("chunk_no").alias("chunk_no"), long("start_pos").alias("start_pos"), F.md5("chunk").alias("chunk_md5"))


CHUNKS_SQL = """
select doc_id, i as chunk_no, i * 900 as start_pos, md5(substr(text, i * 900 + 1, 1000)) as chunk_md5 from (
  select doc_id, text, unnest(range(cast(ceil(greatest(length(text) - 100, 1) / 900.0) as bigint))) as i from documents where length(text) > 0)"""


def chunks_at_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at breaks: what the pieces make together, and whether each is short enough."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.chunk_at_breaks("text", 700).alias("c"))
    fits = F.forall("c", lambda x: F.char_length(x) <= 700)
    return docs.select("doc_id", F.md5(F.array_join("c", "")).alias("text_md5"), fits.alias("fits"), (F.size("c") > 0).alias("has_pieces"))


CHUNKS_AT_BREAKS_SQL = "select doc_id, md5(text) as text_md5, true as fits, length(text) > 0 as has_pieces from documents"


def event_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times from texts of four forms: by zone, by offset, without either, the day alone."""
    form = F.col("event_id") % 4
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(form == 0, F.concat(second, F.lit("Z"))).when(form == 1, F.concat(second, F.lit("+02:00"))).when(form == 2, second).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(T.event_start(written), "yyyy-MM-dd HH:mm:ss").alias("start"))


EVENT_STARTS_SQL = "select event_id, strftime(case event_id % 4 when 1 then ts - interval 2 hour when 3 then date_trunc('day', ts) else ts end, '%Y-%m-%d %H:%M:%S') as start from events"


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = D.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5, "vec_id", "embedding")
    return found.select("query_id", long("rank").alias("rank"), F.col("id").alias("vec_id"), rounded("score", 5).alias("score"))


_COSINE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2]::double))"
_NORM = "sqrt(list_sum(list_transform({}.embedding, lambda x: x::double * x::double)))"
TOP_K_SQL = f"""
with s as (select a.vec_id as query_id, b.vec_id, {_COSINE} / ({_NORM.format("a")} * {_NORM.format("b")}) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, rank, vec_id, round(score, 5) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query vector's nearest documents are: rank, content and where it is from."""
    vectors = table(spark, sf_dir, "embeddings")
    hits = D.top_k(vectors.where("vec_id % 50 = 0"), vectors, 3, "vec_id", "embedding")
    made = D.sources(hits, table(spark, sf_dir, "documents"), "doc_id", "text", ["source", "lang"])
    return made.select("query_id", long("rank").alias("rank"), F.col("id").alias("doc_id"), F.md5("content").alias("content_md5"), "source", "lang")


ATTRIBUTION_SQL = f"""
with s as (select a.vec_id as query_id, b.vec_id, {_COSINE} / ({_NORM.format("a")} * {_NORM.format("b")}) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
h as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank, doc_id, md5(text) as content_md5, source, lang from h join documents on vec_id = doc_id where rank <= 3"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the texts of each query vector's nearest documents, in rank order."""
    vectors = table(spark, sf_dir, "embeddings")
    hits = D.top_k(vectors.where("vec_id % 50 = 0"), vectors, 3, "vec_id", "embedding")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))
    context = D.context(hits.join(texts, "id"), "query_id", "rank", "chunk")
    question = F.concat(F.lit("What do texts near "), F.col("query_id").cast("string"), F.lit(" say?"))
    made = context.withColumn("prompt", T.prompt(TEMPLATE, "context", question))
    return made.select("query_id", F.md5("prompt").alias("prompt_md5"), long(F.length("prompt")).alias("n_chars"))


PROMPTS_SQL = f"""
with s as (select a.vec_id as query_id, b.vec_id, {_COSINE} / ({_NORM.format("a")} * {_NORM.format("b")}) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
h as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as rank from s),
x as (select query_id, string_agg(text, chr(10) || chr(10) order by rank) as context from h join documents on vec_id = doc_id where rank <= 3 group by 1),
p as (select query_id, 'Use the context to answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: What do texts near ' || query_id || ' say?' || chr(10) || 'Answer:' as prompt from x)
select query_id, md5(prompt) as prompt_md5, length(prompt) as n_chars from p"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source in priority with content, for each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(F.array(F.lit("file"), F.lit("mail"), F.lit("calendar"), F.lit("web"), F.lit("other")), (F.col("doc_id") % 5 + 1).cast("int")).alias("source"))
    rows = rows.withColumns({"group_id": F.col("doc_id") / 4 - F.pmod("doc_id", F.lit(4)) / 4, "text": F.when(F.col("doc_id") % 3 != 0, F.col("text"))})
    made = D.choose_source(rows.withColumn("group_id", long("group_id")), "group_id", "source", "text", ["file", "mail", "calendar", "web"])
    return made


SOURCES_SQL = """
select doc_id // 4 as group_id, coalesce(min_by(s, p) filter (p is not null and doc_id % 3 <> 0 and text <> ''), 'general knowledge') as source
from (select *, ['file', 'mail', 'calendar', 'web', 'other'][doc_id % 5 + 1] as s, nullif(list_position(['file', 'mail', 'calendar', 'web'], ['file', 'mail', 'calendar', 'web', 'other'][doc_id % 5 + 1]), 0) as p from documents) group by 1"""


def event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.event_window(table(spark, sf_dir, "events"), "ts", F.lit(NOW).cast("timestamp_ntz"), 3, 2)
    return found.select("event_id", "ts", "direction")


EVENT_WINDOW_SQL = f"""
select * from (select event_id, ts, 'future' as direction from events where ts >= timestamp '{NOW}' and ts < timestamp '{NOW}' + interval 3 day order by ts, event_id limit 50) union all
select * from (select event_id, ts, 'past' as direction from events where ts >= timestamp '{NOW}' - interval 2 day and ts < timestamp '{NOW}' order by ts, event_id limit 50)"""


RECORDS_PART = 400


def render_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a type in time order as text, with a JSON field or a default."""
    events = table(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k"), F.lit("No k")))
    fields = [F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.col("k")]
    made = records_text(events, "user_id", "%s at %s: %s", fields, ["ts", "event_id"], part=RECORDS_PART)
    return made.select("user_id", "part", F.md5("text").alias("text_md5"), "n")


RENDER_SQL = f"""
with r as (select user_id, ts, event_id, event_type || ' at ' || strftime(ts, '%Y-%m-%d %H:%M') || ': ' || coalesce(json_extract_string(props, '$.k'), 'No k') as t from events),
n as (select *, sum(length(t) + 1) over (partition by user_id order by ts, event_id rows unbounded preceding) - length(t) - 1 as start, count(*) over (partition by user_id) as n from r),
g as (select user_id, start // {RECORDS_PART} as part, n, string_agg(t, chr(10) order by ts, event_id) as text from n group by 1, 2, 3)
select user_id, cast(part as bigint) as part, md5(case when part = 0 then 'RECORDS (' || n || ')' || chr(10) else '' end || text) as text_md5, n from g"""


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    starts = table(spark, sf_dir, "events").select(T.event_start(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("ts"))
    return starts.agg(F.count_if(F.col("ts") >= now).alias("n_future"), F.count_if(F.col("ts") < now).alias("n_past"))


COUNTS_SQL = f"select count(*) filter (date_trunc('second', ts) >= timestamp '{NOW}') as n_future, count(*) filter (date_trunc('second', ts) < timestamp '{NOW}') as n_past from events"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by type and hour of day: the series of the following queries."""
    return table(spark, sf_dir, "events").groupBy("event_type", long(F.hour("ts")).alias("x")).agg(F.avg("value").alias("y"))


def log_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    block, middle = Z.log_bands("l_extendedprice", 100.0, 100000.0, 2.0)
    return table(spark, sf_dir, "lineitem").groupBy(long(block).alias("block"), rounded(middle, 4).alias("middle")).agg(F.count(F.lit(1)).alias("n"))


_WIDTH = math.log(1000.0) / 10
LOG_BANDS_SQL = f"""
select block, round(100 * exp((block + 0.5::double) * {_WIDTH!r}), 4) as middle, count(*) as n from (
  select case when l_extendedprice between 100 and 100000 then least(9, greatest(0, floor(ln(l_extendedprice / 100) / {_WIDTH!r})))::bigint end as block from lineitem) group by 1, 2"""


def simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.integrate_simpson(hourly(spark, sf_dir), ["event_type"], "x", "y").select("event_type", rounded("integral", 5).alias("integral"))


SIMPSON_SQL = """
with s as (select event_type, hour(ts) as x, avg(value) as y from events group by 1, 2),
p as (select *, row_number() over (partition by event_type order by x) - 1 as i, count(*) over (partition by event_type) as n from s),
w as (select *, case when n = 1 then 1.0::double when n = 2 then 0.5 when n % 2 = 1 then case when i in (0, n - 1) then 1.0 / 3 when i % 2 = 1 then 4.0 / 3 else 2.0 / 3 end
  when i < n - 4 then case when i = 0 then 1.0 / 3 when i % 2 = 1 then 4.0 / 3 else 2.0 / 3 end when i = n - 4 and n > 4 then 1.0 / 3 + 3.0 / 8 when i in (n - 4, n - 1) then 3.0 / 8 else 9.0 / 8 end as wt from p)
select event_type, round(sum(wt * y) * case when count(*) > 1 then (max(x) - min(x)) / (count(*) - 1)::double else 1 end, 5) as integral from w group by 1"""


def taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hourly(spark, sf_dir).withColumns({kind: rounded(Z.taper(["event_type"], "x", kind), 6) for kind in ("hann", "hamming", "blackman", "flat")})
    return made.select("event_type", "x", *(F.abs(F.col(k)).alias(k) for k in ("hann", "hamming", "blackman", "flat")))


TAPER_SQL = """
with s as (select event_type, hour(ts) as x from events group by 1, 2), p as (select *, (row_number() over (partition by event_type order by x) - 1)::double / nullif(count(*) over (partition by event_type) - 1, 0) as t from s)
select event_type, x, coalesce(abs(round(0.5 - 0.5 * cos(2 * pi() * t), 6)), 1) as hann, coalesce(abs(round(0.54 - 0.46 * cos(2 * pi() * t), 6)), 1) as hamming,
  coalesce(abs(round(0.42 - 0.5 * cos(2 * pi() * t) + 0.08 * cos(4 * pi() * t), 6)), 1) as blackman,
  coalesce(abs(round(case when t < 0.1 then 0.5 - 0.5 * cos(t / 0.1 * pi()) when t > 0.9 then 0.5 - 0.5 * cos((1 - t) / 0.1 * pi()) else 1 end, 6)), 1) as flat from p"""


def regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with a mean over 50, on the full grid."""
    made = Z.regrid(hourly(spark, sf_dir).where("y > 50"), "event_type", "x", "y")
    return made.select("event_type", "x", rounded("y", 9).alias("y"))


REGRID_SQL = """
with s as (select event_type, hour(ts) as x, avg(value) as y from events group by 1, 2 having avg(value) > 50), g as (select event_type, unnest(range(max(x) + 1)) as x from s group by 1)
select g.event_type, g.x, round(coalesce(y, 0), 9) as y from g left join s using (event_type, x)"""


def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.relative_to_ref(hourly(spark, sf_dir), "event_type", "y", "x", "relative").select("event_type", "x", rounded("relative").alias("relative"))


RELATIVE_SQL = """
with s as (select event_type, hour(ts) as x, avg(value) as y from events group by 1, 2)
select event_type, x, round(y / nullif(first_value(y) over (partition by event_type order by x), 0), 4) as relative from s"""


def ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    made = Z.ar1_forecast(daily, "event_type", "day", "y", 3)
    return made.select("event_type", long("step").alias("step"), rounded("forecast", 3).alias("forecast"))


AR1_SQL = """
with d as (select event_type, cast(ts as date) as day, sum(value) as y from events group by 1, 2), m as (select *, y - lag(y) over w as dy from d window w as (partition by event_type order by day)),
b as (select *, lag(dy) over (partition by event_type order by day) as before from m),
f as (select event_type, regr_slope(dy, before) as b, regr_intercept(dy, before) as a, max_by(y, day) as y0, max_by(dy, day) as d0 from b group by 1),
s as (select *, a + b * d0 as d1, a + b * (a + b * d0) as d2, a + b * (a + b * (a + b * d0)) as d3 from f)
select event_type, 1::bigint as step, round(y0 + d1, 3) as forecast from s union all select event_type, 2, round(y0 + d1 + d2, 3) from s union all select event_type, 3, round(y0 + d1 + d2 + d3, 3) from s"""


def arima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days ahead of each event type's daily values, with both regressions' coefficients."""
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    fits = Z.arima_fit(daily, "event_type", "day", "y")
    made = Z.arima_forecast(fits, "event_type", 3).join(fits, "event_type")
    return made.select("event_type", long("step").alias("step"), rounded("forecast", 3).alias("forecast"), *(rounded(c, 6).alias(c) for c in ("level", "ar", "ma")))


def _slopes_sql(y: str, p: str, q: str, rows: str) -> str:
    """Coefficients of y on p and q by type, from covariances."""
    return f"""select event_type, {{my}} - b * mp - c * mq as a, b, c from (select *, (py * qq - qy * pq) / (pp * qq - pq * pq) as b, (qy * pp - py * pq) / (pp * qq - pq * pq) as c from (
  select event_type, avg({y}) as my, avg({p}) as mp, avg({q}) as mq, var_pop({p}) as pp, var_pop({q}) as qq, covar_pop({p}, {q}) as pq, covar_pop({p}, {y}) as py, covar_pop({q}, {y}) as qy
  from {rows} where {y} is not null and {p} is not null and {q} is not null group by 1))""".format(my="my")


ARIMA_SQL = f"""
with s as (select event_type, cast(ts as date) as day, sum(value) as y from events group by 1, 2), d as (select *, y - lag(y) over (partition by event_type order by day) as d from s),
m as (select *, lag(d) over w as d1, lag(d, 2) over w as d2 from d window w as (partition by event_type order by day)), f as ({_slopes_sql("d", "d1", "d2", "m")}),
e as (select m.*, d - a - b * d1 - c * d2 as e from m join f using (event_type)), g as (select *, lag(e) over (partition by event_type order by day) as e1 from e), h as ({_slopes_sql("d", "d1", "e1", "g")}),
l as (select event_type, max_by(y, day) as y0, max_by(d, day) as d0, max_by(e, day) as e0 from g group by 1),
p as (select *, a + b * d0 + c * e0 as s1 from h join l using (event_type)), q as (select *, a + b * s1 as s2, a + b * (a + b * s1) as s3 from p)
select event_type, step, round(case step when 1 then y0 + s1 when 2 then y0 + s1 + s2 else y0 + s1 + s2 + s3 end, 3) as forecast, round(a, 6) as level, round(b, 6) as ar, round(c, 6) as ma from q, (select unnest([1, 2, 3]::bigint[]) as step)"""

QUERIES = {
    "arima_forecast": (arima, ARIMA_SQL),
    "html_text": (html_text, HTML_SQL),
    "page_links": (page_links, LINKS_SQL),
    "reach": (reach, REACH_SQL),
    "reach_capped": (reach_capped, REACH_CAPPED_SQL),
    "chunks_at_breaks": (chunks_at_breaks, CHUNKS_AT_BREAKS_SQL),
    "event_starts": (event_starts, EVENT_STARTS_SQL),
    "render_pages": (pages_text, PAGES_SQL),
    "chunks": (chunks, CHUNKS_SQL),
    "top_k": (top_k, TOP_K_SQL),
    "prompts": (prompts, PROMPTS_SQL),
    "attribution": (attribution, ATTRIBUTION_SQL),
    "choose_source": (sources, SOURCES_SQL),
    "event_window": (event_window, EVENT_WINDOW_SQL),
    "render_records": (render_records, RENDER_SQL),
    "source_counts": (source_counts, COUNTS_SQL),
    "log_bands": (log_bands, LOG_BANDS_SQL),
    "simpson": (simpson, SIMPSON_SQL),
    "taper": (taper, TAPER_SQL),
    "regrid": (regrid, REGRID_SQL),
    "relative_to_ref": (relative, RELATIVE_SQL),
    "ar1_forecast": (ar1, AR1_SQL),
}
