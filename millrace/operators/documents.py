"""Document tables: pages, links, chunks, retrieval, events."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .checkpoints import folder, written


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link): distinct absolute links of each page to its own host, without fragments."""
    found = pages.select(F.col(url).alias("url"), F.explode(T.links(html)).alias("raw"))
    found = found.select("url", F.regexp_replace(T.resolve("raw", "url"), "#.*$", "").alias("link"))
    return found.where(T.host("link") == T.host("url")).distinct()


def reach(links: DataFrame, start: str, depth: int, most: int | None = None) -> DataFrame:
    """(url, depth) of pages reachable from ``start``, each once with its smallest depth.

    Breadth first, at most ``depth`` rounds: each joins the pages found last to their links and
    is written, so that the plan of a round does not hold those before it. ``most`` is a crawl
    budget: the first so many pages by depth and URL; no round is begun once they are found.
    """
    spark, base = links.sparkSession, folder(links.sparkSession)
    links = written(links.select("url", "link").where("url is not null and link is not null").distinct())

    def found() -> DataFrame:
        """All rounds so far: one table of a folder a depth, so that its plan is the same at any."""
        return spark.read.schema("url string, depth int").parquet(base)

    spark.createDataFrame([(start,)], "url string").write.parquet(f"{base}/depth=0")
    n = 1
    for step in range(1, depth + 1):
        seen = found()
        following = links.join(seen.where(F.col("depth") == step - 1).select("url"), "url").select(F.col("link").alias("url")).distinct()
        following.join(seen, "url", "left_anti").select("url").write.parquet(f"{base}/depth={step}")
        new = found().where(F.col("depth") == step).count()
        n += new
        if not new or (most and n >= most):
            break
    return found().orderBy("depth", "url").limit(most) if most else found()


def chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(key, chunk_no, start_pos, chunk) rows; texts without characters have none."""
    made = docs.select(key, F.posexplode(T.chunk_array(text, size, overlap)).alias("chunk_no", "chunk"))
    return made.select(key, "chunk_no", (F.col("chunk_no") * (size - overlap)).alias("start_pos"), "chunk")


def _best(k: int, rows: pa.Table, held: pa.Table) -> pa.Table:
    """The k nearest of one block of vectors for each query of another block."""
    rows, held = rows.combine_chunks(), held.combine_chunks()
    out: list[tuple[int, int, float]] = []
    if rows.num_rows and held.num_rows:
        q, v = (np.array(t["x"].to_pylist(), float).reshape(t.num_rows, -1) for t in (rows, held))
        asked, ids = rows["id"].to_numpy(), held["id"].to_numpy()
        norms = np.sqrt((v * v).sum(1))
        for at in range(0, len(q), 256):
            own = q[at : at + 256]
            with np.errstate(all="ignore"):
                score = own @ v.T / (np.sqrt((own * own).sum(1))[:, None] * norms)
            score[~np.isfinite(score) | (asked[at : at + 256, None] == ids)] = -np.inf
            few = min(k, len(ids))
            # All that are as near as the k-th, so that equal scores can go by id.
            least = -np.partition(-score, few - 1, axis=1)[:, few - 1]
            for name, row, low in zip(asked[at : at + 256], score, least):
                hit = np.flatnonzero((row >= low) & np.isfinite(row))
                hit = hit[np.lexsort((ids[hit], -row[hit]))[:few]]
                out += zip([name] * len(hit), ids[hit].tolist(), row[hit].tolist())
    columns = zip(*out) if out else [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector: str, query_blocks: int = 4, block_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, id, score): the k nearest by cosine, the query itself left out.

    A stated set of queries against all rows, in blocks: vectors are dealt to blocks of about
    ``block_rows`` and sent once for each of ``query_blocks``; a task multiplies a block of
    queries with a block of vectors and passes on k rows a query, so that what is shuffled
    after it grows with queries and blocks, not with pairs. Equal scores go by id; vectors that
    are null, zero or hold nulls take no part. Ids are long.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    good = lambda df: df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    blocks = max(1, -(-vectors.count() // block_rows))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = good(queries).select("id", "x", block(query_blocks).alias("_a"), every(blocks).alias("_b"))
    held = good(vectors).select("id", "x", every(query_blocks).alias("_a"), block(blocks).alias("_b"))
    near = asked.groupBy("_a", "_b").cogroup(held.groupBy("_a", "_b")).applyInArrow(lambda rows, vecs: _best(k, rows, vecs), "query_id long, id long, score double")
    # k rows a query and block of vectors.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def sources(hits: DataFrame, rows: DataFrame, id_col: str, content: str, metadata: Sequence[str]) -> DataFrame:
    """(query_id, rank, id, content, metadata): what each hit of top_k() stands on."""
    held = rows.select(F.col(id_col).alias("id"), F.col(content).alias("content"), *metadata)
    return hits.join(held, "id").select("query_id", "rank", "id", "content", *metadata)


def context(hits: DataFrame, key: str, rank: str, content: str, sep: str = "\n\n") -> DataFrame:
    """(key, context): the contents of each query's hits in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct(rank, content)))
    return hits.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[content]), sep).alias("context"))


def choose_source(df: DataFrame, key: str, source: str, content: str, priority: Sequence[str], none: str = "general knowledge") -> DataFrame:
    """(key, source): the first of the prioritised sources that has content."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    usable = (place > 0) & F.col(content).isNotNull() & (F.col(content) != "")
    return df.groupBy(key).agg(F.coalesce(F.min_by(F.when(usable, F.col(source)), F.when(usable, place)), F.lit(none)).alias("source"))


def event_window(events: DataFrame, ts: str, now: Column, ahead: int, back: int, mode: str = "both", most: int = 50, newest: bool = False) -> DataFrame:
    """Events of the next ``ahead`` and last ``back`` days with their direction.

    At most ``most`` each way in ascending order of start, so that of past events the oldest
    of the window stay, unless ``newest``. ``most`` is the page size of a calendar, a feature.
    """
    day = lambda n: F.make_dt_interval(F.lit(n))
    frames = []
    if mode in ("future", "both"):
        frames.append(events.where((F.col(ts) >= now) & (F.col(ts) < now + day(ahead))).withColumn("direction", F.lit("future")).orderBy(ts, *events.columns[:1]).limit(most))
    if mode in ("past", "both"):
        order = F.desc(ts) if newest else F.asc(ts)
        frames.append(events.where((F.col(ts) >= now - day(back)) & (F.col(ts) < now)).withColumn("direction", F.lit("past")).orderBy(order, *events.columns[:1]).limit(most))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

