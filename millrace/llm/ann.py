"""Approximate nearest neighbours by cosine: inverted lists with adaptive dimension scans.

Equal vectors are one entry with their smallest ids. Entries are dealt to the lists of their
nearest centroids. Inside a list vectors are rotated at random and read in blocks of columns:
after each block a hypothesis test on the partial distance abandons candidates that would
hardly come below the query's bound in full. What is left is scored in double precision on the
original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialise

#: The index is fitted on so many distinct vectors at most, the first by a hash of their id,
SAMPLE_ROWS = 20_000
#: and on no more bytes than this.
SAMPLE_BYTES = 64 << 20
MOST_LISTS = 4096
#: Entries, and queries, that one task compares; larger lists are dealt to several.
ENTRIES, QUERIES = 4096, 16_384
#: Share of true neighbours whose list is probed, as measured on the sample.
TARGET = 0.97
#: Column blocks, and the test's width: larger abandons less.
BLOCKS, WIDTH = 4, 2.1


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values /= np.abs(values).max(axis=1, keepdims=True)
    return (values / np.linalg.norm(values, axis=1, keepdims=True)).astype(np.float32)


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    sample: np.ndarray
    probes: int


def fit(sample: np.ndarray, entries: int, k: int, rounds: int = 12) -> Index:
    """Spherical k-means on unit vectors, and as many probes as find TARGET of the neighbours
    that sample vectors have in the sample. In the whole table neighbours are nearer still."""
    count, dims = sample.shape
    lists = int(np.clip(np.sqrt(entries), 1, min(MOST_LISTS, max(1, count // 8))))
    rng = np.random.default_rng(5)
    centroids = sample[rng.choice(count, lists, replace=False)].copy()
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norm > 0, total / np.maximum(norm, 1e-9), centroids).astype(np.float32)
    own = (sample @ centroids.T).argmax(1)
    asking = np.arange(min(256, count))
    near = sample[asking] @ sample.T
    near[asking, asking] = -2
    found = np.argsort(-near, axis=1, kind="stable")[:, : min(k, count - 1)]
    place = np.argsort(np.argsort(-(sample[asking] @ centroids.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(place[asking[:, None], own[found]].ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1 if len(ranks) else lists
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0].astype(np.float32)
    return Index(centroids, rotation, sample, min(lists, probes))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; columns are added in order, so equal rows score equally."""
    dot, x, y = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        p, q = a[:, j].astype(np.float64), b[:, j].astype(np.float64)
        dot += p * q
        x += p * p
        y += q * q
    return dot / (np.sqrt(x) * np.sqrt(y))


def scan(queries: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of rotated unit rows that the adaptive scan leaves.

    ``bound``: squared distance that ``k`` of a query's neighbours are known to keep.
    """
    dims = queries.shape[1]
    cuts = np.unique(np.linspace(0, dims, BLOCKS + 1).astype(int))[1:]
    first = slice(0, cuts[0])
    partial = (queries[:, first] ** 2).sum(1)[:, None] + (vectors[:, first] ** 2).sum(1) - 2 * queries[:, first] @ vectors[:, first].T
    if len(vectors) > k:
        likely = np.argpartition(partial, k - 1, axis=1)[:, :k]
        full = ((queries[:, None] - vectors[likely]) ** 2).sum(2)
        bound = np.minimum(bound, full.max(1))
    slack = 1e-5
    limit = lambda d: bound * (d / dims) * (1 + (width / np.sqrt(d) if d < dims else 0)) ** 2 + slack
    q, v = np.nonzero(partial <= limit(cuts[0])[:, None])
    left = partial[q, v]
    for low, high in zip(cuts[:-1], cuts[1:]):
        left = left + ((queries[q, low:high] - vectors[v, low:high]) ** 2).sum(1)
        kept = left <= limit(high)[q]
        q, v, left = q[kept], v[kept], left[kept]
    return q, v


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row of ``queries``.

    ``queries`` has the same two columns and may be rows of ``vectors``; a row of the query's
    own id is no candidate. Rank counts from 1, nearest first, equal scores by smaller id. A
    vector that is null, zero, or holds nulls or non-finite numbers takes no part, nor does one
    of another length than most have, or without an id. Rows that repeat id and vector count
    once. Fewer than ``k`` candidates give fewer rows; empty tables give none.
    """
    spark = vectors.sparkSession
    sound = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(sound).where("id is not null")
    rows, asked = named(vectors), named(queries)
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = rows.where(F.size("v") == size["size"]), asked.where(F.size("v") == size["size"])
    # k + 1 of a vector's ids are enough for any query, which leaves out one at most.
    nearest = Window.partitionBy("v").orderBy("id")
    entries = rows.withColumn("place", F.dense_rank().over(nearest)).where(F.col("place") <= k + 1)
    entries = entries.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("head", F.element_at("ids", 1))
    entries = materialise(entries.withColumn("head", F.struct("head", F.xxhash64("v").alias("tag"))), "vectors")
    asked = materialise(asked.join(entries.select("v", "head"), "v", "left").select("id", "v", F.coalesce("head", F.struct(F.lit(None).cast("long").alias("head"), F.xxhash64("v").alias("tag"))).alias("head")), "queries")

    count = entries.count()
    bounded = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * size["size"])))
    taken = entries.orderBy(F.xxhash64("head.tag", F.lit(3)), "head").limit(bounded).select("v").toArrow()
    sample = unit(np.array(taken.column("v").combine_chunks().flatten()).reshape(taken.num_rows, -1))
    index = spark.sparkContext.broadcast(fit(sample, count, k))
    lists, probes = len(index.value.centroids), index.value.probes
    table = lambda column, n: np.array(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(n, -1)
    kind = entries.schema["v"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                own = (unit(table(batch.column(2), batch.num_rows)) @ index.value.centroids.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["head", "ids", "v", "list"])

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                own = unit(table(batch.column(1), batch.num_rows))
                best = np.argpartition(-(own @ index.value.centroids.T), min(probes, lists) - 1, axis=1)[:, :probes]
                near = own @ index.value.sample.T
                bound = 2 - 2 * np.partition(near, -k - 1, axis=1)[:, -k - 1] if near.shape[1] > k else np.full(len(own), np.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best.astype(np.int32)), pa.list_(pa.int32())), pa.array(bound.astype(np.float64))], names=["head", "v", "lists", "bound"])

    head = "head struct<head:long,tag:long>"
    dealt = materialise(entries.select("head", "ids", "v").mapInArrow(assign, f"{head}, ids array<long>, v {kind}, list int"), "lists")
    # One row for each kind of query vector. max_by picks one row's vector; all are equal.
    distinct = asked.groupBy("head").agg(F.first("v").alias("v"))
    routed = materialise(distinct.mapInArrow(route, f"{head}, v {kind}, lists array<int>, bound double"), "probes")
    tag = F.xxhash64("head.tag")
    # At most MOST_LISTS rows.
    sizes = materialise(dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).cast("int").alias("blocks")), "list-sizes")

    def compare(width):
        def run(key, own, asking):
            out = []
            if own.num_rows and asking.num_rows:
                vectors, wanted = table(own.column("v"), own.num_rows), table(asking.column("v"), asking.num_rows)
                turned, bound = unit(vectors) @ index.value.rotation, asking.column("bound").to_numpy()
                first = own.column("head").combine_chunks().field("head").to_numpy(zero_copy_only=False)
                for at in range(0, len(wanted), 128):
                    part = wanted[at : at + 128]
                    q, v = scan(unit(part) @ index.value.rotation, turned, bound[at : at + 128].astype(np.float32), k + 1, width)
                    score = cosines(part[q], vectors[v])
                    order = np.lexsort((first[v], -score, q))
                    q, v, score = q[order], v[order], score[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    some = place <= k
                    out.append((q[some] + at, v[some], score[some]))
            q, v, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
            return pa.table({"head": asking.column("head").take(pa.array(q)), "ids": own.column("ids").take(pa.array(v)), "score": pa.array(score)})

        return run

    def nearest_of(sent, width):
        """(head, found): each query vector's k + 1 nearest entries' ids in the lists it is sent to."""
        loads = sent.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("loads"))
        plan = F.broadcast(sizes.join(loads, "list"))
        left = dealt.join(plan, "list").withColumn("block", F.pmod(tag, F.col("blocks")).cast("int")).withColumn("load", F.explode(F.sequence(F.lit(0), F.col("loads") - 1)))
        right = sent.join(plan, "list").withColumn("load", F.pmod(tag, F.col("loads")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ("list", "block", "load")
        pairs = left.select(*keys, "head", "ids", "v").groupBy(*keys).cogroup(right.select(*keys, "head", "v", "bound").groupBy(*keys))
        found = pairs.applyInArrow(compare(width), f"{head}, ids array<long>, score double")
        best = Window.partitionBy("head").orderBy(F.desc("score"), "id")
        best = found.select("head", "score", F.explode("ids").alias("id")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
        return best.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))

    answers = materialise(nearest_of(routed.withColumn("list", F.explode("lists")).drop("lists"), WIDTH), "nearest")
    # Queries that were left with too few go to all lists without a test; they are rare.
    full = answers.where(F.size("found") > k)
    short = materialise(routed.join(full, "head", "left_anti"), "short")
    if not short.isEmpty():
        everywhere = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))).withColumn("bound", F.lit(float("inf"))).drop("lists")
        answers = full.unionByName(nearest_of(everywhere, float("inf")))
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    joined = asked.select(F.col("id").alias("query_id"), "head").distinct().join(answers, "head").select("query_id", own.alias("found"))
    ranked = joined.select("query_id", F.posexplode("found").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
