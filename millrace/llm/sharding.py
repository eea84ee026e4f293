"""K-d tree partition of documents into shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import gapless, materialise, partitions

DIMENSION_BITS, TEXT_BITS, ROW_BITS = 16, 30, 16
KEY_BITS = DIMENSION_BITS + TEXT_BITS + ROW_BITS
#: Buckets of a histogram pass, as bits of the key.
PASS_BITS = 16


def metadata(text: Column, size: Column) -> dict[str, Column]:
    """What a document is split by: its length, share of multi-byte characters, line length."""
    chars = F.char_length(text)
    lines = F.char_length(F.regexp_replace(text, "[^\n]", "")) + 1
    return {"length": F.log2(size), "script": size / (chars + 1.0), "line": F.log2((chars + 1.0) / lines)}


def _with(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """``rows`` with what ``table`` says of their node; it has a row for each node at most."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), "node")


def _cuts(rows: DataFrame, chosen: dict[int, int], goals: dict[int, float], tolerance: float, whole: float) -> dict[int, int]:
    """For each node the key at which ``goals`` bytes lie below, by histograms that narrow down.

    The bucket in which a node's goal lies is found by Spark: a pass brings one row a node to
    the driver. Documents of equal text have equal keys but for the last ROW_BITS, into which a
    cut goes only where one text alone outweighs ``whole`` bytes.
    """
    low, bits, below, cuts = dict.fromkeys(goals, 0), dict.fromkeys(goals, KEY_BITS), dict.fromkeys(goals, 0), {}
    while goals.keys() - cuts.keys():
        todo = sorted(goals.keys() - cuts.keys())
        step = {n: max(0 if bits[n] <= ROW_BITS else ROW_BITS, bits[n] - PASS_BITS) for n in todo}
        params = [(n, chosen[n], low[n], low[n] + (1 << bits[n]), 1 << step[n], float(goals[n]) - below[n]) for n in todo]
        inside = _with(rows, params, "node int, dim int, low long, high long, step long, goal double").withColumn("key", F.expr("keys[dim]"))
        bucket = F.expr("(key - low) div step").alias("bucket")
        sums = inside.where("key >= low and key < high").groupBy("node", "goal", bucket).agg(F.sum("size").alias("weight"), F.min("key").alias("least"), F.max("key").alias("most"))
        # 2**PASS_BITS sums a node
        by_bucket = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = sums.withColumn("upto", F.sum("weight").over(by_bucket))
        there = running.where("upto >= goal - 0.5").groupBy("node").agg(F.min(F.struct("bucket", "weight", "upto", "least", "most")).alias("at"))
        for n, (number, weight, upto, least, most) in ((r["node"], r["at"]) for r in there.collect()):
            at, start, grain = below[n] + upto - weight, low[n] + (number << step[n]), step[n]
            if grain > ROW_BITS and least >> ROW_BITS == most >> ROW_BITS:  # one text has all of the bucket
                start, grain = least >> ROW_BITS << ROW_BITS, ROW_BITS
            if weight <= (whole if grain == ROW_BITS else tolerance) or grain == 0:
                cuts[n] = start if goals[n] - at < at + weight - goals[n] else start + (1 << grain)
            low[n], bits[n], below[n] = start, grain, at
    return cuts


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, whole: float = 0.03) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty. A node with more than
    one shard is split along its widest metadata dimension where its bytes divide as its
    shards do, to ``tolerance`` of a shard. Equal texts go to the same shard, unless one text's
    rows outweigh ``whole`` of a shard: then a cut may pass between them. slot counts each shard's
    rows from 0. Repeated rows and null ids are kept, each with a number of its own in the key, so that
    they too are divided; an empty table gives no rows. Texts of any
    length are measured whole; one that outweighs a shard leaves its shard above the others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = (F.octet_length("text") + 1).cast("long")
    dims = metadata(F.col("text"), size)
    rows = rows.select(
        "doc_id",
        size.alias("size"),
        F.crc32("text").cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("text"), 64 - TEXT_BITS).alias("text_key"),
        # The row's number parts rows that are equal in everything else.
        F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), 64 - ROW_BITS).alias("row_key"),
        *(c.alias(name) for name, c in dims.items()),
    )
    rows = materialise(rows, "shard-rows")
    ends = rows.agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max))).first()
    top, keys = (1 << DIMENSION_BITS) - 1, []
    for d in dims:
        low, high = ends[f"{d}_min"] or 0.0, ends[f"{d}_max"] or 0.0
        scaled = F.floor((F.col(d) - low) / (high - low) * top).cast("long") if high > low else F.lit(0).cast("long")
        keys.append(F.shiftleft(scaled, TEXT_BITS + ROW_BITS).bitwiseOR(F.shiftleft(F.col("text_key"), ROW_BITS)).bitwiseOR(F.col("row_key")))
    rows = materialise(rows.select("doc_id", "size", "text_crc32", F.array(*keys).alias("keys")), "shard-keys")
    rows, leaves = rows.withColumn("node", F.lit(1)), {1: (0, shards)}
    target = (ends["bytes"] or 0) / shards
    while any(n > 1 for _, n in leaves.values()):
        spread = [F.max(F.col("keys")[i]) - F.min(F.col("keys")[i]) for i in range(len(dims))]
        sums = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.array(*spread).alias("spread")).collect()}
        inner = {k: n for k, (_, n) in leaves.items() if n > 1}
        chosen = {k: max(range(len(dims)), key=sums[k]["spread"].__getitem__) for k in inner if k in sums}
        goals = {k: sums[k]["bytes"] * (inner[k] // 2) / inner[k] for k in chosen}
        cuts = _cuts(rows, chosen, goals, tolerance * target, whole * target)
        table = [(k, chosen.get(k, 0), cuts.get(k, 0)) if n > 1 else (k, 0, None) for k, (_, n) in leaves.items()]
        node = F.expr("if(cut is null, node, if(keys[dim] < cut, 2 * node, 2 * node + 1))").cast("int")
        # Written, so that a level's passes do not repeat the levels before it.
        rows = materialise(_with(rows, table, "node int, dim int, cut long").withColumn("node", node).drop("dim", "cut"), "shard-nodes")
        for k, n in inner.items():
            first = leaves.pop(k)[0]
            leaves[2 * k], leaves[2 * k + 1] = (first, n // 2), (first + n // 2, n - n // 2)
    numbers = [(k, first) for k, (first, _) in leaves.items()]
    placed = materialise(_with(rows, numbers, "node int, shard int").select("doc_id", "size", "text_crc32", "shard"), "shards")
    return gapless(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", partitions(docs.sparkSession))
