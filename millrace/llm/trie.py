"""Prefix trie of conversations, summed up along its Euler tour.

A node is a distinct sequence of first turns. Each node has an enter and an exit arc; the arcs in
the order of a depth-first walk are one list, of which every arc knows its neighbours. The list
is ranked by random mate: each round takes out about a quarter of the arcs, each handing its
length to the arc before it, until few are left, and puts them back in the opposite order. With
the ranks as positions, running sums over the tour give every subtree's sums as a difference
between a node's two arcs.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import along, materialise

#: Arcs that are ranked in one step at the end, and tour positions that are summed at once.
LAST, STRETCH = 1 << 15, 1 << 14
ROUNDS = 200
#: Characters of ids that are joined before they are digested.
JOINED = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


def rank(arcs: DataFrame, last: int = LAST) -> DataFrame:
    """(id, rank): how many arcs the list still has from each arc on, itself included.

    ``arcs``: id, prev, next (long), -1 beyond the ends; one list. An arc is taken out in a round
    if its coin shows tails and the coin before it heads, so that no two neighbours go at once;
    coins are hashes of id and round. Rounds shrink by about a quarter each.
    """
    now, gone = materialise(arcs.select("id", "prev", "next", F.lit(1).cast("long").alias("length")), "tour"), []
    heads = lambda c, k: F.xxhash64(F.lit(k), c).bitwiseAND(F.lit(1)) == 1
    none = F.lit(None).cast("long")
    while now.count() > last:
        k = len(gone)
        if k == ROUNDS:
            raise RuntimeError(f"list not ranked after {ROUNDS} rounds")
        out = (F.col("prev") >= 0) & heads(F.col("prev"), k) & ~heads(F.col("id"), k)
        taken = materialise(now.where(out), "tour-taken")
        stays = now.where(~out).select("id", "prev", "next", "length", none.alias("p"), none.alias("n"), none.alias("more"))
        # What a taken arc tells its neighbours.
        back = taken.select(F.col("prev").alias("id"), none.alias("prev"), none.alias("next"), none.alias("length"), none.alias("p"), F.col("next").alias("n"), F.col("length").alias("more"))
        ahead = taken.where("next >= 0").select(F.col("next").alias("id"), none.alias("prev"), none.alias("next"), none.alias("length"), F.col("prev").alias("p"), none.alias("n"), none.alias("more"))
        told = stays.unionAll(back).unionAll(ahead).groupBy("id").agg(*(F.max(c).alias(c) for c in ("prev", "next", "length", "p", "n", "more")))
        now = materialise(told.select("id", F.coalesce("p", "prev").alias("prev"), F.coalesce("n", "next").alias("next"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")), "tour")
        gone.append(taken)
    fields = pa.schema([("id", pa.int64()), ("rank", pa.int64())])

    def walk(rows: pa.Table) -> pa.Table:
        ids, prev, length = (rows[c].to_pylist() for c in ("id", "prev", "length"))
        at = {own: i for i, own in enumerate(ids)}
        i, total, ranks = at[rows["id"][rows["next"].to_pylist().index(-1)].as_py()], 0, {}
        while True:
            total += length[i]
            ranks[ids[i]] = total
            if prev[i] < 0:
                break
            i = at[prev[i]]
        return pa.table([pa.array(list(ranks)), pa.array(list(ranks.values()))], schema=fields)

    # At most ``last`` rows.
    ranks = materialise(now.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(walk, "id long, rank long"), "tour-ranks")
    for taken in reversed(gone):
        after = ranks.select(F.col("id").alias("next"), "rank")
        found = taken.join(after, "next", "left").select("id", (F.col("length") + F.coalesce("rank", F.lit(0))).alias("rank"))
        ranks = materialise(ranks.unionAll(found), "tour-ranks")
    return ranks


def tour(nodes: DataFrame) -> DataFrame:
    """(id, prev, next) of two arcs a node: 2 n enters node n, 2 n + 1 leaves it.

    ``nodes``: number, parent, least and most (the parent's children, which have following
    numbers), first and final (the node's own children). The root's parent is null, as are the
    children of a node that has none.
    """
    n, root = F.col("number"), F.col("parent").isNull()
    enter = F.struct((2 * n).alias("id"), F.when(root, -1).when(n == F.col("least"), 2 * F.col("parent")).otherwise(2 * n - 1).alias("prev"), F.coalesce(2 * F.col("first"), 2 * n + 1).alias("next"))
    leave = F.struct((2 * n + 1).alias("id"), F.coalesce(2 * F.col("final") + 1, 2 * n).alias("prev"), F.when(root, -1).when(n == F.col("most"), 2 * F.col("parent") + 1).otherwise(2 * n + 2).alias("next"))
    return nodes.select(F.inline(F.array(enter, leave)))


def subtree_sums(nodes: DataFrame, columns: list[str], last: int = LAST) -> DataFrame:
    """(number, <columns>): each column added up over every node's subtree, itself included."""
    ranks = rank(tour(nodes), last)
    # Positions count down from the end, so that what lies between a node's arcs is the same.
    placed = ranks.select(F.expr("shiftright(id, 1)").alias("n"), (F.col("id") % 2 == 0).alias("enters"), F.col("rank").alias("at"))
    valued = placed.join(nodes.select(F.col("number").alias("n"), *columns), "n")
    valued = valued.withColumns({c: F.when(F.col("enters"), F.col(c)).otherwise(0) for c in columns} | {"stretch": F.expr(f"`at` div {STRETCH}")})
    valued = materialise(valued, "tour-values")
    own = Window.partitionBy("stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # One row a stretch.
    before = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = valued.groupBy(F.col("stretch").alias("s")).agg(*(F.sum(c).alias(c) for c in columns))
    starts = starts.select("s", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in columns))
    running = valued.withColumns({c: F.sum(c).over(own) for c in columns}).join(materialise(starts, "tour-starts"), F.col("stretch") == F.col("s"))
    upto = {c: F.col(c) + F.col(f"before_{c}") for c in columns}
    # Counted from the end, leaving comes first and adds nothing of the node itself.
    sums = [(F.max(F.when(F.col("enters"), v)) - F.max(F.when(~F.col("enters"), v))).cast("long").alias(c) for c, v in upto.items()]
    return running.groupBy(F.col("n").alias("number")).agg(*sums)


def turn_rows(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place from 1, a, b, words): each turn as two numbers that stand for its role and text."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = convs.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text")).where("conv_id is not null")
    whole = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    number = lambda at: F.conv(F.substring(whole, at, 15), 16, 10).cast("long")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = rows.withColumns({"a": number(1), "b": number(16), "words": words, "row": F.monotonically_increasing_id()})
    # Where turns tie, their order is that of their texts, which go along for these alone.
    key = ["conv_id", "turn", "role"]
    tied = materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "trie-tied")
    if tied.isEmpty():
        rows = rows.withColumn("tie", F.lit(""))
    else:
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in key))
        rows = rows.join(tied.select(*(F.col(c).alias(f"t_{c}") for c in key)), same, "left").withColumn("tie", F.when(F.col("t_conv_id").isNotNull(), F.col("text")).otherwise(""))
    placed = along(rows.select(*key, "tie", "row", "a", "b", "words"), ["conv_id"], ["turn", "role", "tie", "row"], "trie-places")
    return materialise(placed.select("conv_id", (F.col("place") + 1).alias("place"), "a", "b", "words"), "trie-placed")


def rebuilt(turns: DataFrame, step: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with shared beginnings: (conv_id, depth, a, b, words) and (conv_id, length).

    Conversation c begins with the first h turns of c - c % ``step``, as many as that has, and
    goes on with its own after its first h; h is the unsigned crc32 of c as text, modulo ``most``.
    """
    sizes = materialise(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    giver = sizes.select(F.col("conv_id").alias("giver"), F.col("n").alias("given"))
    plan = sizes.select("conv_id", "n", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % step).alias("giver")).join(giver, "giver", "left")
    plan = materialise(plan.select("conv_id", "n", "head", "giver", F.least("head", F.coalesce("given", F.lit(0))).alias("taken")), "trie-plan")
    first = turns.where(F.col("place") < most).select(F.col("conv_id").alias("giver"), "place", "a", "b", "words")
    begun = plan.select("conv_id", "giver", "taken").join(first, "giver").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "a", "b", "words")
    own = turns.join(plan.select("conv_id", "head", "taken"), "conv_id").where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "a", "b", "words")
    return begun.unionAll(own), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"))


def _digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): digest of the ids of each key, ascending, comma-joined.

    Ids are joined range by range to texts of bounded length; a key's texts are then digested
    one after the other, so that no task holds more than one of them.
    """
    part = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").withColumn("part", F.spark_partition_id())
    key_fields = [pa.field(k, pa.int64()) for k in keys]
    joined = pa.schema([*key_fields, ("part", pa.int32()), ("piece", pa.int32()), ("text", pa.string())])

    def join(batches):
        held, ids, size, piece = None, [], 0, 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in (*keys, "part", "conv_id"))):
                if row[:-1] != held or size > JOINED:
                    if ids:
                        out.append((*held, piece, ",".join(ids)))
                        piece += 1
                    held, ids, size = row[:-1], [], 0
                ids.append(str(row[-1]))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), joined)], schema=joined)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*held, piece, ",".join(ids)), joined)], schema=joined)

    schema = ", ".join(f"{k} long" for k in keys)
    texts = part.mapInArrow(join, f"{schema}, part int, piece int, text string")
    digested = pa.schema([*key_fields, ("ends_sha256", pa.string())])

    def digest(batches):
        held, state, out = None, None, []
        for batch in batches:
            for *key, text in zip(*(batch.column(k).to_pylist() for k in (*keys, "text"))):
                if key == held:
                    state.update(b",")
                else:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), digested)], schema=digested)
                out = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*held, state.hexdigest()), digested)], schema=digested)

    texts = materialise(texts, "trie-ends")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "part", "piece").mapInArrow(digest, f"{schema}, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, last: int = LAST) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node.

    ``turns``: conv_id, depth from 1 without gaps, a, b (numbers that stand for a turn), words;
    ``lengths``: conv_id, length, one row for each conversation, also where it has no turn.
    A node is named by its smallest member and its depth; parent_conv_id names the parent, null
    at the root. saved_tokens adds up (n_convs - 1) times the last turn's words over the subtree.
    ends_sha256 is a digest of the ids that end here. Turns are told apart by 120 bits and
    prefixes by 128. An empty table gives no rows.
    """
    mixed = turns.withColumns({"x": F.xxhash64("depth", "a", "b"), "y": F.xxhash64("b", F.lit(1), "a", "depth")})
    paths = along(mixed, ["conv_id"], ["depth"], "trie-paths", {"px": ("x", "xor"), "py": ("y", "xor")})
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("px"), zero.alias("py"), zero.alias("ux"), zero.alias("uy"), zero.alias("words"))
    rows = paths.select("conv_id", F.col("depth").cast("long").alias("depth"), "px", "py", F.col("px").bitwiseXOR(F.col("x")).alias("ux"), F.col("py").bitwiseXOR(F.col("y")).alias("uy"), "words").unionAll(roots)
    rows = materialise(rows, "trie-rows")
    key = ["depth", "px", "py"]
    made = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.first(c).alias(c) for c in ("ux", "uy", "words")))
    made = materialise(made, "trie-nodes")
    up = made.select((F.col("depth") + 1).alias("depth"), F.col("px").alias("ux"), F.col("py").alias("uy"), F.col("conv_id").alias("parent_conv_id"))
    named = materialise(made.join(up, ["depth", "ux", "uy"], "left").drop("ux", "uy"), "trie-named")
    # Numbered so that the children of a node follow each other.
    order = along(named.withColumn("all", F.lit(0)), ["all"], ["depth", "parent_conv_id", "conv_id"], "trie-order")
    order = materialise(order.drop("all").withColumnRenamed("place", "number"), "trie-order")
    kids = order.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.min("number").alias("first"), F.max("number").alias("final"), F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(order.join(materialise(kids, "trie-kids"), ["depth", "conv_id"], "left"), "trie-nodes")
    over = nodes.where("first is not null").select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("number").alias("parent"), F.col("first").alias("least"), F.col("final").alias("most"))
    nodes = nodes.join(over, ["depth", "parent_conv_id"], "left").withColumns({"n_leaves": F.col("first").isNull().cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = materialise(nodes, "trie-linked")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"], last)
    ends = rows.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select(*key, "conv_id")
    digests = materialise(_digests(ends, key), "trie-digests")
    found = nodes.drop("n_leaves", "saved_tokens").join(sums, "number").join(digests, key, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
