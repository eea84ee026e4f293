"""Merkle manifest of a dataset as a postorder append log.

Each tree (one a source) hashes runs of FAN nodes, level by level, to one root; the roots of all
trees are the leaves of one more tree. Leaves are dealt to builders in aligned blocks of
FAN ** LEVELS. A builder appends the nodes of its block in the order in which they are completed,
children before their parent, and the next round's builders do the same over the tops of blocks,
until every tree has one node.

Where a node stands in the whole tree's log follows from the sizes of the subtrees before it
alone (``position``), so builders need not know of each other and a proof's siblings are read at
computed positions. Proofs are taken from the top down: a block gets the siblings of its own top
as a few rows and adds those inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import along, materialise

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
LOG = "tree string, width long, level int, number long, position long, digest string"
LOG_FIELDS = pa.schema([("tree", pa.string()), ("width", pa.int64()), ("level", pa.int32()), ("number", pa.int64()), ("position", pa.int64()), ("digest", pa.string())])
STEPS = "tree string, block long, position long, digest string, at int"
STEP_FIELDS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("position", pa.int64()), ("digest", pa.string()), ("at", pa.int32())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(width: int) -> int:
    """Levels above ``width`` leaves until one node is left."""
    level = 0
    while FAN**level < width:
        level += 1
    return level


def position(level: int, number: int, width: int) -> int:
    """Place in the log of the ``number``-th node of a level, in a tree of ``width`` leaves.

    Before it lie all nodes of its own and lower levels over the leaves up to its last one, and
    those of higher levels that were full before that leaf.
    """
    last = min(width, (number + 1) * FAN**level)
    place = sum(-(-last // FAN**k) for k in range(level + 1)) - 1
    k = level + 1
    while FAN**k < last:
        place += (last - 1) // FAN**k
        k += 1
    return place


def _build(base: int):
    """A builder of one block of nodes of level ``base``."""

    def complete(units: pa.Table) -> pa.Table:
        units = units.sort_by("number")
        tree, width = units["tree"][0].as_py(), units["width"][0].as_py()
        top, pending, log = height(width), [[] for _ in range(LEVELS)], []

        def append(step: int, number: int, own: str) -> None:
            level = base + step
            if step or not base:
                log.append((tree, width, level, number, position(level, number, width), own))
            if step < LEVELS and level < top:
                pending[step].append(own)
                if len(pending[step]) == FAN:
                    close(step, number)

        def close(step: int, number: int) -> None:
            own = digest("".join(pending[step]))
            pending[step].clear()
            append(step + 1, number // FAN, own)

        numbers = units["number"].to_pylist()
        for number, own in zip(numbers, units["digest"].to_pylist()):
            append(0, number, own)
        if numbers[-1] == -(-width // FAN**base) - 1:  # the tree ends here
            for step in range(LEVELS):
                if pending[step]:
                    close(step, numbers[-1] // FAN**step)
        columns = zip(*log) if log else [()] * len(LOG_FIELDS)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, LOG_FIELDS)], schema=LOG_FIELDS)

    return complete


def append_log(leaves: DataFrame, label: str = "merkle-log") -> list[DataFrame]:
    """The logs of each round of builders, lowest first; together they are the trees' whole logs.

    ``leaves``: tree, number, width (leaves of the tree), digest. Rounds grow with the logarithm
    of the widest tree; each groups nodes by aligned blocks of bounded size.
    """
    widest = leaves.agg(F.max("width")).first()[0] or 0
    units, base, logs = leaves, 0, []
    while not base or FAN**base < widest:
        block = units.select("tree", "width", "number", "digest", F.expr(f"number div {BLOCK}").alias("block"))
        logs.append(materialise(block.groupBy("tree", "block").applyInArrow(_build(base), LOG), label))
        base += LEVELS
        units = logs[-1].where((F.col("level") == base) & (F.col("width") > FAN**base))
    return logs


def tops(logs: Sequence[DataFrame]) -> DataFrame:
    """(tree, width, digest) of each tree's root."""
    rows = [log.where("number = 0 and shiftleft(1L, 4 * level) >= width and (level = 0 or shiftleft(1L, 4 * level - 4) < width)") for log in logs]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionAll(more)
    return out.select("tree", "width", "digest")


def _extract(base: int, emit, schema: pa.Schema):
    """Paths of one block's units from the log: their siblings stand at computed positions."""

    def run(units: pa.Table, log: pa.Table) -> pa.Table:
        if not units.num_rows:
            return schema.empty_table()
        nodes, above = {}, []
        for place, own, at in zip(*(log[c].to_pylist() for c in ("position", "digest", "at"))):
            if place >= 0:
                nodes[place] = own
            else:
                above.append((-place, own, at))
        above = [x[1:] for x in sorted(above)]
        top, upper = above[0][0], above[1:]
        width = units["width"][0].as_py()
        levels, runs, out = min(base + LEVELS, height(width)), {}, []
        for row in units.to_pylist():
            path, number = [], row["number"]
            for level in range(base, levels):
                group, at = divmod(number, FAN)
                if (level, group) not in runs:
                    last = min((group + 1) * FAN, -(-width // FAN**level))
                    runs[level, group] = [nodes[position(level, i, width)] for i in range(group * FAN, last)]
                own = runs[level, group]
                path.append(("".join(own[:at] + own[at + 1 :]), 64 * at))
                number = group
            out += emit(row, top, path + upper)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _steps(row, top, path):
    return [(row["tree"], row["number"], -1, top, None), *((row["tree"], row["number"], -2 - k, siblings, at) for k, (siblings, at) in enumerate(path))]


def fold(own: str, path: Sequence[tuple[str, int]]) -> str:
    """The root to which a node's digest leads along its siblings."""
    for siblings, at in path:
        own = digest(siblings[:at] + own + siblings[at:])
    return own


def extract(leaves: DataFrame, logs: Sequence[DataFrame], above: DataFrame, emit=_steps, fields: pa.Schema = STEP_FIELDS, schema: str = STEPS, label: str = "merkle-steps") -> DataFrame:
    """What ``emit`` makes of each leaf's path, its own tree's levels and those of ``above``.

    ``above``: tree, width, position, digest, at; at -1 the tree's root, at -2, -3, ... the
    siblings over it, bottom up.
    """
    carried = None
    for r in reversed(range(len(logs))):
        base = r * LEVELS
        inner = [logs[r].where((F.col("level") < base + LEVELS) & (F.col("level") > base if r else F.lit(True)))]
        if r:
            inner.append(logs[r - 1].where((F.col("level") == base) & (F.col("width") > FAN**base)))
        low = F.col("width") > FAN**base if r else F.lit(True)
        rows = above.where((F.col("width") <= FAN ** (base + LEVELS)) & low).select("tree", F.lit(0).cast("long").alias("block"), "position", "digest", "at")
        for nodes in inner:
            block = F.expr(f"number div cast(pow({FAN}, {LEVELS + base} - level) as bigint)")
            rows = rows.unionAll(nodes.select("tree", block.alias("block"), "position", "digest", F.lit(None).cast("int").alias("at")))
        if carried is not None:
            rows = rows.unionAll(carried)
        units = leaves if not r else logs[r - 1].where((F.col("level") == base) & (F.col("width") > FAN**base)).select("tree", "number", "width")
        units = units.withColumn("block", F.expr(f"number div {BLOCK}")).groupBy("tree", "block")
        own = (emit, fields, schema) if not r else (_steps, STEP_FIELDS, STEPS)
        found = units.cogroup(rows.groupBy("tree", "block")).applyInArrow(_extract(base, *own[:2]), own[2])
        carried = materialise(found, label) if r else found
    return carried


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with number and width inside their tree."""
    placed = materialise(along(rows, ["tree"], order, label).withColumnRenamed("place", "number"), label)
    widths = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("width"))
    return placed.join(materialise(widths, label), "tree")


def leaf(docs: DataFrame, columns: Sequence[str], changed: dict | None = None):
    """Digest of a row: each column's UTF-8 byte count, a colon and its text; a null is a dash."""
    parts = []
    for c in columns:
        value = (changed or {}).get(c, F.col(c).cast("string"))
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", tree_col: str = "source", tampered=None, keep_siblings: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row.

    A row's digest covers ``columns``; rows of one ``tree_col`` ascend by id, null ids first, then
    by digest, and equal rows are leaves of their own. Trees ascend by name, null first. The
    proof is the row's siblings at each level, bottom up, and its digest covers them all; with
    ``keep_siblings`` they follow as ``siblings`` and ``at`` (hex characters before the row's
    own). ``tampered``, a column, is a row's digest after tampering; folded_root recomputes the
    root from it, where it is not null, else from the leaf, with the original siblings.

    Nulls count as null in every column; texts of any length are hashed whole. Other columns do
    not matter. An empty table gives no rows. A tree may hold any share of the rows.
    """
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(F.col(tree_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string"))).alias("tree"),
        leaf(docs, columns).alias("digest"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"),
    )
    rows = materialise(named.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    leaves = materialise(numbered(rows, ["doc_id", "digest", "row"], "merkle-leaves").drop("row"), "merkle-leaves")
    logs = append_log(leaves.select("tree", "number", "width", "digest"))
    subroots = materialise(tops(logs), "merkle-subroots")
    names = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("width").alias("own_width"), "digest")
    names = materialise(numbered(names, ["name"], "merkle-names"), "merkle-names")
    upper = append_log(names.select("tree", "number", "width", "digest"), "merkle-root")
    root = tops(upper).first()
    root = root["digest"] if root else ""
    over = names.select("tree", "width", F.lit(-1).cast("long").alias("position"), F.lit(root).alias("digest"), F.lit(None).cast("int").alias("at")).distinct()
    steps = extract(names.select("tree", "number", "width"), upper, over, label="merkle-root-steps")
    own = steps.join(names.select(F.col("number").alias("block"), "name", "own_width", F.col("digest").alias("subroot")), "block")
    above = own.select(F.col("name").alias("tree"), F.col("own_width").alias("width"), "position", F.when(F.col("position") == -1, F.col("subroot")).otherwise(F.col("digest")).alias("digest"), "at")
    schema = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
    kinds = [("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))]
    if keep_siblings:
        schema += ", siblings array<string>, at array<int>"
        kinds += [("siblings", pa.list_(pa.string())), ("at", pa.list_(pa.int32()))]

    def prove(row, top, path):
        siblings = [s for s, _ in path]
        made = (row["doc_id"], row["digest"], top, digest("".join(siblings)), fold(row["tampered"] or row["digest"], path))
        return [made + (siblings, [at // 64 for _, at in path]) if keep_siblings else made]

    found = extract(leaves, logs, materialise(above, "merkle-above"), prove, pa.schema(kinds), schema)
    return found.withColumns({"root": F.lit(root), "verified": F.col("folded_root") == F.lit(root)})
