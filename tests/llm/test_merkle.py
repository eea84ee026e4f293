"""The manifest against a plain Merkle tree, its log's positions, proofs and edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, text, lang, source, n_chars = row
    return h("".join(part(v) for v in (doc_id, source, lang, n_chars, text)))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def plain(rows):
    """doc_id, leaf, subroot, root, proof digest of every row."""
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = levels_of([built[s][-1][0] for s in names])
    found = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, doc_id) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            proof = ""
            for levels, at in ((built[s], i), (top, k)):
                for level in levels[:-1]:
                    first = at // 16 * 16
                    proof += "".join(level[first:at] + level[at + 1 : first + 16])
                    at //= 16
            found.append((doc_id, leaf, built[s][-1][0], top[-1][0], h(proof)))
    return found


def rows_of(n, sources):
    return [(i * 7 % n if i % 11 else None, None if i % 5 == 0 else f"Text Ä{i}" * (i % 4), "en" if i % 3 else None, sources[i % len(sources)], i) for i in range(n)]


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256")


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 300])
def test_same_as_plain_tree(spark, n):
    rows = rows_of(n, ["b", None, "", "b", "a"])
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in made), key=key) == sorted(plain(rows), key=key)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in made)


def test_several_rounds_of_builders(spark):
    """A tree of over one block: its upper levels are a second round."""
    rows = [(i, "t", "en", "hot" if i % 10 else f"s{i}", i) for i in range(5000)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in made) == sorted(plain(rows))


@pytest.mark.parametrize("width", [1, 15, 16, 17, 255, 256, 257, 4097, 5000])
def test_positions_are_the_order_of_completion(width):
    order, pending = [], {}

    def done(level, number):
        order.append((level, number))
        if level < merkle.height(width):
            pending[level] = pending.get(level, 0) + 1
            if pending[level] == 16:
                pending[level] = 0
                done(level + 1, number // 16)

    for i in range(width):
        done(0, i)
    for level in range(merkle.height(width)):
        if pending.get(level):
            pending[level] = 0
            done(level + 1, (-(-width // 16**level) - 1) // 16)
    assert [merkle.position(level, number, width) for level, number in order] == list(range(len(order)))


def test_log_is_whole_and_gapless(spark):
    leaves = spark.range(5000).select(F.lit("x").alias("tree"), F.col("id").alias("number"), F.lit(5000).cast("long").alias("width"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    logs = merkle.append_log(leaves)
    rows = [r for log in logs for r in log.collect()]
    assert sorted(r["position"] for r in rows) == list(range(len(rows))) and len(logs) == 2
    levels = levels_of([h(str(i)) for i in range(5000)])
    assert {(r["level"], r["number"]): r["digest"] for r in rows} == {(k, i): x for k, level in enumerate(levels) for i, x in enumerate(level)}


def test_tampered_rows_fail_and_siblings_prove(spark):
    docs = spark.createDataFrame(rows_of(40, ["a", "b"]), SCHEMA)
    bent = F.when(F.col("n_chars") % 4 == 1, merkle.leaf(docs, merkle.COLUMNS, {"text": F.lower("text")}))
    made = merkle.manifest(docs, tampered=bent, keep_siblings=True).collect()
    original = {r["leaf"]: r for r in docs.select("*", merkle.leaf(docs, merkle.COLUMNS).alias("leaf")).collect()}
    for r in made:
        row = original[r["leaf"]]
        assert r["verified"] == (not (row["n_chars"] % 4 == 1 and row["text"] not in (None, "")))
        assert merkle.fold(r["leaf"], [(s, 64 * at) for s, at in zip(r["siblings"], r["at"])]) == r["root"]


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0
    rows = [(1, "x" * 300_000, "en", "s", 1)] * 40 + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("tree"), F.lit("n").alias("number"), F.lit(0).alias("digest"), F.lit(0).alias("width"))
    made = merkle.manifest(docs).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in made), key=key) == sorted(plain(rows), key=key)
