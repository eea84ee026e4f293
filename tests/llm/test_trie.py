"""The trie against plain dictionaries, the ranked tour, and edge cases."""

import hashlib
import random
import re
import zlib

import pytest

from millrace.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(v)] for c, v in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(talks.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    found = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = sorted(c for c in ids if len(built[c]) == len(path))
        found.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return found


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def made(spark, rows, last=trie.LAST):
    turns, lengths = trie.rebuilt(trie.turn_rows(spark.createDataFrame(rows, SCHEMA)))
    return [tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(turns, lengths, last).collect()]


def talks(n, seed):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, None if turn == 0 and c % 4 == 0 else turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", None, "", "d\te f"])))
    return rows


@pytest.mark.parametrize("n,last", [(1, 10), (60, trie.LAST), (60, 8)])
def test_same_as_plain_trie(spark, n, last):
    rows = talks(n, n)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(made(spark, rows, last), key=key) == sorted(plain(rows), key=key)


def test_rank_in_rounds(spark):
    order = list(range(500))
    random.Random(3).shuffle(order)
    rows = [(x, order[i - 1] if i else -1, order[i + 1] if i < 499 else -1) for i, x in enumerate(order)]
    ranks = trie.rank(spark.createDataFrame(rows, "id long, prev long, next long"), 7).collect()
    assert {r["id"]: r["rank"] for r in ranks} == {x: 500 - i for i, x in enumerate(order)}


def test_edge_cases(spark):
    assert made(spark, []) == []
    rows = [(1, 0, "user", "hello " * 50_000)] * 3 + [(None, 0, "user", "x"), (41, 0, "user", "y"), (42, 0, None, None)]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(made(spark, rows), key=key) == sorted(plain(rows), key=key)
    # One conversation with most rows, and one text that ends many conversations.
    rows = [(0, i, "user", str(i % 7)) for i in range(1500)] + [(c, 0, "user", "same") for c in range(1, 400)]
    turns, lengths = trie.rebuilt(trie.turn_rows(spark.createDataFrame(rows, SCHEMA)))
    wide = turns.selectExpr("*", "1 as n", "2 as all", "3 as number")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(wide.drop("n", "all", "number"), lengths).collect()), key=key) == sorted(fast(rows), key=key)


def fast(rows):
    """plain() by children instead of by comparing all prefixes."""
    turns = {}
    for c, turn, role, text in rows:
        turns.setdefault(c, []).append((turn, role, text))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in turns.items()}
    nodes, ends, root = {}, {}, [None, 0, {}, 0, 0]
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        path, node = turns.get(c - c % 20, [])[:h] + turns[c][h:], root
        for step, t in enumerate([None, *path]):
            node = node if t is None else node[2].setdefault(t, [None, step, {}, 0, len(t[1].split())])
            node[0] = c if node[0] is None else node[0]
            node[3] += 1
        ends.setdefault(id(node), []).append(c)
    found, stack = [], [(root, None, False)]
    sums = {}
    while stack:
        node, parent, seen = stack.pop()
        if not seen:
            stack += [(node, parent, True), *((x, node, False) for x in node[2].values())]
            continue
        below = [sums[id(x)] for x in node[2].values()]
        sums[id(node)] = sum(x[0] for x in below) or 1, (node[3] - 1) * node[4] + sum(x[1] for x in below)
        digest = hashlib.sha256(",".join(map(str, ends.get(id(node), []))).encode()).hexdigest()
        found.append((node[0], node[1], parent and parent[0], node[3], len(node[2]), *sums[id(node)], digest))
    return found
