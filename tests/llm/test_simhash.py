import random

import xxhash

from millrace.llm import simhash
from millrace.llm.graph import components

SCHEMA = "doc_id long, text string, shard string, fp string"


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = [None, "", " \t\n", "One", "one", "two  WORDS here", "x" * 5000, "a " * 4000]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 30, 300]))
        rows.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
    rows += rows[-3:] * 5
    return rows


def plain(text, words):
    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def expected(rows, words, radius):
    prints = [plain(t, words) for t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and label[i] != label[j]:
                high, low = max(label[i], label[j]), min(label[i], label[j])
                label = [low if x == high else x for x in label]
    return {(i, f"{p:016x}", label[i]) for i, p in enumerate(prints)}


def test_same_as_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "s", "f") for i, t in enumerate(rows)], SCHEMA)
    found = {tuple(r) for r in simhash.near_duplicates(docs, words=4, radius=4).collect()}
    assert found == expected(rows, 4, 4)


def test_hot_shards_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 3)
    rows = texts(5)[:90]
    docs = spark.createDataFrame([(i, t, "s", "f") for i, t in enumerate(rows)], SCHEMA)
    found = {tuple(r) for r in simhash.near_duplicates(docs, words=4, radius=7).collect()}
    assert found == expected(rows, 4, 7)


def test_dense_shards_search_two_slices(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 0)
    rows = texts(6)[:120]
    docs = spark.createDataFrame([(i, t, "s", "f") for i, t in enumerate(rows)], SCHEMA)
    for radius in (4, 7):
        found = {tuple(r) for r in simhash.near_duplicates(docs, words=4, radius=radius).collect()}
        assert found == expected(rows, 4, radius)


def test_empty_repeated_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e", "", ""), (7, "a b c d e", "", ""), (7, "a b c d e", "", "")], SCHEMA)
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in found) == [(False, 7), (False, 7), (True, 7)]


def test_components_chain_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)] + [(5, 5), (100, 101), (101, 100), (None, 3)]
    edges = spark.createDataFrame(chain, "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}
