import random

import numpy as np
import pytest

from millrace.llm import likeness, simhash

SCHEMA = "doc_id long, text string, sid string, root string"


def texts(seed, size=12):
    rng = random.Random(seed)
    vocabulary, common = ["w%d" % i for i in range(400)], ["c%d" % i for i in range(40)]
    rows = [None, "", " \t", "One", "one", "two  WORDS here"]
    for _ in range(size):
        base = rng.choices(vocabulary, k=rng.choice([4, 30, 120, 600])) + common * rng.randrange(2)
        rows.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy[: len(copy) - rng.randrange(max(1, len(copy) // 4))]))
    return rows + rows[-4:]


def plain(text, words):
    found = (text or "").lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def expected(rows, words, least):
    """The brute-force links, and the smallest row reachable over them."""
    sets, label, links = [plain(t, words) for t in rows], list(range(len(rows))), []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= least:
                links.append((i, j))
                if label[i] != label[j]:
                    high, low = max(label[i], label[j]), min(label[i], label[j])
                    label = [low if x == high else x for x in label]
    return links, label


@pytest.mark.parametrize(("seed", "first", "lot"), [(1, 64, 1 << 22), (2, 1, 2_000)])
def test_against_brute_force(spark, monkeypatch, seed, first, lot):
    monkeypatch.setattr(likeness, "FIRST", first)
    monkeypatch.setattr(likeness, "LOT", lot)
    rows = texts(seed, 30)
    docs = spark.createDataFrame([(i, t, "s", "r") for i, t in enumerate(rows)], SCHEMA)
    links, label = expected(rows, 5, 0.8)
    found = {tuple(r) for r in likeness.groups(docs).collect()}
    group = dict(found)
    assert len(found) == len(rows) and all(group[g] == g for g in group.values())
    # no group joins what brute force keeps apart, and nearly all links are inside a group
    assert all(label[i] == label[g] for i, g in group.items())
    assert np.mean([group[i] == group[j] for i, j in links]) >= 0.97


def test_large_group_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(likeness, "SHARD_ROWS", 50)
    rng = random.Random(4)
    base = rng.choices(["w%d" % i for i in range(400)], k=200)
    rows = []
    for _ in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = "x%d" % rng.randrange(1000)
        rows.append(" ".join(copy))
    rows += [" ".join(rng.choices(base, k=90)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "s", "r") for i, t in enumerate(rows)], SCHEMA)
    group = dict(tuple(r) for r in likeness.groups(docs).collect())
    assert [group[i] for i in range(320)] == [0] * 300 + list(range(300, 320))


def test_keeps_one_of_each_group(spark):
    rows = texts(1)
    docs = spark.createDataFrame([(i, t, "s", "r") for i, t in enumerate(rows)], SCHEMA)
    group = dict(tuple(r) for r in likeness.groups(docs).collect())
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == sorted(set(group.values()))


def test_empty_and_null_ids(spark):
    assert likeness.groups(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f", "", ""), (7, "a b c d e f", "", ""), (7, "a b c d e f", "", ""), (8, None, "", ""), (9, "", "", "")], SCHEMA)
    found = likeness.groups(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [(0, 7), (7, 7), (7, 7), (8, 8), (9, 8)]


def test_family_too_unlike_makes_few_pairs(spark, monkeypatch):
    rng, tested, kept = random.Random(9), [], likeness.materialise

    def counted(df, label):
        written = kept(df, label)
        if label == "likeness-pairs":
            tested.append(written.count())
        return written

    monkeypatch.setattr(likeness, "materialise", counted)
    base, rows = ["w%d" % i for i in range(150)], []
    for i in range(150):
        copy = list(base)
        for at in range(3):
            copy[rng.randrange(150)] = f"x{i}-{at}"
        rows.append(" ".join(copy))
        if i % 5 == 0:
            rows.append(" ".join([*copy[:-1], "last"]))
    docs = spark.createDataFrame([(i, t, "s", "r") for i, t in enumerate(rows)], SCHEMA)
    links, label = expected(rows, 5, 0.8)
    assert [g for _, g in sorted(likeness.groups(docs).collect())] == label
    # of the family's 16,000 pairs few are alike; the last step tests few others
    assert len(tested) == 2 and tested[1] < 3 * len(links) + len(rows)


def test_parities_differ_in_no_more_than_members(spark):
    rng = np.random.default_rng(3)
    for size in (0, 1, 20, 700, 5_000):
        members = np.unique(rng.integers(-(1 << 63), 1 << 63, size))
        other = np.unique(np.r_[members[size // 7 :], rng.integers(-(1 << 63), 1 << 63, size // 9)])
        differ = np.bitwise_count((likeness.parities(members) ^ likeness.parities(other)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(members, other)) and (size != 20 or differ > 0)
