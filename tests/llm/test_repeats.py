import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import repeats

SCHEMA = "doc_id long, text string, data string, k string"


def plain(texts, length):
    data, counts = [(t or "").encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - length + 1):
            counts[d[i : i + length]] = counts.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def texts(seed, unit):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(unit)) for _ in range(4)]
    rows = [None, "", "short", "a" * 1500, "ab" * 700, "xyz" * 300 + "q" + "xyz" * 300]
    for i in range(25):
        body = [" ".join(word() for _ in range(rng.choice([1, 20, 120]))) for _ in range(3)]
        if i % 2:
            body.insert(rng.randrange(4), rng.choice(passage))
        if i % 5 == 0:
            body.insert(0, passage[0][rng.randrange(60) :])
        rows.append("".join(body))
    return rows + rows[-4:] + [rows[9]] * 6


@pytest.mark.parametrize(("length", "gram", "letter"), [(400, 200, 200), (400, 200, 100), (40, 11, 10)])
def test_same_as_brute_force(spark, length, gram, letter):
    rows = texts(length, length // 3)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], SCHEMA).repartition(5)
    found = repeats.remove_repeats(docs, length=length, gram=gram, letter_bytes=letter, digest=True).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == dict(enumerate(plain(rows, length)))


@pytest.mark.parametrize("cap", [0, 2, 5])
def test_groups_dealt_anew(spark, monkeypatch, cap):
    monkeypatch.setattr(repeats, "GROUP_STRINGS", cap)
    rows = texts(77, 20)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], SCHEMA).repartition(3)
    found = repeats.remove_repeats(docs, length=40, gram=11, letter_bytes=10, digest=True).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == dict(enumerate(plain(rows, 40)))


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rows = texts(9, 130)
    rows.append("".join(t or "" for t in rows))
    own = [(i, (t or "").encode()) for i, t in enumerate(rows)]
    assert own[-1][1]
    import numpy as np

    whole = {}
    for i, data in own:
        for at in range(0, max(1, len(data) - 399), 1000):
            part = np.frombuffer(data[at : at + 1399], np.uint8)
            start, count, anchor, _ = repeats.stretches(part, np.zeros(len(part), np.int32), 400, 200)
            for s, n, a in zip(start, count, anchor):
                for p in range(s, s + n):
                    whole.setdefault(data[at + p : at + p + 400], set()).add(int(a))
    assert whole and all(len(a) == 1 for a in whole.values())


def test_repeated_rows_null_ids_and_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA), digest=True).collect() == []
    long = "".join(random.Random(1).choices("abcdefgh", k=500))
    docs = spark.createDataFrame([(None, long, "", ""), (3, long[50:] + "z", "", ""), (3, long[50:] + "z", "", "")], SCHEMA)
    found = repeats.remove_repeats(docs, keep=("data",)).collect()
    assert sorted((r.doc_id or 0, r.n_removed, bytes(r.kept), r.keep_data) for r in found) == [(0, 450, long[:50].encode(), ""), (3, 451, b"", ""), (3, 451, b"", "")]


def plain_words(texts, length):
    split, counts = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts], {}
    for words in split:
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            counts[key] = counts.get(key, 0) + 1
    out = []
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if counts[tuple(words[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(([w for w, g in zip(words, gone) if not g], sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
    return out


@pytest.mark.parametrize("cap", [0, 3, 1000])
def test_words_same_as_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(repeats, "GROUP_STRINGS", cap)
    rows = [t and t.replace("c", "\n", 1) for t in texts(31, 30)] + ["tick tock " * 40]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], SCHEMA).repartition(4)
    found = {r.doc_id: (bytes(r.kept).decode().split(), r.n_spans) for r in repeats.remove_repeats(docs, length=12, words=True).collect()}
    assert found == dict(enumerate(plain_words(rows, 12)))


@pytest.mark.parametrize("stride", [1, 3])
def test_common_prefixes(stride):
    rng = np.random.default_rng(stride)
    strings = [rng.integers(0, 2, n).astype(np.uint8) for n in (0, 5, 9, 30, 31, 44)]
    strings.append(strings[3].copy())
    found = repeats.repeated_windows(strings, np.ones(len(strings), np.int64), 6, stride)
    every = [bytes(x[i : i + 6]) for x in strings for i in range(len(x) - 5)]
    want = {(k, i) for k, x in enumerate(strings) for i in range(len(x) - 5) if every.count(bytes(x[i : i + 6])) > 1}
    assert set(zip(*(x.tolist() for x in found))) == want


def test_spans_are_not_compared_pair_by_pair(spark):
    passages = ["%08d" % (7919 * i) for i in range(400)]
    text = "".join(f"{p}<{i:x}>" for i, p in enumerate(passages + passages[::-1]))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:5000])], "doc_id long, text string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = repeats.spans(rows, 8, 4, 8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan
    spans = {r.doc_id: [(s.low, s.high) for s in r.spans] for r in found.collect()}
    # both rows of id 1 bring each run, which counts once
    assert all(own == sorted(set(own)) for own in spans.values())
    assert len({s for low, high in spans[1] for s in range(low, high)}) == len(text) - 7


def test_merge_leaves_settled_suffixes_alone(monkeypatch):
    rng = np.random.default_rng(8)
    common = rng.integers(1, 200, 60)
    strings = [np.r_[rng.integers(1, 200, 40), common, rng.integers(1, 200, 40), 0] for _ in range(40)]
    letter = np.concatenate(strings)
    size = len(strings[0])
    at = np.arange(len(letter))
    following = np.where(letter == 0, at, at + 1)
    before = np.where(at % size == 0, 0, letter[at - 1])
    edges, rounds = np.arange(5) * 10 * size, 50
    sort, sorted_ = np.argsort, []
    monkeypatch.setattr(repeats.np, "argsort", lambda a, *x, **k: sorted_.append(len(a)) or sort(a, *x, **k))
    place, shared = repeats.merged_prefixes(letter, before, following, edges, rounds)
    # every round sorted all suffixes twice before
    assert sum(sorted_) < 10 * len(letter)
    start = [tuple(letter[i : i - i % size + size].tolist())[:rounds] for i in place]
    assert start == sorted(start) and sorted(place.tolist()) == at.tolist()
    for a, b, n in zip(start, start[1:], shared[1:]):
        alike = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), rounds)
        assert n == alike
