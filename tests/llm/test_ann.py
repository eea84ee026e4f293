import math

import numpy as np
import pytest

from millrace.llm import ann

SCHEMA = "vec_id long, embedding array<float>, head string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "h", 1) for i, v in rows], SCHEMA)


def brute(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            near = sorted((-(q @ v) / math.sqrt(q @ q) / math.sqrt(v @ v), j) for j, v in ok if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def run(spark, rows, k=5):
    vectors, found = frame(spark, rows), {}
    for r in ann.search(vectors, vectors.where("vec_id % 50 = 0"), k).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [x[i] for i in range(1, len(x) + 1)] for q, x in found.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 32)).astype(np.float32))]
    found, true = run(spark, rows), brute(rows, 5)
    assert found.keys() == true.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in true[q]}) for q in true)
    assert hits / (5 * len(true)) >= 0.9
    exact = {q: dict(brute([(i, v) for i, v in rows if i == q or i in dict(found[q])], 5)[q]) for q in list(true)[:20]}
    for q, own in exact.items():
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        assert all(s == pytest.approx(own[i], abs=1e-12) for i, s in found[q])


@pytest.mark.parametrize("blocks", [4096, 7])
def test_ties_copies_and_unsound_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "ENTRIES", blocks)
    monkeypatch.setattr(ann, "QUERIES", blocks)
    one, two = [1.0, 2.0, 0.5], [0.0, -1.0, 3.0]
    rows = [(i, one) for i in range(0, 400)] + [(i, two) for i in range(400, 420)] + [(400, two), (None, one)]
    rows += [(1000, None), (1050, [0.0, 0.0, 0.0]), (1100, [1.0, None, 2.0]), (1150, [float("nan"), 1.0, 1.0]), (1200, [1.0, 1.0]), (1250, [])]
    found, true = run(spark, rows), brute([r for r in rows if not r[1] or len(r[1]) == 3], 5)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in dict.fromkeys(x)] for q, x in true.items() if q < 400} | {400: [401, 402, 403, 404, 405]}


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert run(spark, [(0, [1.0, 0.0]), (7, [1.0, 1.0])]) == {0: [(7, pytest.approx(math.sqrt(0.5)))]}
