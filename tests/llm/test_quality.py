import random
import zlib

import numpy as np
import pytest

from millrace.llm import quality

DOCS, LABELS = "doc_id long, text string, score string, quality int", "doc_id long, quality int, toxic int"


def rows(n=600):
    rng = random.Random(4)
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)]
        yield i, " ".join(w + "###" if i % 3 == 0 else w for w in words), int(i % 3 != 0)


def test_learns_and_holds_out(spark):
    made = list(rows())
    docs = spark.createDataFrame([(i, t, "", 0) for i, t, _ in made] + [(None, None, "", 0), (9000, "", "", 0), (0, made[0][1], "", 0)], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made] + [(None, 1, 0), (3, None, None)], LABELS)
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(made) + 3
    truth = {i: q for i, _, q in made}
    assert all(r.predicted == truth[r.doc_id] for r in found if r.doc_id in truth)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert [r.held_out for r in found if r.doc_id is None] == [False]


def test_held_out_labels_do_not_count(spark):
    made = [(i, t, q) for i, t, q in rows(60)]
    docs = spark.createDataFrame([(i, t, "", 0) for i, t, _ in made], DOCS)
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q
    one, two = (spark.createDataFrame([(i, f(i, q), 0) for i, _, q in made], LABELS) for f in (lambda i, q: q, flip))
    a, b = (sorted((r.doc_id, r.score) for r in quality.classify(docs, x).collect()) for x in (one, two))
    assert a == b


def test_no_labels_and_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a b", "", 0)], DOCS), spark.createDataFrame([], LABELS)
    assert [(r.score, r.predicted) for r in quality.classify(docs, labels).collect()] == [(0.5, 1)]
    assert quality.classify(docs.where("doc_id = 2"), labels).collect() == []


def test_long_texts_and_repeats(spark):
    made = [(i, t, q) for i, t, q in rows(90)]
    docs = spark.createDataFrame([(i, t, "", 0) for i, t, _ in made] + [(500, made[1][1] * 4000, "", 0), (501, made[0][1] * 4000, "", 0), (2, made[2][1], "", 0)], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made], LABELS)
    found = quality.classify(docs, labels).collect()
    assert len(found) == 93 and len({r.score for r in found if r.doc_id == 2}) == 1
    model = quality.train(docs, labels)
    for i, text in ((500, made[1][1] * 4000), (501, made[0][1] * 4000)):
        assert [r.score for r in found if r.doc_id == i] == [model.score(np.array([quality.statistics(text)]))[0]]
    assert sorted(r.doc_id for r in quality.keep_good(docs, labels).collect()) == sorted(r.doc_id for r in found if r.predicted)


def test_fit_by_trying_every_split():
    """Each split has the greatest gain of all, each leaf the step that its rows call for."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(150, 4)), rng.integers(0, 2, 150).astype(float)
    x[:, 1] += y
    ridge, rate, depth = 5.0, 0.1, 3
    model = quality.fit(x, y, trees=6, depth=depth, rate=rate, bins=16, ridge=ridge)
    binned, inner, total = model.bins(x), (1 << depth) - 1, np.full(len(y), model.prior)
    assert model.prior == pytest.approx(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)  # noqa: B023, E731
        members = {0: np.arange(len(y))}
        for node in range(inner):
            own = members[node]
            gain = lambda f, c: part(own[binned[own, f] <= c]) + part(own[binned[own, f] > c]) - part(own)  # noqa: B023, E731
            best = max(gain(f, c) for f in range(4) for c in range(16))
            assert max(best, 1e-6) == pytest.approx(max(gain(feature[node], cut[node]), 1e-6), abs=1e-9)
            right = binned[own, feature[node]] > cut[node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
        for k in range(inner + 1):
            own = members[inner + k]
            assert leaf[k] == pytest.approx(rate * g[own].sum() / (h[own].sum() + ridge))
            total[own] += leaf[k]


def test_flat_trees_equal_walked_trees():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 5)), rng.integers(0, 2, 400).astype(float)
    x[:, 0] += 2 * y
    model = quality.fit(x, y, trees=20, depth=3)
    binned = model.bins(x)
    for i in range(50):
        total = model.prior
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(binned[i, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert model.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
