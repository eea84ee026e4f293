import hashlib
import random

from millrace.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, run string, tie string"


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(400)}é" for _ in range(rng.choice([1, 4, 9, 80, 500, 2000]))) for _ in range(n)]


def jaccard(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4)) if w}
    x, y = grams(a), grams(b)
    return len(x & y) / max(1, len(x | y))


def test_neighbours_edits_and_likeness(spark):
    rows = [(i * 7 - 40, t) for i, t in enumerate(texts(60) + ["", None, "x"])]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA).repartition(6)
    found = {r.doc_id: r for r in fp.compare_neighbours(docs).collect()}
    assert len(found) == len(rows)
    gaps = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = fp.edit(text, following)
        half = len(text) // 2
        assert edited == text[: len(text) - half] + following[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == len(r.edited_fingerprint) == fp.BINS
        if len(text.split()) >= 80:
            gaps.append(abs(r.near_edited - jaccard(text, edited)))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(gaps) / len(gaps) < 0.03 and max(gaps) < 0.15


def test_equal_texts_repeats_nulls(spark):
    docs = spark.createDataFrame([(None, "a b", "", ""), (1, "same text", "", ""), (1, "same text", "", ""), (2, "", "", ""), (3, None, "", "")], SCHEMA)
    found = fp.compare_neighbours(docs).collect()
    assert len(found) == 5
    assert len({r.fingerprint for r in found if r.doc_id == 1}) == 1
    assert {r.fingerprint for r in found if r.doc_id in (2, 3)} == {"0" * fp.BINS}
    one = fp.compare_neighbours(docs.where("doc_id = 2")).collect()
    assert [(r.near_edited, r.near_next) for r in one] == [(1.0, 1.0)]
    assert fp.compare_neighbours(docs.where("doc_id = 9")).collect() == []
    assert fp.fingerprint(docs).count() == 5


def test_ids_of_most_rows_are_cut_into_runs(spark):
    """Half of the rows have no id, a quarter one id; order is by id, then by the text's hash."""
    rows = [(None if i % 2 else 5 if i % 4 == 0 else 10 + i, f"text {i} " * 3, "", "") for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    dealt = fp.with_next(docs, "doc_id", "text").where("not copied").groupBy("run").count().collect()
    assert max(r["count"] for r in dealt) < 400
    ties = {r.text: r.t for r in docs.selectExpr("text", "xxhash64(text) as t").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    want = sorted(hashlib.sha256(fp.edit(r[1], order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, r in enumerate(order))
    assert sorted(r.edited_sha256 for r in fp.compare_neighbours(docs).collect()) == want


def test_likeness_of_unlike_short_texts():
    assert all(fp.likeness(fp.codes(f"only {i}"), fp.codes(f"other {i}")) < 0.2 for i in range(50))
