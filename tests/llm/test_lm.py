import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from millrace.llm import common, lm, queries

SCHEMA = "doc_id long, text string, block string, n string"


def plain(texts, order, alpha):
    split = [(t or "").lower().split() for t in texts]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    total = [Counter(g for w in split for g in grams(w, n)) for n in range(1, order + 1)]
    words = sum(map(len, split))
    for w in split:
        own = [Counter(grams(w, n)) for n in range(1, order + 1)]
        left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        log_score, lower = 0.0, 0
        for i in range(len(w)):
            weight = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n > 1 and left(g) > 0:
                    value = left(g) / max(left(g[:-1]), left(g))
                    break
                if n == 1:
                    value = max(left(g), 0.5) / max(words - len(w), 1)
                    break
                weight *= alpha
            else:
                raise AssertionError
            # orders that do not fit before the text's start count as unseen
            weight *= alpha ** (order - min(order, i + 1))
            log_score += math.log(weight * value)
            lower += n < order
        yield len(w), log_score, lower


@pytest.mark.parametrize(("order", "block"), [(1, 300), (2, 50), (3, 120), (2, 1 << 22)])
def test_same_as_plain_counts(spark, monkeypatch, order, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    rng = random.Random(order)
    texts = [None, "", "One", "one one one"] + [" ".join(rng.choices("a b c d e f g hh I".split(), k=rng.choice([1, 5, 60]))) for _ in range(40)]
    texts += texts[-2:]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r for r in lm.score(docs, order=order).collect()}
    for i, (size, log_score, lower) in enumerate(plain(texts, order, 0.4)):
        assert (found[i].n_words, found[i].n_backoff) == (size, lower)
        assert math.isclose(found[i].log_score, log_score, rel_tol=1e-9, abs_tol=1e-9)
        assert (found[i].mean_log_score is None) == (size == 0)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registered_order_three(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.QUERIES["op10_lm_scores"](spark, data).collect()}
    # the words as hex, as plain() would also lower and split what is not ASCII
    texts = [" ".join(w.hex() for w in (r.text or "").encode().lower().split()) for r in rows]
    for row, (size, log_score, lower) in zip(rows, plain(texts, 3, 0.4), strict=True):
        assert (found[row.doc_id].n_words, found[row.doc_id].n_backoff) == (size, lower)
        assert math.isclose(found[row.doc_id].log_score, log_score, rel_tol=1e-9, abs_tol=1e-6)


def test_repeated_rows_null_ids_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    texts = ["to be or not to be"] * 30 + [None, "to be " * 20_000]
    docs = spark.createDataFrame([(None if i == 30 else 7 if i < 30 else i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    found = lm.score(docs).collect()
    want = list(plain(texts, 3, 0.4))
    assert sorted((r.doc_id or 0, r.n_words, round(r.log_score, 4), r.n_backoff) for r in found) == sorted((7 if i < 30 else 0 if i == 30 else i, n, round(s, 4) + 0.0, b) for i, (n, s, b) in enumerate(want))


def test_grams_are_counted_part_by_part_and_shuffles_go(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c d e f g hh I".split(), k=30)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 200)
    found = lm.score(docs)
    # words and their counts lie by block: what is left to do moves nothing, in particular no texts
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    want = list(plain(texts, 3, 0.4))
    assert [(r.n_words, round(r.log_score, 6), r.n_backoff) for r in sorted(found.collect())] == [(n, round(s, 6), b) for n, s, b in want]
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name) == "false" and not [t for t in spark.catalog.listTables() if t.name.startswith("lm_")]
    words = sum(len(t.split()) for t in texts)
    parts = [lm._part(*lm._tokens(texts), 1, part)[0] for part in range(lm.PARTS)]
    assert lm.PARTS > 1 and sum(map(len, parts)) == words and not set(parts[0]) & set(parts[1])


def test_rows_of_a_bucket_lie_by_block(spark):
    df = spark.range(3_000).select("id", F.pmod(F.xxhash64("id"), F.lit(40)).alias("block"))
    table = common.bucketed(spark, [df, df], "block", "lm-some")
    # a block is in two files, one for each frame, and in one run there
    files = spark.read.parquet(*table.inputFiles()).mapInPandas(lambda batches: (b.assign(run=(b.block != b.block.shift()).cumsum()).groupby(["block", "run"], as_index=False).id.count() for b in batches), "block long, run long, id long")
    assert table.count() == 6_000 and files.count() == 80
