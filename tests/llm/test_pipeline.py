import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from millrace.llm import quality, repeats, simhash
from millrace.llm.packing import Encoder

from .test_likeness import expected
from .test_repeats import plain_words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, keep_lang string"


@pytest.fixture(scope="module")
def steps(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, (docs := stage(spark, docs, data).cache())))
    return out


def test_stages_keep_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "packing"]
    for before, after in steps[:3]:
        assert after.dtypes == before.dtypes
    assert steps[1][1].count() < steps[0][1].count() < steps[0][0].count()


def test_quality_stage(spark, data, steps):
    docs, kept = steps[0]
    found = quality.classify(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.collect() if r.predicted == 1}


def test_near_duplicate_stage(steps):
    docs, kept = steps[1]
    rows = docs.collect()
    links, label = expected([r.text for r in rows], 5, 0.8)
    left = {r.doc_id for r in kept.collect()}
    group = {}
    for r, k in zip(rows, label):
        group.setdefault(k, []).append(r.doc_id)
    # one of each brute-force group stays, its smallest; a link that is missed would leave one more
    assert {min(ids) for ids in group.values()} <= left
    assert len(left) - len(group) <= 0.03 * len(links)


def test_repeat_stage(steps):
    docs, kept = steps[2]
    rows = docs.collect()
    left = {r.doc_id: r for r in kept.collect()}
    assert left.keys() == {r.doc_id for r in rows}
    for r, (words, _) in zip(rows, plain_words([r.text for r in rows], 50)):
        after = left[r.doc_id]
        assert after.n_chars == len(after.text)
        assert after.text.split() == words


def test_packing_stage(steps):
    docs, packed = steps[3]
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*encode(r.text or ""), 1], "<u4") for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in packed.collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for name, parts in [*((len(ids[d]), p) for d, p in pieces.items()), *((None, p) for p in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == name if name is not None else at <= 2048
    assert pieces.keys() == ids.keys()
    assert sorted(sequences) == list(range(len(sequences)))


def test_columns_of_clashing_names(spark, data):
    names = ["kept", "n_bytes", "n_removed", "n_spans", "first", "again", "fp", "root", "node", "d", "k", "spans", "text_key", "score", "quality", "length", "sequence_id"]
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60).selectExpr("*", *(f"'{n}' as {n}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, data)
        assert docs.columns[-len(names) :] == names
    row = docs.first()
    assert all(row[n] == n for n in names)
    assert corpus_pipeline.STAGES[3][1](spark, docs, data).count() > 0


def test_odd_documents(spark):
    long = "".join(map(chr, np.random.default_rng(1).integers(200, 300, 600)))
    rows = [(None, "a", None, None, None, "k"), (1, None, "en", "s", 3, "k"), (2, "", "en", "s", 0, "k"), (3, long, "", "", 600, "k"), (3, long, "", "", 600, "k"), (4, "x" + long[100:], "", "", 501, "k")]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert sorted((r.doc_id or 0) for r in simhash.keep_first(docs).collect()) == [0, 1, 3, 4]
    left = {r.doc_id: r for r in repeats.without_repeats(docs.where("doc_id is null or doc_id != 3 or text is null").unionByName(docs.where("doc_id = 3").limit(1))).collect()}
    assert (left[3].text, left[4].text, left[1].text, left[4].keep_lang) == (long[:100], "x", "", "k")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.where("doc_id = 99"), "").collect() == []
