import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length long, sequence_id string"


@given(st.integers(1, 10**5))
def test_cut_adds_up(n):
    sizes = packing.lengths(2048, 64)
    parts = packing.cut(n, sizes)
    assert sum(parts) == n and set(parts) <= set(sizes)


def test_pieces_cover_and_sequences_are_gapless(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "a", "<|endoftext|> b", "\u65e5\u672c \u0661\x1c \U0001f642", "x y " * 9000] + ["word " * int(n) for n in rng.integers(1, 3000, 80)]
    texts += ["same text again"] * 700
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)] + [(5, texts[5], 0, ""), (None, "no id", 0, "")], SCHEMA)
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in [*enumerate(texts), (None, "no id")]}
    seen, sequences = {}, {}
    for r in rows:
        own = want[r.doc_id]
        assert bytes(r.ids) == own[r.start : r.start + r.length].tobytes()
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(own)
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, own in want.items():
        times = 2 if doc == 5 else 1
        at = np.zeros(len(own), int)
        for start, length in seen[doc]:
            at[start : start + length] += 1
        assert (at == times).all()
    totals = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        totals.append(at)
    waste = sum(2048 - t for t in totals if t & (t - 1))
    assert waste <= 2048 + 0.01 * sum(totals)
    assert packing.pack(docs.where("doc_id = 12345"), PATH).collect() == []


@pytest.mark.parametrize(("capacity", "classes"), [(64, 8), (100, 7)])
def test_other_capacities(spark, capacity, classes):
    docs = spark.createDataFrame([(i, "w " * i, 0, "") for i in range(150)], SCHEMA)
    totals = {}
    for r in packing.pack(docs, PATH, capacity=capacity, classes=classes).collect():
        totals[r.sequence_id] = totals.get(r.sequence_id, 0) + r.length
    assert max(totals.values()) <= capacity and sum(totals.values()) >= 150 * 75
