import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens long, ids string"
ODD = [
    None,
    "",
    " \t\n\x0b ",
    "don't I'VE we'll <|endoftext|>x<|startoftext|> <|ENDOFTEXT|>",
    "aaaa aaaaa aaaaaaa hahahaha " * 50,
    "e\u0301 \u2003x\x1cy\x85z \u1680 \u3000",
    "\u03a3\u03b1\u03c2 \u039f\u0394\u039f\u03a3 \u0130stanbul \u01c5",
    "\u65e5\u672c\u8a9e \u0661\u0662\u0663 12345 \u00bd",
    "\x00\x01 \u200b\ufeff \U0001f642\U0001f44d\U0001f3fd",
    "x" * 3000,
    "can''t 's's !!! ###$$$ a.b,c;d",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_same_as_library(spark, data, library):
    own = [(10**6 + i, t) for i, t in enumerate(ODD)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + own + own[-2:]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(3)
    found = bpe.encode(docs, PATH, digest=True).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_forgets_and_learns_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(PATH)
    for text in ("one two three four five", "six seven one", "one two"):
        ((ids, decoded),) = codec.encode([text])
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_ids_and_empty(spark, library):
    docs = spark.createDataFrame([(None, "hello world", 1, "")], SCHEMA)
    (row,) = bpe.encode(docs, PATH).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == library.encode("hello world", add_special_tokens=False).ids and row.doc_id is None
    assert bpe.encode(docs.where("doc_id = 3"), PATH).collect() == []


@pytest.mark.parametrize("kind", ["random", "same", "pairs", "accents"])
def test_long_words_same_as_library(library, kind):
    rng = np.random.default_rng(3)
    letters = {"random": "etaoinshrdlu", "same": "a", "pairs": "ab", "accents": "aé日z"}[kind]
    word = "".join(letters[i] for i in rng.integers(0, len(letters), 20_000)) if kind != "pairs" else "ab" * 10_000
    own = bpe.codec(PATH).vocabulary
    texts = [word, "the " + word[:1500] + " end", word[:999]]
    for text in texts:
        words = [w for s in own.stretches(text) for w in own.words(s)]
        ids, sizes = own.encode_words(words)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and len(sizes) == len(words)


def test_a_million_letters(library):
    word = "".join("etaoinshrdlu"[i] for i in np.random.default_rng(5).integers(0, 12, 1_000_000))
    ids, _ = bpe.codec(PATH).vocabulary.encode_words([word.encode()])
    assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
