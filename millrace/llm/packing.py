"""Harmonic packing of token sequences.

The capacity C is divided into reciprocal classes C/1, C/2, ..., C/K and the lengths below C/K.
A document may be cut, so it is cut into pieces that have exactly a class's length: first whole
sequences, then always the longest class that fits what is left (about three pieces). A class
of length L fills each of its sequences with C // L pieces, so the n-th piece of a class is in
its sequence n // (C // L) at offset L * (n % (C // L)): numbering the pieces is all the packing
there is, and workers do it independently. What is left over, less than a sequence in each
class, is packed first-fit in one last step whose size depends on C and K alone.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import gapless, materialise, partitions

# The split pattern of this byte-level vocabulary, and characters on which all
# Unicode versions agree, so that two libraries split them alike.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(r"[\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u20ac]*")
FIELDS = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long"}


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary file.

    tiktoken gives the same ids three times as fast where the merge list is in order of the
    ids; texts with rare scripts or with a special token's string go to tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        ordered = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        plain = (spec.get("normalizer"), (spec.get("pre_tokenizer") or {}).get("type")) == (None, "ByteLevel")
        self.fast = None
        if ordered and plain and not spec["pre_tokenizer"].get("add_prefix_space"):
            import tiktoken

            byte = {c: b for b, c in byte_characters().items()}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.special) and PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def lengths(capacity: int, classes: int) -> list[int]:
    """The lengths a piece can have, ascending."""
    return sorted({capacity // k for k in range(1, classes + 1)} | set(range(1, capacity // classes + 1)))


def cut(n: int, sizes: list[int]) -> list[int]:
    """n as whole sequences, then the longest class each time."""
    found = [sizes[-1]] * (n // sizes[-1])
    n %= sizes[-1]
    while n:
        found.append(sizes[bisect_right(sizes, n) - 1])
        n -= found[-1]
    return found


def pieces(docs: DataFrame, tokenizer: str, capacity: int, classes: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every document, ids as binary on demand."""
    sizes = lengths(capacity, classes)
    kinds = FIELDS | ({"ids": "binary"} if with_ids else {})

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                at = 0
                for n in cut(len(ids), sizes):
                    own = ids[at : at + n].tobytes()
                    rows.append((doc, at, n, zlib.crc32(own), len(ids), own)[: len(kinds)])
                    at += n
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            arrays = [pa.array(c, pa.binary() if k == "binary" else pa.int64()) for c, k in zip(columns, kinds.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def first_fit(rows: pa.Table, capacity: int, first: int) -> pa.Table:
    """Longest pieces first, each into the first sequence with room."""
    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
    rows = rows.sort_by(order)
    room, sequence, offset = [], [], []
    for n in rows.column("length").to_pylist():
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(capacity)
        sequence.append(first + at)
        offset.append(capacity - room[at])
        room[at] -= n
    for name, values in (("sequence_id", sequence), ("offset", offset)):
        rows = rows.append_column(name, pa.array(values, pa.int64()))
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, classes: int = 64, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id``; null and empty texts are ``end_id`` alone.
    Repeated rows are packed as often as they occur; a null id is kept; a text of any length is
    cut into pieces. Pieces of one
    sequence follow each other without a gap from offset 0. An empty table gives no rows;
    other columns are ignored. ``with_ids`` adds each piece's ids (little-endian uint32).
    """
    spark = docs.sparkSession
    made = materialise(pieces(docs, tokenizer, capacity, classes, end_id, id_col, text_col, with_ids), "pieces")
    # At most len(lengths(capacity, classes)) rows.
    totals = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bases, first = [], 0
    for length in sorted(totals, reverse=True):
        each = capacity // length
        full = totals[length] // each
        bases.append((length, each, first, full * each))
        first += full
    base = F.broadcast(spark.createDataFrame(bases, "length long, each long, first long, placed long"))
    numbered = gapless(made, ["length"], ["doc_id", "start", "ids_crc32"], "n", partitions(spark)).join(base, "length")
    placed = numbered.where("n < placed").select(*made.columns, F.expr("first + n div each").alias("sequence_id"), F.expr("(n % each) * length").alias("offset"))
    kinds = ", ".join(f"{n} {k}" for n, k in made.dtypes)
    names = [*made.columns, "sequence_id", "offset"]
    rest = numbered.where("n >= placed").select(*made.columns, F.lit(0).alias("rest")).groupBy("rest").applyInArrow(
        lambda rows: first_fit(rows, capacity, first).select(names), f"{kinds}, sequence_id long, offset long"
    )
    return placed.unionByName(rest)
