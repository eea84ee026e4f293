"""Document fingerprints: one-permutation MinHash with optimal densification, low bits packed.

Word shingles are hashed once. A hash's leading bits name its bin and each bin keeps its least
hash; an empty bin takes the value of a bin that a fixed sequence of draws reaches first. The
last bits of each bin's value are stored. Two fingerprints agree in a bin with the texts'
Jaccard likeness, or by chance, and the estimate corrects for chance.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from .common import partitions

BIN_BITS, LOW_BITS = 9, 4
BINS = 1 << BIN_BITS
WORDS = 5
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
DRAWS = 64
#: Bytes of text of a run, about.
RUN_BYTES = 64 << 20
ODD = np.random.default_rng(11).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = np.random.default_rng(12).integers(0, 1 << 63, BINS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 1)
        return found


WORD_HASHES = _Words()


@lru_cache(maxsize=64)
def _draws(k: int) -> np.ndarray:
    """Draws k * DRAWS and on of every bin: the bin that each looks at."""
    return np.random.default_rng(100 + k).integers(0, BINS, (BINS, DRAWS))


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of the five-word shingles; fewer words make one shingle, none makes none.

    Words are maximal runs without ASCII white space, A-Z lower-cased.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.array([WORD_HASHES[w] for w in found], np.uint64)
    count = max(1, len(words) - WORDS + 1)
    total = np.full(count, np.uint64(min(len(words), WORDS)))
    for j in range(min(WORDS, len(words))):
        total += words[j : j + count] * ODD[j]
    return _mix(total)


def codes(text: str) -> np.ndarray:
    """A small number for every bin; a text without words has zeros."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return np.zeros(BINS, np.uint8)
    least = np.full(BINS, np.iinfo(np.uint64).max)
    at = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    np.minimum.at(least, at, hashes)
    filled = np.zeros(BINS, bool)
    filled[at] = True
    empty, source, k = np.flatnonzero(~filled), least.copy(), 0
    while len(empty):
        drawn = _draws(k)[empty]
        hit = filled[drawn]
        first, some = hit.argmax(1), hit.any(1)
        source[empty[some]] = least[drawn[some, first[some]]]
        empty, k = empty[~some], k + 1
    return (_mix(source ^ SALT) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)


def packed(code: np.ndarray) -> str:
    return (code[::2] << 4 | code[1::2]).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard likeness that two fingerprints show, chance agreement taken off."""
    chance = 1 / (1 << LOW_BITS)
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def edit(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row: hexadecimal digits, one for each bin's low bits.

    Equal texts have equal fingerprints; null and empty texts share one of zeros.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(codes(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (run, copied, doc_id, text), sorted in each partition so that a row's next follows.

    Ids are cut into runs at approximate quantiles, so many that a run has about RUN_BYTES; an id
    of more rows than a run's is cut along the hash of the text. The first row of a run is also copied to
    the end of the run before it, that of the first run to the last: one row for each run, so
    every text is shuffled once and no task needs another's rows. Order is by id, then by a
    hash of the text; null ids come first.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.col("doc_id").cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    count = max(2 * partitions(docs.sparkSession), math.ceil((size["bytes"] or 0) / RUN_BYTES))
    # Ids of more rows than a run should have, fewer than ``count``: they are cut by the hash.
    hot = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(2, size["n"] / count)).collect()
    cuts = rows.approxQuantile("place", [i / count for i in range(1, count)], 0.2 / count)
    cuts = {*cuts, *(float(h["doc_id"] + d) for h in hot if h["doc_id"] is not None for d in (0, 1))}
    splits = [-float("inf"), *(sorted(cuts) or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="slot", handleInvalid="keep").transform(rows)
    parts = [(h["doc_id"], math.ceil(h["n"] * count / size["n"])) for h in hot]
    # Fewer than ``count`` rows.
    parts = F.broadcast(docs.sparkSession.createDataFrame(parts, "h long, own long"))
    dealt = dealt.join(parts, F.col("doc_id").eqNullSafe(F.col("h")), "left").withColumn("own", F.coalesce("own", F.lit(1)))
    # The hash's range in equal steps, lowest first.
    step = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * F.col("own")), F.col("own") - 1)
    slot = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("slot").cast("long"))
    dealt = dealt.withColumn("run", (slot * F.lit(2 * count) + step).cast("long")).drop("slot", "place", "h", "own")
    # A row a run: a few times ``count``.
    heads = dealt.groupBy("run").agg(F.min(F.struct("doc_id", "tie")).alias("head")).orderBy("run").collect()
    back = [(h["head"]["doc_id"], h["head"]["tie"], heads[i - 1]["run"]) for i, h in enumerate(heads)]
    copies = F.broadcast(docs.sparkSession.createDataFrame(back, "d long, t long, back long"))
    own = F.array(F.struct(F.col("run"), F.lit(False).alias("copied")))
    also = F.array(F.struct(F.col("run"), F.lit(False).alias("copied")), F.struct(F.col("back").alias("run"), F.lit(True).alias("copied")))
    joined = dealt.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    sent = joined.select("doc_id", "text", "tie", F.explode(F.when(F.col("back").isNull(), own).otherwise(also)).alias("to"))
    sent = sent.select(F.col("to.run").alias("run"), F.col("to.copied").alias("copied"), "doc_id", "text", "tie")
    return sent.repartition(count, "run").sortWithinPartitions("run", "copied", "doc_id", "tie").drop("tie")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row for each row. The next text is that of the next higher id,
    after the last the first; equal ids are ordered by their text. A single row is its own
    next. Null texts count as empty, texts of any length are taken whole; an empty table gives
    no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for copied, doc, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                code = codes(text)
                if held is not None:
                    last, before, own = held
                    edited = edit(before, text)
                    new = codes(edited)
                    out.append((last, len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(own), packed(new), likeness(own, new), likeness(own, code)))
                # a copied row ends its run
                held = None if copied else (doc, text, code)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=names)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
