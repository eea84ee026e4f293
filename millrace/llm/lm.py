"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

Documents are hashed word by word and dealt to blocks of bounded size, in a table bucketed by
block. N-grams are counted a part of their hashes at a time: a block's n-grams of the part are
exploded to rows (gram, block, times), one for each distinct n-gram of the block; the count
table, partitioned by hash, sums them by gram and gives each exploded row its total; what a
block's n-grams count in the corpus is joined to the block's words, and each word's count is kept,
in a table bucketed alike. The shuffles of a part are gone before the next one's. At the end
counts of all parts are joined to the words and scores summed by document. An n-gram has one row a
block, so the rows of the most frequent one are as many as there are blocks. N-grams that occur
in one block only need no answer: the block knows their count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bucketed
from .fingerprints import WORD_HASHES, _mix

ODD = np.random.default_rng(21).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Text that a block of documents has, about; the number of blocks follows from the corpus.
BLOCK_BYTES = 8 << 20
#: Parts of the n-grams that are counted one after the other, so that disk holds one's shuffle.
PARTS = 6


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the number of each word's text."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((WORD_HASHES[w] for own in split for w in own), np.uint64, int(sizes.sum()))
    return words, np.repeat(np.arange(len(texts)), sizes)


def _grams(words: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams and the position of each one's last word."""
    if len(words) < order:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - order + 1
    total = np.full(n, np.uint64(order))
    for j in range(order):
        total += words[j : j + n] * ODD[j]
    same = doc[:n] == doc[order - 1 :]
    return _mix(total[same]), np.flatnonzero(same) + order - 1


def _part(words: np.ndarray, doc: np.ndarray, order: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``_grams`` that belong to a part."""
    grams, at = _grams(words, doc, order)
    mine = np.flatnonzero(grams % np.uint64(PARTS) == np.uint64(part))
    return grams[mine], at[mine]


def _others(words: np.ndarray, doc: np.ndarray, order: int, part: int, gram: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often each n-gram of a part occurs in other documents, in the order of the words.

    ``gram``, sorted, and ``total``: n-grams that other blocks have too, and their corpus counts.
    """
    grams, at = _part(words, doc, order, part)
    distinct, inside, times = np.unique(grams, return_inverse=True, return_counts=True)
    if len(gram):
        found = np.minimum(np.searchsorted(gram, distinct), len(gram) - 1)
        times = np.where(gram[found] == distinct, total[found], times)
    _, back, own = np.unique(doc[at] * max(1, len(distinct)) + inside, return_inverse=True, return_counts=True)
    return times[inside] - own[back]


def stupid_backoff(alpha: float, doc: np.ndarray, counts: list[np.ndarray], total_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Log score and order used, for each word.

    ``counts``: for each order how often the n-gram that ends at a word occurs in other
    documents. A word that occurs in no other document counts as half an occurrence.
    """
    own_words = np.bincount(doc, minlength=int(doc.max(initial=-1)) + 1)
    others = np.maximum(total_words - own_words[doc], 1).astype(float) if len(doc) else np.zeros(0)
    score, used = np.log(np.maximum(counts[0], 0.5) / others), np.ones(len(doc), np.int64)
    for n in range(2, len(counts) + 1):
        seen = counts[n - 1] > 0
        context = np.r_[0, counts[n - 2][:-1]]
        score = np.where(seen, np.log(np.where(seen, counts[n - 1], 1) / np.where(seen, np.maximum(context, counts[n - 1]), 1)), score + np.log(alpha))
        used[seen] = n
    return score, used


def _hashed(batches):
    """Word hashes in place of texts."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            few = batch.slice(i, 500)
            words, doc = _tokens(few.column(3).to_pylist())
            ends = np.cumsum(np.bincount(doc, minlength=few.num_rows))
            held = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*few.columns[:3], held], names=["doc_id", "number", "block", "words"])


def _words(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows, and the number of each word's row."""
    held = rows.column("words")
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return held.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_backoff) of every row.

    Each word scores count(n-gram) / count(its context) in the rest of the corpus, all other
    rows; where that is unseen, ``alpha`` times the score one order lower, down to the word's
    share of all words. log_score sums the logarithms, mean_log_score divides by n_words and is
    null where there are none, n_backoff counts words scored below the highest order. Words
    are maximal runs without ASCII white space, A-Z lower-cased. Null texts count as empty;
    copies of a text are other rows and count. Null ids and repeated rows stay; a text of any
    length is scored whole. N-grams are told apart by 64-bit hashes.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("number"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Dealt by number, so that repeated rows part, and written, so that each keeps its block.
    block = F.pmod(F.xxhash64("number"), F.lit(size // BLOCK_BYTES + 1))
    dealt = rows.select("doc_id", "number", block.alias("block"), "text").mapInArrow(_hashed, "doc_id long, number long, block long, words array<long>")
    rows = bucketed(spark, [dealt], "block", "lm-words")
    total_words = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    orders = range(1, order + 1)

    def part_counts(part: int) -> DataFrame:
        def explode(batches):
            """The batches of a file lie by block; a block cut between batches gives two sets of rows."""
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                for i, j in zip(edges[:-1], edges[1:]):
                    words, doc = _words(batch.slice(i, j - i))
                    for n in orders:
                        grams, times = np.unique(_part(words, doc, n, part)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), own[i])), pa.array(times)], names=["gram", "block", "times"])

        def join(key, own, answers):
            words, doc = _words(own.sort_by("number"))
            gram = answers.column("gram").to_numpy().view(np.uint64)
            by_gram = np.argsort(gram)
            gram, total = gram[by_gram], answers.column("total").to_numpy()[by_gram]
            found = [pa.array([_others(words, doc, n, part, gram, total)], pa.list_(pa.int64())) for n in orders]
            return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([part], pa.int64()), *found], names=names)

        exploded = rows.select("block", "words").mapInArrow(explode, "gram long, block long, times long")
        # One shuffle by hash for the count table and its join; a gram has a row for each block.
        counted = exploded.withColumn("total", F.sum("times").over(Window.partitionBy("gram")))
        answers = counted.where("total > times").select("block", "gram", "total")
        return rows.select("block", "number", "words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))

    names = ["block", "part", *(f"others_{n}" for n in orders)]
    kinds = ["long", "long", *("array<long>" for _ in orders)]
    counts = bucketed(spark, map(part_counts, range(PARTS)), "block", "lm-counts")

    def scores(key, own, parts):
        own = own.sort_by("number")
        words, doc = _words(own)
        others = [np.zeros(len(words), np.int64) for _ in orders]
        for i, part in enumerate(parts.column("part").to_pylist()):
            for n in orders:
                others[n - 1][_part(words, doc, n, part)[1]] = parts.column(f"others_{n}")[i].values.to_numpy()
        log_score, used = stupid_backoff(alpha, doc, others, total_words)
        rows = own.num_rows
        size, summed = np.bincount(doc, minlength=rows), np.bincount(doc, log_score, rows).astype(float)
        lower = np.bincount(doc, used < order, rows)
        mean = pa.array(np.where(size > 0, summed / np.maximum(size, 1), 0), mask=size == 0)
        return pa.table({"doc_id": own.column("doc_id"), "n_words": pa.array(size), "log_score": pa.array(summed), "mean_log_score": mean, "n_backoff": pa.array(lower.astype(np.int64))})

    schema = "doc_id long, n_words long, log_score double, mean_log_score double, n_backoff long"
    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(scores, schema)
