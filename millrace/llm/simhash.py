"""SimHash near-duplicates, linked through vantage-point trees.

A fingerprint of 64 bits is cut into four slices. Fingerprints within ``radius`` bits have a
slice within ``radius // 4`` bits, so they meet in a shard of that slice's tree (``vantage``).
Inside a shard, candidates are compared on all 64 bits. Links found are exact; none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, materialise
from .graph import components
from .likeness import groups, shingles
from .vantage import SLICE_BITS, SLICES, ball, between, meet_in_shards, slice_of

#: Rows of a shard that one task holds; larger shards are cut into chunks that meet pairwise.
SHARD_ROWS = 32_768
#: Rows with one value of a slice beyond which a second slice is searched as well.
DENSE = 256


def simhash(text: str | None, words: int) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42); no word: 0.

    Words are maximal runs without ASCII white space, A-Z lower-cased; fewer words than a
    shingle has: the whole sequence is one shingle.
    """
    hashes = shingles(text, words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        block = hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed long."""

    def run(batches):
        for batch in batches:
            made = np.fromiter((simhash(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that join what the pairs (a, b) join."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _pairs(stored: np.ndarray, asking: np.ndarray, s: int, radius: int):
    """Pairs within ``radius`` bits whose slices ``s`` are within radius // SLICES, a block at a time.

    Where many rows have one value of the slice, a second slice is looked up with it: of the
    other three one is within radius // 3 bits, so no pair is lost and the rows compared do not
    grow with the shard.
    """
    first, own = slice_of([stored], s).astype(np.uint64), slice_of([asking], s).astype(np.uint64)
    dense = len(stored) > DENSE * len(np.unique(first))
    for t in [t for t in range(SLICES) if t != s] if dense else [s]:
        key, want = first, own
        if dense:
            key, want = ((x << np.uint64(SLICE_BITS)) | slice_of([y], t) for x, y in ((first, stored), (own, asking)))
        order = np.argsort(key, kind="stable")
        key, held = key[order], stored[order]
        seconds = ball(radius // (SLICES - 1)) if dense else ball(0)
        for mask in ball(radius // SLICES).astype(np.uint64):
            for second in seconds.astype(np.uint64):
                wanted = want ^ ((mask << np.uint64(SLICE_BITS)) | second if dense else mask)
                for row, at in between(np.searchsorted(key, wanted), np.searchsorted(key, wanted, side="right")):
                    left, right = asking[row], held[at]
                    close = (np.bitwise_count(left ^ right) <= radius) & (left != right)
                    if close.any():
                        yield left[close], right[close]


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``prints`` has distinct long ``fp``; returns (a, b) that connect all within ``radius`` bits.

    Each shard returns a forest of its links, so a dense group of m fingerprints gives fewer
    than m rows a shard, not m * m.
    """

    def found(s, stored, asking):
        a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for x, y in _pairs(*(rows.column("fp").to_numpy().view(np.uint64) for rows in (stored, asking)), s, radius):
            a, b = _forest(np.concatenate([a, x]), np.concatenate([b, y]))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return meet_in_shards(prints.select("fp"), ["fp"], radius // SLICES, found, "a long, b long", SHARD_ROWS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Two fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest
    doc_id reachable. Null and empty texts share fingerprint zero and link like any other.
    Rows with a null id are fingerprinted; they pass links on but name no component.
    Texts of any length are fingerprinted whole. Repeated rows come back repeated; an empty table
    gives none. Other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    heads = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(heads.select("fp"), radius), "simhash-links")
    roots = heads.join(found, heads.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = materialise(roots, "simhash-roots")
    # Written, so that the join back is between plain shuffles and a large component can be split.
    least = materialise(roots.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-components")
    named = roots.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, likeness: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group of texts of that likeness.

    Texts of equal id and equal text are one document and leave one row. Rows without an id
    cannot be told apart and stay. Texts of any length are compared whole, those without words
    are alike. All columns are kept; an empty table stays empty.
    """
    found = groups(docs, id_col, text_col, words, likeness)
    own, again = fresh(docs, "first"), fresh(docs, "again")
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    first = materialise(first.select(F.col("doc_id").alias(own), (F.col("rows") > 1).alias(again)), "simhash-first")
    # A merge join at every size, so that what a run shuffles grows as its input does.
    kept = docs.join(first.hint("merge"), docs[id_col].cast("long") == F.col(own), "left").where(F.col(own).isNotNull() | docs[id_col].isNull())
    if first.where(F.col(again)).isEmpty():
        return kept.select(*docs.columns)
    several = F.coalesce(again, F.lit(False))
    once = kept.where(several).dropDuplicates([id_col])
    return kept.where(~several).select(*docs.columns).unionByName(once.select(*docs.columns))
