"""Vantage-point trees over slices of fingerprints: shards, and the rows that meet in them.

Fingerprints are cut into slices of 16 bits and each slice has its own tree: the slice's values
are split again and again at the median Hamming distance from a vantage value. A tree knows
2**16 values at most, whatever the corpus, and is built from a seed alone. Every fingerprint is
stored in its home leaf (a shard) and asks the leaves that triangle bounds leave open, which is
more than one where it lies near a boundary.

On whole fingerprints a tree prunes next to nothing (random fingerprints of 64 bits lie 28 to 36
bits from any vantage point and a radius of 4 overlaps 9 of those distances); on slices the
same bounds keep a fingerprint to a few shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions

SLICES = 4
SLICE_BITS = 64 // SLICES
#: Points of a leaf that a tree's depth aims at, up to 2**14 leaves.
LEAF_ROWS = 16_384
#: Candidate pairs that are compared at once.
PAIRS = 1 << 18


@lru_cache(maxsize=4)
def ball(reach: int) -> np.ndarray:
    """The slice values within ``reach`` bits of zero."""
    values = np.arange(1 << SLICE_BITS, dtype=np.uint32)
    return values[np.bitwise_count(values) <= reach]


class VantageTree:
    """A tree over all values of a slice: which leaf holds a value, which leaves a ball meets."""

    def __init__(self, depth: int, seed: int, bits: int = SLICE_BITS):
        values, rng = np.arange(1 << bits, dtype=np.uint32), np.random.default_rng(seed)
        self.depth, self.vantage, self.median = depth, np.zeros(1 << depth, np.uint32), np.zeros(1 << depth, np.int16)
        node = np.ones(1 << bits, np.int64)
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            edges = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
            for k in range(1 << level):
                own, at = order[edges[k] : edges[k + 1]], (1 << level) + k
                if len(own):
                    self.vantage[at] = values[rng.choice(own)]
                    self.median[at] = np.median(np.bitwise_count(values[own] ^ self.vantage[at]))
            far = np.bitwise_count(values ^ self.vantage[node]).astype(np.int16) > self.median[node]
            node = 2 * node + far
        self.home = (node - (1 << depth)).astype(np.int32)

    def leaves(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by value, leaves: all that may hold a value within ``radius`` of it.

        Triangle bounds prune the branches. As a tree knows all its values, of the leaves that
        the bounds leave open those are dropped that hold none of the ball after all.
        """
        values = np.arange(len(self.home), dtype=np.uint32)
        node = np.ones(len(values), np.int64)
        for _ in range(self.depth):
            away = np.bitwise_count(values ^ self.vantage[node]).astype(np.int16)
            near, far = away - radius <= self.median[node], away + radius > self.median[node]
            values = np.concatenate([values[near], values[far]])
            node = np.concatenate([2 * node[near], 2 * node[far] + 1])
        leaf = (node - (1 << self.depth)).astype(np.int32)
        every = np.arange(len(self.home), dtype=np.int64)[:, None]
        inside = (every << self.depth) | self.home[every ^ ball(radius).astype(np.int64)]
        kept = np.isin((values.astype(np.int64) << self.depth) | leaf, np.unique(inside))
        values, leaf = values[kept], leaf[kept]
        order = np.argsort(values, kind="stable")
        return np.searchsorted(values[order], np.arange(len(self.home) + 1)), leaf[order]


@lru_cache(maxsize=8)
def _trees(depth: int, reach: int, count: int):
    return [(t.home, *t.leaves(reach)) for t in (VantageTree(depth, 1000 + s) for s in range(count))]


def slice_of(prints: list[np.ndarray], s: int) -> np.ndarray:
    """Slice ``s`` of fingerprints that are one or more uint64 words long."""
    shift = np.uint64(s % SLICES * SLICE_BITS)
    return ((prints[s // SLICES] >> shift) & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32)


def between(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) of all positions in each row's range, a block of pairs at a time."""
    some = np.flatnonzero(high > low)
    width = high[some] - low[some]
    cuts = np.searchsorted(np.cumsum(width), np.arange(PAIRS, width.sum() + PAIRS, PAIRS), side="right") if len(some) else []
    for i, j in zip([0, *cuts], [*cuts, len(some)]):
        if j > i:
            n, at = width[i:j], some[i:j]
            yield np.repeat(at, n), np.repeat(low[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def meet_in_shards(points: DataFrame, prints: list[str], reach: int, found: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str, shard_rows: int) -> DataFrame:
    """``found`` of every shard: (slice, stored rows, asking rows) to rows of ``schema``.

    ``prints`` names the columns, longs, that make up the fingerprint. Two points with a slice
    within ``reach`` bits meet in one of its shards in both roles. Shards of over
    ``shard_rows`` points are cut into chunks that meet pairwise, so no task has to hold one.
    """
    spark, slices, columns = points.sparkSession, SLICES * len(prints), points.columns
    depth = int(np.clip(np.ceil(np.log2(max(points.count(), 1) / LEAF_ROWS)), 2, 14))
    kinds = ", ".join(f"{c} {t}" for c, t in points.dtypes)

    def keys(batch):
        own = [batch.column(p).to_numpy(zero_copy_only=False).view(np.uint64) for p in prints]
        for s, (home, offsets, leaf) in enumerate(_trees(depth, reach, slices)):
            yield s, slice_of(own, s), home, offsets, leaf

    def deal(batches):
        for batch in batches:
            for s, key, home, offsets, leaf in keys(batch):
                n = offsets[key + 1] - offsets[key]
                asked = leaf[np.repeat(offsets[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                shard = np.concatenate([home[key], asked]).astype(np.int64) * slices + s
                stored = np.concatenate([np.ones(len(key), bool), np.zeros(len(asked), bool)])
                rows = pa.array(np.concatenate([np.arange(len(key)), np.repeat(np.arange(len(key)), n)]))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(stored), *(c.take(rows) for c in batch.columns)], names=["shard", "stored", *columns])

    def homes(batches):
        for batch in batches:
            for s, key, home, _, _ in keys(batch):
                yield pa.RecordBatch.from_arrays([pa.array(home[key].astype(np.int64) * slices + s)], names=["shard"])

    dealt = points.mapInArrow(deal, f"shard long, stored boolean, {kinds}")
    # A shard's size: at most slices * 2**depth rows, 131,072 by the clip above.
    sizes = points.mapInArrow(homes, "shard long").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("chunks")).where("chunks > 1")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    own = F.array(F.pmod(F.xxhash64(*prints), F.col("chunks")).cast("int"))
    dealt = (
        dealt.join(F.broadcast(sizes), "shard", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("row", F.explode(F.when(F.col("stored"), own).otherwise(every)))
        .withColumn("column", F.explode(F.when(F.col("stored"), every).otherwise(own)))
    )

    def meet(key, rows):
        stored = rows.column("stored")
        return found(key[0].as_py() % slices, rows.filter(stored), rows.filter(pa.compute.invert(stored)))

    # ~the shuffle's partitions: shards number 4 * 2**depth and more
    dealt = dealt.repartition(partitions(spark), "shard", "row", "column")
    return dealt.groupBy("shard", "row", "column").applyInArrow(meet, schema)
