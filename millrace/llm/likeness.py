"""Groups of texts whose shingle sets have a Jaccard likeness, found by wide SimHash fingerprints.

A text's set of shingles has a fingerprint of 192 bits, twelve slices of 16. Sets of likeness
0.8 differ in about 15 % of the bits, so that one of twelve slices almost always differs in one
bit at most: they meet in a shard of that slice's vantage-point tree. Pairs within WIDE bits
there are candidates, and every one of them is tested on the whole sets, so no link is wrong.
Sets that are 0.8 alike are missed in about one case in fifty, at 0.9 in one of thousands; groups
are transitive, so that a text is missed only if all its links are.

Candidates are tested in steps. In the first ROUNDS steps a set is tested with one candidate of
each shard, another each time, which joins a dense group of m by about m tests a step. Then all
candidates of sets not yet in one group are, but for those that parities tell apart where they
meet: a set's members fall into CELLS cells, and a cell that holds an odd number of one set and an
even number of another has a member that only one of them holds. No two sets have more such cells
than members that differ, so that a family of sets too unlike to link makes few rows and no link
is lost. The sets of candidates are sent to a grid of lots by the hashes of both ends, so that a
set goes to one row and one column of lots however many candidates it has; lots have a bounded
number of members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .fingerprints import _mix
from .graph import components
from .vantage import ball, between, meet_in_shards, slice_of

#: Words of a fingerprint, and the differing bits up to which two of them are candidates:
#: nearly 4 deviations above what sets of likeness 0.8 show, 7 below what unlike sets do.
#: ROUNDS: steps before all candidates that are left are tested.
PRINTS, WIDE = 3, 48
ROUNDS = 1
#: Bits by which a slice may differ.
REACH = 1
#: Cells whose parities a set has, in words of 64. They tell sets of up to about 500 members from
#: those a bit too unlike, and larger ones from those that have less in common.
CELLS = 512
PARITIES = [f"s{k}" for k in range(CELLS // 64)]
#: Rows of one slice value that the first step looks at.
FIRST = 64
SHARD_ROWS = 32_768
#: Sets that a task sends at once.
HELD = 500
#: Members that a lot's pairs have, each pair with all of its own; about, and twice that at most
#: but for a pair that has more.
LOT = 1 << 22
#: Bits by which texts are chosen before they are hashed; a power of two.
WANTED = 1 << 22


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle in order; none for a text without words.

    Words are maximal runs without ASCII white space, A-Z lower-cased; fewer words than a
    shingle has: the whole sequence is one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], 42) for i, j in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _arrays(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _set(text: str | None, words: int) -> tuple[int, np.ndarray]:
    """A set's own hash and its members ascending."""
    members = np.unique(shingles(text, words))
    return xxhash.xxh64_intdigest(members.tobytes(), 7), members.view(np.int64)


def fingerprint(members: np.ndarray) -> list[int]:
    """A bit is 1 where it is set in over half of the members' hashes, one word of 64 for each
    of PRINTS mixings; no members: 0."""
    made = []
    for k in range(PRINTS):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(members), 1 << 15):
            own = _mix(members[i : i + (1 << 15)].view(np.uint64) + np.uint64(k)) if k else members[i : i + (1 << 15)].view(np.uint64)
            ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        made.append(int(np.packbits(ones * 2 > max(1, len(members)), bitorder="little").view(np.int64)[0]))
    return made


def parities(members: np.ndarray) -> np.ndarray:
    """A bit for each cell, 1 where an odd number of members falls into it."""
    held = np.bincount(members & (CELLS - 1), minlength=CELLS) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").view(np.int64)


def _rows(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, sid, size, p0, p1, ..., s0, s1, ...) of each text; sid: its set's own hash."""
    names = [*(f"p{k}" for k in range(PRINTS)), *PARITIES]

    def run(batches):
        for batch in batches:
            sid, size, prints = [], [], []
            for text in batch.column(2).to_pylist():
                own, members = _set(text, words)
                sid.append(own)
                size.append(len(members))
                prints.append([*fingerprint(members), *parities(members).tolist()])
            columns = np.array(prints, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(size, pa.int32()), *(pa.array(p) for p in columns)], names=["doc_id", "key", "sid", "size", *names])

    return texts.mapInArrow(run, "doc_id long, key long, sid long, size int, " + ", ".join(f"{n} long" for n in names))


def _candidates(nodes: DataFrame, likeness: float, step: int) -> DataFrame:
    """(a, b, more, weight) sets that are close and not in one group, and how many members both
    have. ``nodes``: sid, label, size, p0, ..., s0, ...

    In the first ROUNDS steps one b for each a and shard, ``more`` where there may be others.
    """
    first = step < ROUNDS
    names = [f"p{k}" for k in range(PRINTS)]
    # All sets go to the shards of the first steps, few to those of the last, with their parities.
    odd = [] if first else PARITIES
    apart = (1 - likeness) / (1 + likeness)

    def close(s, stored, asking, left, right):
        """Which pairs are candidates, each in the first slice that brings it together."""
        (own, node, size, label, cells), (prints, other, width, group, others) = asking, stored
        small, large = np.minimum(size[left], width[right]), np.maximum(size[left], width[right])
        good = (label[left] != group[right]) & (small >= large * (likeness - 1e-9))
        left, right = left[good], right[good]
        away = sum(np.bitwise_count(x[left] ^ y[right]).astype(np.int64) for x, y in zip(own, prints))
        left, right = left[away <= WIDE], right[away <= WIDE]
        if odd:
            differ = sum(np.bitwise_count(x[left] ^ y[right]).astype(np.int64) for x, y in zip(cells, others))
            # Sets of this likeness differ in so many members at most.
            good = differ <= (size[left].astype(np.int64) + width[right]) * apart + 1e-6
            left, right = left[good], right[good]
        new = np.ones(len(left), bool)
        for t in range(s):
            new &= np.bitwise_count(slice_of([x[left] for x in own], t) ^ slice_of([x[right] for x in prints], t)) > REACH
        return left[new], right[new]

    def arrays(rows):
        column = lambda c: rows.column(c).to_numpy()
        return [column(n).view(np.uint64) for n in names], column("sid"), column("size"), column("label"), [column(n).view(np.uint64) for n in odd]

    def found(s, stored, asking):
        held, asks = arrays(stored), arrays(asking)
        key, want = slice_of(held[0], s).astype(np.int64), slice_of(asks[0], s).astype(np.int64)
        # Rows of one slice value lie together, and in them the rows of one group.
        groups_, group = np.unique(held[3], return_inverse=True)
        priority = _mix(held[1].view(np.uint64) + np.uint64(77 + step))
        order = np.lexsort((priority, key) if first else (group, key))
        held = [x[order] for x in held[0]], *(x[order] for x in held[1:4]), [x[order] for x in held[4]]
        key, both = key[order], (key * len(groups_) + group)[order]
        place = np.minimum(np.searchsorted(groups_, asks[3]), max(0, len(groups_) - 1))
        best = np.full(len(want), np.iinfo(np.uint64).max)
        partner, more, pairs = np.full(len(want), -1), np.zeros(len(want), bool), []
        priority = priority[order]
        for mask in ball(REACH).astype(np.int64):
            low, high = np.searchsorted(key, want ^ mask), np.searchsorted(key, want ^ mask, side="right")
            if first:
                more |= high - low > FIRST
                ranges = [(low, np.minimum(high, low + FIRST))]
            else:
                own = (want ^ mask) * len(groups_) + place
                mine = np.searchsorted(both, own), np.searchsorted(both, own, side="right")
                mine = np.clip(mine, low, high)
                ranges = [(low, mine[0]), (mine[1], high)]
            for range_ in ranges:
                for row, at in between(*range_):
                    left, right = close(s, held, asks, row, at)
                    if first:
                        many = np.bincount(left, minlength=len(want))
                        more |= (many > 1) | ((many > 0) & (partner >= 0))
                        np.minimum.at(best, left, priority[right])
                        won = priority[right] == best[left]
                        partner[left[won]] = right[won]
                    else:
                        ahead = asks[1][left] < held[1][right]
                        left, right = left[ahead], right[ahead]
                        pairs.append((asks[1][left], held[1][right], asks[2][left].astype(np.int64) + held[2][right]))
        if first:
            some = (partner >= 0) | more
            chosen = partner[some]
            b = np.where(chosen >= 0, held[1][chosen] if len(key) else 0, asks[1][some])
            weight = asks[2][some].astype(np.int64) + (held[2][chosen] if len(key) else 0)
            return pa.table({"a": pa.array(asks[1][some]), "b": pa.array(b), "more": pa.array(more[some]), "weight": pa.array(weight)})
        a, b, weight = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": pa.array(a), "b": pa.array(b), "more": pa.array(np.zeros(len(a), bool)), "weight": pa.array(weight)})

    return meet_in_shards(nodes.select("sid", "label", "size", *names, *odd), names, REACH, found, "a long, b long, more boolean, weight long", SHARD_ROWS)


def _shared(pairs: pa.Table, sets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, members in both, members in either) of all pairs."""
    sets = sets.combine_chunks()
    if not sets.num_rows:
        return (np.zeros(0, np.int64),) * 4
    sid, lists = sets.column("sid").to_numpy(), sets.column("members").chunk(0)
    edges = lists.offsets.to_numpy()
    names, code = np.unique(lists.values.to_numpy(), return_inverse=True)
    by_sid = np.argsort(sid)
    a, b = (pairs.column(c).to_numpy() for c in "ab")
    left, right = (by_sid[np.searchsorted(sid, x, sorter=by_sid)] for x in (a, b))
    order = np.argsort(left, kind="stable")
    a, b, left, right = a[order], b[order], left[order], right[order]
    shared, held = np.zeros(len(a), np.int64), np.zeros(len(names), bool)
    cuts = np.flatnonzero(np.diff(left)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
        own = code[edges[left[i]] : edges[left[i] + 1]]
        held[own] = True
        for row, at in between(edges[right[i:j]], edges[right[i:j] + 1]):
            shared[i:j] += np.bincount(row, held[code[at]], j - i).astype(np.int64)
        held[own] = False
    sizes = np.diff(edges).astype(np.int64)
    return a, b, shared, sizes[left] + sizes[right] - shared


def _alike(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, likeness: float) -> DataFrame:
    """Those of the pairs (a, b) of sets whose Jaccard likeness is ``likeness`` or more."""
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a != b").distinct(), "likeness-pairs")
    asked = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b")).distinct()
    asked = materialise(asked.join(nodes.select("sid", "key"), "sid"), "likeness-asked")
    # The bits keep texts that nobody asks for from being hashed; Spark sets them, in words of 64.
    place = F.col("key").bitwiseAND(F.lit(WANTED - 1))
    words_of_bits = asked.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits"))
    bits = np.zeros(WANTED // 64, np.int64)
    for at, own in words_of_bits.collect():
        bits[at] = own
    wanted = bits.astype("<i8").tobytes()

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) & (WANTED - 1)
            some = np.flatnonzero(np.frombuffer(wanted, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for i in range(0, len(some), HELD):
                own = batch.take(pa.array(some[i : i + HELD]))
                yield pa.RecordBatch.from_arrays([own.column(0), _arrays([_set(t, words)[1] for t in own.column(1).to_pylist()])], names=["key", "members"])

    sets = texts.select("key", "text").mapInArrow(run, "key long, members array<long>").join(asked, "key")
    sets = materialise(sets.groupBy("sid").agg(F.first("members").alias("members")), "likeness-sets")
    side = max(1, math.ceil(math.sqrt((pairs.agg(F.sum("weight")).first()[0] or 0) / LOT)))
    cells = pairs.select("a", "b", "weight", *(F.pmod(F.xxhash64(x), F.lit(side)).alias(y) for x, y in ("ai", "bj")))
    # A cell of one set's many pairs is cut by the pairs.
    sizes = cells.groupBy("i", "j").agg(F.ceil(F.sum("weight") / (2 * LOT)).alias("cuts"))
    lots = cells.join(sizes, ["i", "j"]).withColumn("cut", F.pmod(F.xxhash64("a", "b"), "cuts"))
    lots = materialise(lots.select("i", "j", "cut", "a", "b"), "likeness-lots")
    lot = [F.col(c).alias(f"of_{c}") for c in ("i", "j", "cut")]
    ends = lots.select(*lot, F.col("a").alias("sid")).unionAll(lots.select(*lot, "b")).distinct()

    def test(key, pairs, sets):
        a, b, shared, either = _shared(pairs, sets)
        good = shared >= likeness * either
        return pa.table({"a": pa.array(a[good]), "b": pa.array(b[good])})

    sent = ends.join(sets, "sid").groupBy("of_i", "of_j", "of_cut")
    tested = lots.groupBy("i", "j", "cut").cogroup(sent).applyInArrow(test, "a long, b long")
    return materialise(tested, "likeness-links")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, likeness: float = 0.8) -> DataFrame:
    """(doc_id, component_id), one row for each row of ``docs``.

    Two texts link if the Jaccard likeness of their sets of shingles is ``likeness`` or more and
    their fingerprints bring them together; component_id is the smallest doc_id reachable over
    links. Texts without words are alike. Rows with a null id pass links on but name no
    component. Sets and shingles are told apart by 64-bit hashes. Below a ``likeness`` of 0.8
    more and more links are missed.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    rows = materialise(_rows(texts, words), "likeness-rows")
    names = [f"p{k}" for k in range(PRINTS)]
    nodes = rows.groupBy("sid").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("size", *names, *PARITIES)))
    nodes = materialise(nodes.where("size > 0"), "likeness-nodes")
    rest, links = nodes.withColumn("label", F.col("sid")), None
    for step in range(ROUNDS + 1):
        near = materialise(_candidates(rest, likeness, step), "likeness-near")
        new = _alike(near, nodes, texts, words, likeness)
        links = new if links is None else links.unionAll(new)
        roots = materialise(components(links, "likeness-links"), "likeness-roots")
        # Sets that had one candidate in each shard have nothing left to test.
        open_ = near.where("more").select(F.col("a").alias("sid")).distinct()
        rest = nodes.join(open_, "sid").join(roots, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "sid"))
        rest = materialise(rest.select("sid", "label", "size", *names, *PARITIES), "likeness-rest")
        if rest.isEmpty():
            break
    named = rows.select("doc_id", "sid").join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", F.coalesce("root", "sid").alias("root"))
    named = materialise(named, "likeness-named")
    # Written, so that the join back is between plain shuffles and a large group can be split.
    least = materialise(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "likeness-components")
    return named.join(least, "root").select("doc_id", "component_id")
