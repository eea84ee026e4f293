"""Removal of long repeated passages by merging Burrows-Wheeler transforms.

A text is a sequence of symbols: its UTF-8 bytes, or the hashes of its words.

Each window of ``length`` symbols belongs to one anchor, the least hash among the grams inside
it, so equal windows have equal anchors at equal offsets and only windows of one anchor need
comparing. Neighbouring windows with one anchor form a string (a stretch of text); equal
strings are counted once with their number, and an anchor with one string is done. The others
are grouped by anchor, which routes them and decides nothing: the strings of a group are dealt
to shards, each shard has its Burrows-Wheeler transform over letters (eight bytes or one word,
compared by value), and the transforms are merged by refining their interleave. A round sorts
by one letter more, reading the transforms alone; where neighbours first part is the length of
their common prefix. Intervals whose common prefixes reach ``length`` and that hold two
occurrences are the repeats.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, partitions
from .fingerprints import WORD_HASHES

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Bytes of a symbol: a byte itself, or the hash of a word.
BYTE, WORDS = 1, 8
#: Symbols that are hashed at once; longer texts are read in overlapping pieces.
PIECE = 1 << 20
SHARDS = 4
#: Suffixes that are merged at once where groups are small: their letters fit 16 bits.
SUFFIXES = 60_000
#: Rounds of a merge after which closed blocks are left out.
CLOSING = 8
#: Strings of a group that one task merges; larger groups are dealt anew by longer grams.
GROUP_STRINGS = 1_000


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def symbols(text: bytes, width: int) -> np.ndarray:
    """What a text consists of: uint8 bytes, or a uint64 hash of each word."""
    if width == BYTE:
        return np.frombuffer(text, np.uint8)
    return np.array([WORD_HASHES[w] for w in text.split()], np.uint64)


def _held(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if width == BYTE else np.uint64)


class Hashes:
    """Hashes of any substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(3 * max(1, PIECE // data.itemsize))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((TABLE[data] if data.dtype == np.uint8 else _mix(data)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start, n) -> np.ndarray:
        return _mix((self.sums[start + n] - self.sums[start]) * self.down[start])

    def every(self, n: int) -> np.ndarray:
        """Those of all substrings of ``n`` symbols."""
        h = self.sums[n:] - self.sums[:-n]
        h *= self.down[: len(h)]
        return _mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def stretches(data: np.ndarray, owner: np.ndarray, length: int, gram: int):
    """(start, windows, anchor hash, string hash) arrays of all windows in ``data``.

    ``owner`` numbers the text of each byte; windows that would cross texts are left out.
    """
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(data)
    grams = hashes.every(gram)
    mask = np.uint64((1 << 24) - 1)
    placed = grams & ~mask
    placed |= np.arange(len(grams), dtype=np.uint64)
    least = _least(placed, length - gram + 1)
    anchor = (least & mask).astype(np.int64)
    inside = owner[: len(anchor)] == owner[length - 1 :]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1 : len(anchor)] != owner[: len(anchor) - 1]) | (inside[1:] != inside[:-1])]
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(anchor)])
    start, count = start[inside[start]], count[inside[start]]
    at = anchor[start]
    whole = hashes.of(start, count + length - 1)
    string = _mix(whole + _mix((at - start).astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64)))
    return start, count, grams[at], string


def _suffix_order(letter: np.ndarray, following: np.ndarray) -> np.ndarray:
    """A shard's suffixes in order, four ranks a step where they fit a key, or by doubling.

    letter 0 ends a string; following: the next suffix. Equal suffixes are in the order of their
    strings' ends.
    """
    rank, ahead, kinds = letter.astype(np.int64), following, -1
    while True:
        key, further, base = rank, ahead, int(rank.max(initial=0)) + 1
        for _ in range(3 if base**4 < 1 << 63 else 1):
            key, further = key * base + rank[further], ahead[further]
        names, rank = np.unique(key, return_inverse=True)
        ahead = further
        if len(names) in (kinds, len(letter)):
            break
        kinds = len(names)
    while (ahead != ahead[ahead]).any():
        ahead = ahead[ahead]
    return np.lexsort((ahead, rank))


def _letters(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Numbers from 1 for the ``n`` symbols from each place on, in the order of their values."""
    if data.dtype == np.uint64 and n == 1:
        value = data[at]
    elif n <= 8 and data.dtype == np.uint8:
        value = np.zeros(len(at), np.uint64)
        for j in range(n):
            value = value << np.uint64(8) | data[at + j]
    else:
        rows = np.lib.stride_tricks.sliding_window_view(data, n)[at] if len(at) else np.zeros((0, n), data.dtype)
        value = np.ascontiguousarray(rows).view(np.dtype((np.void, n * data.itemsize))).ravel()
    return np.unique(value, return_inverse=True)[1] + 1


def merged_prefixes(letter: np.ndarray, before: np.ndarray, following: np.ndarray, edges: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """All shards' suffixes in order of their first ``rounds`` letters, and common prefixes.

    A shard is the suffixes between two ``edges``; ``before`` is the letter before each one.
    The second array has, for each suffix, how many letters it shares with the one in front of
    it, ``rounds`` at most. Each round reads the shards' transforms in the order found so far:
    a suffix goes where the one after its first letter lies, which the transform's stable order
    tells. Blocks are suffixes equal so far. One that can't part any more is closed and left out.
    """
    order = [low + _suffix_order(letter[low:high], following[low:high] - low) for low, high in zip(edges[:-1], edges[1:])]
    suffix = np.concatenate(order)
    transform, size = before[suffix], len(suffix)
    after = np.concatenate([low + np.argsort(transform[low:high], kind="stable") for low, high in zip(edges[:-1], edges[1:])])
    # The first round: by letter, ties by shard and place there.
    first = letter[suffix]
    interleave = np.argsort(first, kind="stable")
    part = np.r_[True, np.diff(first[interleave].astype(np.int64)) != 0] if size else np.zeros(0, bool)
    shared = np.where(part, 0, rounds)
    starts = np.flatnonzero(part)
    block = np.empty(size, np.int64)
    block[interleave] = np.repeat(starts, np.diff(np.r_[starts, size]))
    closed = part & np.r_[part[1:], True] if size else part
    closed[: np.count_nonzero(first == 0)] = True  # empty suffixes are equal
    places = np.flatnonzero(~closed[block[interleave]])
    moved = interleave[places]
    own, following = block[moved], after[moved]
    for n in range(1, rounds):
        ahead = block[following]
        parts = own[1:][(ahead[1:] != ahead[:-1]) & (own[1:] == own[:-1])]
        if not len(parts):
            break
        parts = parts[np.r_[True, parts[1:] != parts[:-1]]]
        low = np.searchsorted(own, parts)
        counts = np.searchsorted(own, parts, side="right") - low
        inside = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
        key = own[inside] * size + ahead[inside]
        turned = np.argsort(key, kind="stable")
        key, taken = key[turned], inside[turned]
        moved[inside], following[inside], ahead[inside] = moved[taken], following[taken], ahead[taken]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        starts = places[inside[at]]
        shared[starts[shared[starts] == rounds]] = n
        own[inside] = np.repeat(starts, np.diff(at, append=len(key)))
        block[moved[inside]] = own[inside]
        if n % CLOSING == 0:
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            counts = np.diff(at, append=len(own))
            over = (counts == 1) | closed[ahead[at]]
            closed[places[at]] = over
            interleave[places] = moved
            left = np.flatnonzero(np.repeat(~over, counts))
            places, moved, own, following = places[left], moved[left], own[left], following[left]
    interleave[places] = moved
    return suffix[interleave], shared


def repeated_windows(strings: list[np.ndarray], weights: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of windows that occur twice or more; a string counts ``weights`` times."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.concatenate(strings)
    # Every string is ``stride`` interleaved strings of letters, one for each offset they start
    # from; each has its suffixes and one empty suffix: one suffix for each symbol and one.
    string = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    begin = np.arange(len(string)) - string
    full = offset + stride <= sizes[string]
    letter = np.zeros(len(string), np.int64)
    letter[full] = _letters(data, begin[full], stride)
    # the letter before a suffix; 0 where the suffix is a whole string of letters
    before = np.where(offset >= stride, letter[np.maximum(np.arange(len(string)) - stride, 0)], 0)
    following = np.where(full, np.minimum(np.arange(len(string)) + stride, len(string) - 1), np.arange(len(string)))
    kind = np.uint16 if letter.max(initial=0) < 65_535 else np.int64
    edges = np.searchsorted(string, np.linspace(0, len(strings), min(SHARDS, len(strings)) + 1).astype(np.int64))
    place, shared = merged_prefixes(letter.astype(kind), before.astype(kind), following, edges, length // stride)
    interval = np.cumsum(shared * stride < length)
    window = offset[place] + length <= sizes[string[place]]
    place, interval = place[window], interval[window]
    found = place[np.bincount(interval, weights[string[place]])[interval] >= 2] if len(place) else place
    return string[found], offset[found]


def _windows(docs: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """(doc_id, text_key, windows, anchor, string, starts) of the stretches of each text: a row
    for all places where the text has the same string, as periodic texts have many."""
    schema = "doc_id long, text_key long, windows int, anchor long, string long, starts array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    piece = max(1, PIECE // width)

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            own, held = [], 0
            for row, data in enumerate(batch.column(2).to_pylist()):
                text = symbols(data, width)
                for at in range(0, max(1, len(text) - length + 1), piece):
                    part = text[at : at + piece + length - 1]
                    if len(part) >= length:
                        own.append((row, at, part))
                        held += len(part)
                    if held >= piece:
                        yield emit(own, ids, keys)
                        own, held = [], 0
            if own:
                yield emit(own, ids, keys)

    def emit(own, ids, keys):
        sizes = np.array([len(x[2]) for x in own])
        owner = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
        start, count, anchor, string = stretches(np.concatenate([x[2] for x in own]), owner, length, gram)
        at = owner[start]
        order = np.lexsort((start, string, anchor, at))
        at, start, count, anchor, string = (x[order] for x in (at, start, count, anchor, string))
        new = np.r_[True, (at[1:] != at[:-1]) | (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1])] if len(at) else np.zeros(0, bool)
        offset = np.array([x[1] for x in own]) - (np.cumsum(sizes) - sizes)
        starts = pa.ListArray.from_arrays(np.r_[np.flatnonzero(new), len(at)].astype(np.int32), pa.array(start + offset[at]))
        row = pa.array(np.array([x[0] for x in own])[at[new]])
        return pa.RecordBatch.from_arrays([ids.take(row), keys.take(row), pa.array(count[new].astype(np.int32)), pa.array(anchor[new].view(np.int64)), pa.array(string[new].view(np.int64)), starts], names=names)

    return docs.select("doc_id", "text_key", F.encode("text", "UTF-8").alias("data")).mapInArrow(run, schema)


PARTS = "anchor long, string long, base long, number long, data binary, part long"


def _cut(length: int, width: int):
    """Of (doc_id, text_key, data, wanted) rows the strings that are wanted of a text of words."""

    def run(batches):
        for batch in batches:
            out = []
            for data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = symbols(data, width)
                out += [(w["anchor"], w["string"], 0, w["number"], text[w["start"] : w["start"] + w["windows"] + length - 1].tobytes(), w["anchor"]) for w in wanted]
            yield _part_rows(out)

    return run


def _part_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in PARTS.split(", ")])


def _finer(length: int, gram: int, width: int):
    """Cut strings into stretches whose windows share a longer gram, named by it in ``part``."""

    def run(batches):
        for batch in batches:
            out = []
            for anchor, string, base, number, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                start, count, at, _ = stretches(_held(data, width), np.zeros(len(data) // width, np.int32), length, gram)
                for s, n, a in zip(start.tolist(), count.tolist(), at.view(np.int64).tolist()):
                    out.append((anchor, string, base + s, number, data[s * width : (s + n + length - 1) * width], a))
            yield _part_rows(out)

    return run


def _merge(length: int, stride: int, width: int):
    """Of a bucket of PARTS rows: the repeated windows of each string as runs."""

    def run(rows: pa.Table) -> pa.Table:
        keys = ("part", "anchor", "string", "base")
        rows = rows.sort_by([(k, "ascending") for k in keys])
        part, anchor, string, base = (rows.column(c).to_numpy() for c in keys)
        # a text that occurs twice with one id brings its strings twice
        first = np.r_[True, (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1]) | (base[1:] != base[:-1])] if len(part) else np.zeros(0, bool)
        part, anchor, string, base = part[first], anchor[first], string[first], base[first]
        number, data = rows.column("number").to_numpy()[first], rows.column("data").filter(pa.array(first)).to_pylist()
        group = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        low, size = 0, 0
        for i, j in zip(group[:-1], group[1:]):
            size += sum(len(d) // width + 1 for d in data[i:j])
            if size >= SUFFIXES or j == len(part):
                at, offset = repeated_windows([_held(d, width) for d in data[low:j]], number[low:j], length, stride)
                order = np.lexsort((offset, at))
                at, offset = at[order] + low, offset[order]
                new = np.r_[True, (at[1:] != at[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(at) else np.zeros(0, bool)
                last = np.r_[new[1:], True] if len(at) else new
                out.append((anchor[at[new]], string[at[new]], offset[new] + base[at[new]], offset[last] + 1 + base[at[last]]))
                low, size = j, 0
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("anchor", "string", "low", "high"), columns)))

    return run


def _shared(parts: DataFrame, length: int, gram: int, stride: int, width: int) -> DataFrame:
    """(anchor, string, low, high) runs of windows that occur twice among the parts of a group."""
    spark, done = parts.sparkSession, []
    while True:
        sizes = materialise(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("total")), "groups")
        if gram >= length or sizes.where(F.col("n") > GROUP_STRINGS).isEmpty():
            break
        gram = (gram + length + 1) // 2
        huge = parts.join(sizes.where(F.col("n") > GROUP_STRINGS).select("part"), "part").select("anchor", "string", "base", "number", "data")
        done.append(parts.join(sizes.where(F.col("n") <= GROUP_STRINGS).select("part"), "part"))
        parts = materialise(huge.dropDuplicates(["anchor", "string", "base"]).mapInArrow(_finer(length, gram, width), PARTS), "finer")
    if gram >= length:  # every part is one window: equal ones are told by their bytes
        twice = parts.groupBy("part", "data").agg(F.sum("number").alias("total")).where("total > 1").select("part", "data")
        same = parts.join(materialise(twice, "twice"), ["part", "data"])
        found = same.select("anchor", "string", F.col("base").alias("low"), (F.col("base") + 1).alias("high"))
    else:
        done.append(parts)
        found = None
    if done:
        rest = done[0]
        for more in done[1:]:
            rest = rest.unionByName(more)
        buckets = 4 * partitions(spark)
        # A stated number of partitions: merging costs far more than its bytes suggest, and
        # adaptive execution would put small partitions together by their bytes.
        dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets))).repartition(partitions(spark), "bucket")
        merged = dealt.groupBy("bucket").applyInArrow(_merge(length, stride, width), "anchor long, string long, low long, high long")
        found = merged if found is None else found.unionByName(merged)
    return found


def spans(docs: DataFrame, length: int, gram: int, stride: int, width: int = BYTE) -> DataFrame:
    """(doc_id, text_key, spans): starts of repeated windows of each text, as [low, high) pairs."""
    every = materialise(_windows(docs, length, gram, width), "windows")
    # Written, so that both sides of the join are plain shuffles and a hot anchor can be split.
    shared = materialise(every.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("anchor"), "anchors")
    some = materialise(every.join(shared, "anchor"), "shared-windows")
    strings = some.groupBy("anchor", "string").agg(F.sum(F.size("starts")).alias("number"), F.min(F.struct("doc_id", "text_key", F.element_at("starts", 1).alias("start"), "windows")).alias("at"))
    strings = materialise(strings, "strings")
    # Where an anchor has one string only, all its windows occur as often as it does.
    kinds = materialise(strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    alone = strings.join(kinds.where("kinds = 1"), "anchor").select("anchor", "string", F.lit(0).cast("long").alias("low"), F.col("at.windows").cast("long").alias("high"))
    several = strings.join(kinds.where("kinds > 1").select("anchor"), "anchor")
    wanted = several.groupBy("at.doc_id", "at.text_key").agg(F.collect_list(F.struct("anchor", "string", "number", "at.start", "at.windows")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "wanted")
    text = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    cut = F.expr(f"substring(data, cast(w.start + 1 as int), w.windows + {length - 1})")
    text = text.select(F.encode("text", "UTF-8").alias("data"), "wanted")
    if width == BYTE:
        parts = text.select("data", F.explode("wanted").alias("w"))
        parts = parts.select("w.anchor", "w.string", F.lit(0).cast("long").alias("base"), "w.number", cut.alias("data"), F.col("w.anchor").alias("part"))
    else:
        parts = text.mapInArrow(_cut(length, width), PARTS)
    found = alone.unionByName(_shared(materialise(parts, "parts"), length, gram, stride, width))
    runs = F.expr("transform(starts, s -> struct(s + low as low, s + high as high))")
    hits = some.join(found, ["anchor", "string"]).select("doc_id", "text_key", runs.alias("runs"))
    # A text that occurs twice with one id brings the same runs twice. Runs of different strings
    # differ, so that sets of whole arrays do; array_distinct compares all pairs of structs.
    return hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.flatten(F.collect_set("runs"))).alias("spans"))


def _kept(data: bytes, spans: list[dict] | None, length: int, width: int) -> tuple[bytes, int]:
    """What is left of a text, and how many runs went; white space after a word goes with it."""
    if not spans:
        return data, 0
    bounds = None if width == BYTE else [m.start() for m in WORD.finditer(data)] + [len(data)]
    left, runs, end = [], 0, 0
    for low, high in ((s["low"], s["high"] + length - 1) for s in spans):
        if bounds:
            low, high = bounds[low], bounds[high]
        if low > end or runs == 0:
            left.append(data[end:low])
            runs += 1
        end = max(end, high)
    return b"".join(left) + data[end:], runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int | None = None, letter_bytes: int = 8, digest: bool = False, keep: tuple[str, ...] = (), words: bool = False) -> DataFrame:
    """Each text without the bytes of any ``length``-byte string that starts twice or more.

    Texts are UTF-8 bytes, a null one empty; matches lie inside a text, overlaps and repeats
    within one text count, and all is judged on the input. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept (binary), or with ``digest`` kept_sha256; after
    them the columns in ``keep`` as keep_<name>. Texts shorter than ``length`` stay whole. Rows that repeat,
    ids included, are texts of their own and repeat each other. An empty table gives none. Texts
    of any length are read whole, in overlapping pieces.

    With ``words`` a string is ``length`` words instead, whatever white space is between them;
    a word is a maximal run without ASCII white space. ``length`` is a multiple of
    ``letter_bytes`` where it counts bytes; ``gram`` is half of it unless given.
    """
    stride, width, gram = (1, WORDS, gram or max(1, length // 2)) if words else (letter_bytes, BYTE, gram or max(1, length // 2))
    if length % stride or not 0 < gram <= length:
        raise ValueError("length must be a multiple of letter_bytes and at least gram")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    found = spans(rows.select("doc_id", "text_key", "text"), length, gram, stride, width)
    found = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "spans")
    # A merge join at every size, so that what a run shuffles grows as its input does.
    joined = rows.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    kept_type = "kept_sha256 string" if digest else "kept binary"
    held = [f"keep_{c}" for c in keep]
    kinds = {f"keep_{c}": docs.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join([f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept_type}", *(f"`{c}` {k}" for c, k in kinds.items())])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", kept_type.split()[0], *held]

    def run(batches):
        for batch in batches:
            data = batch.column(1).to_pylist()
            left = [_kept(d, s, length, width) for d, s in zip(data, batch.column(2).to_pylist())]
            size = np.fromiter(map(len, data), np.int64, len(data))
            after = np.fromiter((len(x) for x, _ in left), np.int64, len(left))
            kept = pa.array([hashlib.sha256(x).hexdigest() for x, _ in left], pa.string()) if digest else pa.array([x for x, _ in left], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(size - after), pa.array([n for _, n in left], pa.int64()), kept, *batch.columns[3:]], names=names)

    return joined.select("doc_id", F.encode("text", "UTF-8").alias("data"), "spans", *held).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: bool = False) -> DataFrame:
    """``docs`` with the repeated strings cut out of its texts and n_chars, if there, set anew.

    ``length`` counts bytes, or with ``words`` words.

    A character of which a repeat covers some bytes goes as a whole. Every row stays, its text
    empty where nothing is left; a null text becomes empty.
    """
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    made = remove_repeats(docs, id_col, text_col, length, keep=others, words=words)
    whole = F.expr("try_validate_utf8(cast(kept as string))")
    text = F.coalesce(whole, F.regexp_replace(F.expr("make_valid_utf8(cast(kept as string))"), "\ufffd", ""))
    columns = {id_col: F.col("doc_id"), text_col: text} | {c: F.col(f"keep_{c}") for c in others}
    if "n_chars" in others:
        columns["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return made.select(*(columns[c].alias(c) for c in docs.columns))
