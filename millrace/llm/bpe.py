"""BPE encoding and decoding in batched numpy merge rounds.

Texts are split at white space; each distinct stretch is encoded once. The new stretches of a
batch lie in one flat symbol array. A round looks every adjacent pair up by binary search in
the sorted pair keys, takes each word's lowest rank, and merges all its occurrences at once;
words without a pair that merges leave the array. A word of over LONG symbols has rounds of its
own, which look at the places of one rank and at the pairs that its merges make, so that its
cost does not grow with the square of its length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .packing import byte_characters

# Fixed value: white space as the vocabulary's normalizer understands it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct stretches that a worker remembers; beyond, it starts anew.
REMEMBERED = 500_000
NEVER = np.iinfo(np.int32).max
#: Symbols of a word beyond which it is merged by itself.
LONG = 1_000


class Vocabulary:
    """A word-end BPE file: lower-cased NFC text, white space dropped, bytes as symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in (ids | self.special).items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # \s inside a class; the library's white space leaves out U+001C to U+001F
        self.pieces = regex.compile(splits[0].replace(r"\s", SPACE))
        self.spaces = regex.compile(f"[{SPACE}]+")
        shown = byte_characters()
        self.inner = np.array([ids[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[shown[b] + self.end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * len(self.tokens) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.mark = os.path.commonprefix(list(self.special))

    def stretches(self, text: str) -> list[str]:
        """The text without white space; special tokens' strings stand alone."""
        parts = [text]
        if self.specials and self.mark in text and self.specials.search(text):
            parts = regex.split(f"({self.specials.pattern})", text)
        found: list[str] = []
        for part in parts:
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")
            found += [w for w in self.spaces.split(part) if w] if odd else part.split()
        return found

    def words(self, stretch: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", stretch)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return [w.encode("utf-8", "surrogatepass") for w in self.pieces.findall(text)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges, NEVER where it does not."""
        key = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The merged symbols of one word, rank by rank; places are linked to the next ones left."""
        n = len(symbols)
        symbols, after, ahead = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        there, pending, heap = np.ones(n, bool), {}, []

        def wait(at):
            rank = self._ranks(symbols[at], symbols[after[at]])
            order = np.argsort(rank, kind="stable")
            order = order[: np.searchsorted(rank[order], NEVER)]
            names, starts = np.unique(rank[order], return_index=True)
            for r, own in zip(names.tolist(), np.split(at[order], starts[1:])):
                if r not in pending:
                    pending[r] = []
                    heapq.heappush(heap, r)
                pending[r].append(own)

        wait(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(pending.pop(rank)))
            at = at[there[at] & (after[at] < n)]
            at = at[self._ranks(symbols[at], symbols[after[at]]) == rank]
            # of overlapping occurrences (a a a) every other one from the left merges
            starts = np.r_[True, at[1:] != after[at[:-1]]] if len(at) else np.zeros(0, bool)
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            right = after[at]
            symbols[at], there[right], after[at] = self.merged[rank], False, after[right]
            inner = after[at] < n
            ahead[after[at[inner]]] = at[inner]
            wait(np.unique(np.concatenate([ahead[at][ahead[at] >= 0], at[inner]])))
        return symbols[there]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[data], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(sizes > LONG):
            own = self._merge_long(symbols[word == w])
            done.append((np.full(len(own), w), own))
        if done:
            short = sizes[word] <= LONG
            symbols, word = symbols[short], word[short]
        while len(symbols):
            rank = np.full(len(symbols), NEVER, np.int32)
            rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(symbols[:-1], symbols[1:]), NEVER)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            still = best < NEVER
            if not still.all():
                done.append((word[~still], symbols[~still]))
                symbols, word, rank, best = symbols[still], word[still], rank[still], best[still]
            hit = rank == best
            # Of overlapping occurrences (a a a) every other one from the left merges.
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))
            hit &= run % 2 == 1
            symbols[hit] = self.merged[rank[hit]]
            kept = np.r_[True, ~hit[:-1]] if len(hit) else hit
            symbols, word = symbols[kept], word[kept]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(word, minlength=len(words))


class Codec:
    """A vocabulary with what a worker remembers of it."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.clear()

    def clear(self) -> None:
        special = self.vocabulary.special
        self.index = {text: i for i, text in enumerate(special)}
        self.ids = np.array(list(special.values()), np.uint32)
        self.offsets = np.arange(len(special) + 1)
        self.decoded = [text.encode() for text in special]

    def learn(self, fresh: list[str]) -> None:
        vocabulary = self.vocabulary
        words = [vocabulary.words(s) for s in fresh]
        ids, sizes = vocabulary.encode_words([w for own in words for w in own])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ends = edges[np.cumsum([len(own) for own in words])] if words else edges[:0]
        first = len(self.index)
        self.index.update((s, first + i) for i, s in enumerate(fresh))
        named = [vocabulary.tokens[i] for i in ids.tolist()]
        self.decoded += [b" ".join(named[i:j]) for i, j in zip([0, *ends.tolist()], ends.tolist())]
        self.offsets = np.concatenate([self.offsets, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]):
        """(ids as little-endian uint32, decoded text as UTF-8) of each text."""
        split = [self.vocabulary.stretches(t) for t in texts]
        if len(self.index) > REMEMBERED:
            self.clear()
        self.learn(list({s: None for own in split for s in own if s not in self.index}))
        index, decoded = self.index, self.decoded
        for own in split:
            at = [index[s] for s in own]
            rows = np.array(at, np.int64)
            n = self.offsets[rows + 1] - self.offsets[rows]
            flat = self.ids[np.repeat(self.offsets[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield flat.astype("<u4", copy=False), b" ".join([d for i in at if (d := decoded[i])])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def groups(texts: list[str], size: int = 4_000_000):
    """Neighbouring texts of about ``size`` characters together."""
    own, n = [], 0
    for text in texts:
        own.append(text)
        n += len(text)
        if n >= size:
            yield own
            own, n = [], 0
    if own:
        yield own


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row; with ``digest`` ids_sha256 and decoded_sha256.

    ids are little-endian uint32 in a binary column; decoded is the text of these ids, whose
    tokens the vocabulary joins by a space. A null text counts as empty and has no ids. Every
    row gives a row, repeated ones too; an empty table gives none. Other columns are ignored.
    Texts and words of any length are encoded whole.
    """
    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string"
    names = ["doc_id", "n_tokens", *(k.split()[0] for k in kinds.split(", "))]

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            sizes, first, second = [], [], []
            for part in groups([t or "" for t in batch.column(1).to_pylist()]):
                for ids, decoded in own.encode(part):
                    sizes.append(len(ids))
                    first.append(hashlib.sha256(ids).hexdigest() if digest else ids.tobytes())
                    second.append(hashlib.sha256(decoded).hexdigest() if digest else decoded.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.string() if digest else pa.binary()), pa.array(second, pa.string())], names=names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
