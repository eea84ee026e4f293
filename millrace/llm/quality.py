"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled rows that a model is fitted on at most, the first by a hash of their id.
SAMPLE_ROWS = 20_000
FOLDS = 5

# Bytes whose share in a text is a statistic of its own.
MARKS = b"|#%&$*!.,?:;-_@/<>{}()[]=+\"'\\~^"
UPPER = np.arange(65, 91)
LOWER = np.arange(97, 123)
DIGIT = np.arange(48, 58)


def statistics(text: str | None) -> list[float]:
    """Statistics of the whole text alone; an empty or null text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * (len(MARKS) + 20)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    many, rows = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    most = sorted(seen.values(), reverse=True)[:3]
    pairs = len(set(zip(words, words[1:])))
    ends = np.fromiter((w[-1] for w in words), np.uint8, len(words))
    marked = np.isin(ends, np.frombuffer(b"#%&$*!|", np.uint8)).sum()
    letters = counts[UPPER].sum() + counts[LOWER].sum()
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        lengths.mean() if len(words) else 0.0,
        lengths.std() if len(words) else 0.0,
        float(lengths.max(initial=0)),
        n / rows,
        counts[UPPER].sum() / max(letters, 1e-9),
        counts[DIGIT].sum(),
        counts[32],
        counts[10],
        counts[128:].sum(),
        counts[:32].sum() - counts[9] - counts[10] - counts[13],
        len(seen) / many,
        most[0] / many if most else 0.0,
        sum(most) / many,
        pairs / max(1, len(words) - 1),
        len(set(lines)) / rows,
        marked / many,
        len(zlib.compress(data, 1)) / n,
        *counts[np.frombuffer(MARKS, np.uint8)],
    ]


@dataclass
class Trees:
    """Complete binary trees as flat arrays: a row for each tree, heap order inside."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    prior: float

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def score(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(0)
        binned, rows, total = self.bins(values), np.arange(len(values)), np.full(len(values), self.prior)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(values), np.int64)
            while node[0] < inner:
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(values: np.ndarray, labels: np.ndarray, trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 5.0) -> Trees:
    """Boosted trees for the log-odds of label 1. Splits are at quantile bins; ties go to the
    first statistic and the lowest bin. One class or no rows: a constant score."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    if len(np.unique(labels)) < 2:
        none = np.zeros((0, inner), np.int64)
        return Trees([np.zeros(0)] * values.shape[1], none, none, np.zeros((0, inner + 1)), prior)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in values.T]
    model = Trees(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), bins), np.zeros((trees, inner + 1)), prior)
    binned = model.bins(values).astype(np.int64)
    columns, total, width = binned.shape[1], np.full(len(labels), prior), bins + 1
    flat = binned + np.arange(columns) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = labels - p, p * (1 - p)
        node = np.zeros(len(labels), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first) * (columns * width))[:, None] + flat
            g, h = (np.bincount(cell.ravel(), np.repeat(x, columns), count * columns * width).reshape(count, columns, width) for x in (slope, bend))
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            best = gain.reshape(count, -1).argmax(1)
            worth = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            model.feature[t, first : first + count] = np.where(worth, best // width, 0)
            model.cut[t, first : first + count] = np.where(worth, best % width, bins)
            node = 2 * node + 1 + (binned[np.arange(len(node)), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        model.leaf[t] = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + ridge)
        total += model.leaf[t][leaf]
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """A model of ``labels.quality`` from rows that are not held out.

    Fitted on ``rows`` labelled documents at most, the first by a hash of their id; their
    statistics, a fixed number of doubles each, are what reaches the driver.
    """
    order = F.xxhash64("d", F.lit(7))
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("d"), F.col("quality").cast("int").alias("quality"))
        .where("d is not null and quality in (0, 1)")
        .where(~held_out("d"))
        .groupBy("d").agg(F.max("quality").alias("quality"))
        .orderBy(order, "d").limit(rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            made = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64())), batch.column(2)], names=["d", "values", "quality"])

    # chosen has ``rows`` rows of twelve bytes at most
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("d")).select("d", "text", "quality")
    found = joined.mapInArrow(run, "d long, values array<double>, quality int").orderBy(order, "d", "values").limit(rows).toArrow()
    values = np.array(found.column("values").to_pylist(), float).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, len(statistics(""))))
    return fit(values, found.column("quality").to_numpy().astype(float))


def scores(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; label 1 is likelier the higher the score.

    The whole text decides and nothing else, whatever its length; null and empty texts are
    scored alike. Repeated rows and null ids stay, an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            made = np.array([statistics(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(made))], names=["doc_id", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.

    Null and empty texts are scored like any other, texts of any length whole; repeated rows and
    null ids stay, as only the text decides; an empty table stays empty.
    """
    model, at = train(docs, labels, id_col, text_col), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            made = np.array([statistics(t) for t in batch.column(at).to_pylist()], float)
            yield batch.filter(pa.array(model.score(made) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): predicted is 1 at ``threshold`` and above.

    A null id is not held out. Texts of any length are scored whole, repeated rows are scored
    alike. Without labelled rows every score is 0.5; an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    found = scores(docs, model, id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
