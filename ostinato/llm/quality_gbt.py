"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays.

Each tree is a complete binary tree in arrays (node i has children 2i + 1 and 2i + 2), so all rows of a batch
go down all trees together in `depth` indexing steps. The fit sees at most about `per_class` rows of each
class, by numbers only: statistics are computed in the tasks, and a table of them, not the texts, is binned
and fitted. Class weights restore the classes' sizes.

Defined cases: an empty or null text has all statistics 0 and gets a score; null labels are left out, of
repeated labels the larger counts; with a single class, or none, every score is that class's share (0.5
without labels); repeated rows are scored each; only id, text and label columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.batches import Words, flat, map_texts, per_row
from ostinato.llm.labels import PER_CLASS, class_sample, one_label
from ostinato.llm.text_stats import SYMBOLS, byte_flags, line_counts, repeated_words

CLASSES = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "stop": b".!?", "comma": b",;:",
           "symbol": SYMBOLS, "pipe": b"|", "shout": b"!", "quote": b"\"'", "slash": b"/\\_@=+", "bracket": b"()[]{}", "high": bytes(range(128, 256))}
NAMES = ("words", "word_length", "longest", "short", "distinct", "lines", "dup_lines", "repeated", *CLASSES)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    data, offsets = flat(column)
    words = Words(data, offsets)
    n, size = np.maximum(words.count, 1), np.maximum(np.diff(offsets), 1)
    length = words.ends - words.starts
    longest = np.zeros(len(n))
    if len(length):
        filled = words.count > 0
        longest[filled] = np.maximum.reduceat(length, words.rows[:-1][filled])
    wide = max(1, len(words.vocabulary))
    kinds = np.bincount(np.unique(words.row_of() * wide + words.codes) // wide, minlength=len(n))
    lines, dup = line_counts(data, offsets, words)
    out = [np.log1p(words.count), per_row(length, words.rows) / n, np.log1p(longest), per_row(length <= 2, words.rows) / n, kinds / n,
           lines / n, dup / np.maximum(lines, 1), repeated_words(words) / n]
    return np.stack([*out, *(per_row(byte_flags(c)[data], offsets) / size for c in CLASSES.values())], axis=1)


@dataclass
class Forest:
    base: float
    feature: np.ndarray       # (trees, inner nodes)
    threshold: np.ndarray     # (trees, inner nodes); a row goes right if its value is larger
    leaf: np.ndarray          # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.leaf[trees, node - inner].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
        l2: float = 5.0, min_weight: float = 5.0) -> Forest:
    """Level-wise trees on the logistic loss; each level takes its histograms for all nodes and features at once."""
    rows, columns = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(columns)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = np.log(share / (1 - share))
    margin = np.full(rows, base)
    inner = 2 ** depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * columns + np.arange(columns)) * bins + code
            size = width * columns * bins
            shape = (width, columns, bins)
            sums = [np.bincount(cell.ravel(), weights=np.repeat(v, columns), minlength=size).reshape(shape) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2)[:, :, :-1] for s in sums)
            all_g, all_h = (s.sum(axis=2, keepdims=True) for s in sums)
            gain = left_g ** 2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g ** 2 / (all_h + l2)
            gain[(left_h < min_weight * 0.1) | (all_h - left_h < min_weight * 0.1)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e):] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            use = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            column, cut = best // (bins - 1), best % (bins - 1)
            feature[t, first:first + width] = np.where(use, column, 0)
            threshold[t, first:first + width] = [edges[c][k] if u else np.inf for c, k, u in zip(column, cut, use)]
            own = node - first
            node = 2 * node + 1 + (use[own] & (code[np.arange(rows), column[own]] > cut[own]))
        own = node - inner
        step = -np.bincount(own, weights=g, minlength=inner + 1) / (np.bincount(own, weights=h, minlength=inner + 1) + l2)
        leaf[t] = rate * step
        margin += leaf[t][own]
    return Forest(base, feature, threshold, leaf)


def constant(share: float) -> Forest:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Forest(np.log(share / (1 - share)), np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
          per_class: int = PER_CLASS) -> Forest:
    """Fit on labelled documents. labels: the rows that may be learnt from."""
    sample, sizes = class_sample(one_label(labels, label, id_col), "label", id_col, per_class)
    if len(sizes) < 2:
        return constant(1.0 if sizes.get(1) else 0.0 if sizes else 0.5)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample.withColumnRenamed(id_col, "_id")), "_id").select("text", "label")

    def run(batch: pa.RecordBatch) -> dict:
        numbers = statistics(batch.column("text"))
        width = numbers.shape[1]
        return {"label": batch.column("label"), "x": pa.ListArray.from_arrays(
            pa.array(np.arange(len(numbers) + 1) * width, pa.int32()), pa.array(numbers.ravel()))}

    found = map_texts(rows, run, "label int, x array<double>").toArrow()
    y = found["label"].to_numpy()
    if len(np.unique(y)) < 2:
        return constant(float(y[0]) if len(y) else 0.5)
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T, y))                    # the same model however the rows arrive
    x, y = x[order], y[order]
    weight = np.array([sizes[k] / max(1, (y == k).sum()) for k in (0, 1)])[y]
    return fit(x, y, weight * len(y) / weight.sum())


def score(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) of every row."""
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        return {n: batch.column(n) for n in (id_col, *keep)} | {"score": pa.array(model.predict(statistics(batch.column(text_col))))}

    return map_texts(docs.select(id_col, text_col, *keep), run, ", ".join([*(f"`{n}` {kinds[n]}" for n in (id_col, *keep)), "score double"]), text_col)
