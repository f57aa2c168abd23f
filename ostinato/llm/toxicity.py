"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Sentence scores sigmoid(b + w of its words) are combined by noisy-or, 1 - prod(1 - p), and b and w are fitted
to document labels alone. The words that may have a weight are those whose document counts differ between
the classes by more than chance allows over all words tried (log-likelihood ratio above 2 ln words), so the
model stays small. The fit uses a sample of at most about `per_class` rows of each class, weighted back to
the classes' sizes; scoring covers every row and whole texts and marks the sentences at fault.

Defined cases: an empty or null text has no sentence and score 0; null labels and labels without a document
are left out, of repeated labels the larger counts; without both classes every score is 0; repeated rows
are scored each; only id, text and label columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.batches import Words, flat, fold, map_texts, per_row, separators
from ostinato.llm.labels import PER_CLASS, class_sample, one_label
from ostinato.llm.storage import dropped, written

EDGES = ".,;:!?\"'()[]{}*&%$#|<>~-_"     # trimmed from words
OFFENDING = 0.5


class Sentences:
    """Words of a batch with their sentences. A sentence ends at a line break, or after . ! ? before white space."""

    def __init__(self, column: pa.Array):
        raw, offsets = flat(column)
        data = fold(raw)
        self.words = Words(data, offsets)
        closing = np.zeros(len(data), bool)
        if len(data):
            gap = np.append(separators(data[1:]), True)
            closing = ((data == 46) | (data == 33) | (data == 63)) & gap | (data == 10)
            closing[offsets[1:][np.diff(offsets) > 0] - 1] = True
        before = np.cumsum(closing) - closing
        number = before[self.words.starts]
        self.first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.zeros(0, np.int64)
        self.of_word = np.cumsum(np.isin(np.arange(len(number)), self.first)) - 1
        self.row = self.words.row_of()[self.first]
        self.rows = np.searchsorted(self.row, np.arange(len(offsets)))     # sentence bounds of the rows
        trimmed = pc.ascii_trim(self.words.vocabulary.cast(pa.string()), EDGES).dictionary_encode()
        self.names = trimmed.dictionary
        self.code = trimmed.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.words.codes] if len(number) else number
        self._data, self._offsets = data, offsets

    def spans(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last character position (exclusive) of sentences in their texts."""
        ends = np.append(self.first[1:], len(self.words.starts)) - 1
        chars = np.concatenate(([0], np.cumsum((self._data & 0xC0) != 0x80)))
        base = chars[self._offsets[:-1]][self.row[chosen]]
        return chars[self.words.starts[self.first[chosen]]] - base, chars[self.words.ends[ends[chosen]]] - base


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float

    def features(self, text: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, model word) pairs of a batch, each once."""
        if not self.words or not len(text.code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = pc.index_in(text.names, value_set=pa.array(self.words, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        word = known[text.code]
        hit = word >= 0
        pair = np.unique(text.of_word[hit] * len(self.words) + word[hit])
        return pair // len(self.words), pair % len(self.words)


def softplus(z):
    return np.logaddexp(0.0, z)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, positive, n): documents of rows(text, label) that hold the word, summed in the batch first."""
    def run(batch: pa.RecordBatch) -> dict | None:
        text = Sentences(batch.column("text"))
        wide = max(1, len(text.names))
        pair = np.unique(text.words.row_of() * wide + text.code)
        label = batch.column("label").to_numpy(zero_copy_only=False)
        n = np.bincount(pair % wide, minlength=len(text.names))
        positive = np.bincount(pair % wide, weights=label[pair // wide], minlength=len(text.names))
        return {"word": text.names, "positive": pa.array(positive.astype(np.int64)), "n": pa.array(n.astype(np.int64))}

    found = map_texts(rows.select("text", "label"), run, "word string, positive long, n long")
    return found.groupBy("word").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n"))


def telling_words(counts: DataFrame, share: float) -> list[str]:
    """All words of the sample over-represented in positive documents beyond chance, the most telling first."""
    usual = counts.filter("n > 1 and word != ''")
    tried = usual.count()
    if not tried or not 0 < share < 1:
        return []
    a, n = F.col("positive"), F.col("n")
    def part(k, p):
        return F.when(k > 0, k * F.ln(k / (n * F.lit(p)))).otherwise(0.0)
    ratio = 2 * (part(a, share) + part(n - a, 1 - share))
    chosen = usual.filter((a > n * F.lit(share)) & (ratio > 2 * math.log(tried + 1))).orderBy(ratio.desc(), "word")
    return [r["word"] for r in chosen.select("word").collect()]


def fit_noisy_or(doc_label, sentence_doc, pair_sentence, pair_word, n_words, weight, rounds: int = 300):
    """Bias and word weights by Adam on the negative log-likelihood of the document labels.

    A document has one background term of score sigmoid(bias); its sentences without a model word add nothing, so that
    length alone tells nothing.
    """
    bias, w = -7.0, np.full(n_words, 3.0)
    state = np.zeros((2, n_words + 1))
    for step in range(1, rounds + 1):
        z = bias + np.bincount(pair_sentence, weights=w[pair_word], minlength=len(sentence_doc))
        total = np.bincount(sentence_doc, weights=softplus(z), minlength=len(doc_label)) + softplus(bias)
        total = np.maximum(total, 1e-12)
        # d loss / d total: 1 for label 0, -exp(-total) / (1 - exp(-total)) for label 1
        slope = weight * np.where(doc_label == 1, -1 / np.expm1(total), 1.0)
        dz = slope[sentence_doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(pair_word, weights=dz[pair_sentence], minlength=n_words) + 0.02 * (w - 3.0),
                         dz.sum() + slope.sum() / (1 + math.exp(-bias)))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad ** 2
        move = 0.1 * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.99 ** step)) + 1e-8)
        w, bias = w - move[:-1], min(-2.0, bias - move[-1])
    return bias, w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
          per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents. labels: the rows that may be learnt from."""
    sample, sizes = class_sample(one_label(labels, label, id_col), "label", id_col, per_class)
    if not sizes.get(0) or not sizes.get(1):
        return Model([], np.zeros(0), -30.0)
    rows = written(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
                   .join(F.broadcast(sample.withColumnRenamed(id_col, "_id")), "_id").select("text", "label"))
    got = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not got.get(0) or not got.get(1):
        dropped(rows)
        return Model([], np.zeros(0), -30.0)
    counts = written(word_counts(rows))
    model = Model(telling_words(counts, got[1] / (got[0] + got[1])), np.zeros(0), -30.0)

    def run(batch: pa.RecordBatch) -> dict:
        text = Sentences(batch.column("text"))
        sentence, word = model.features(text)
        row = text.row[sentence]
        at = np.searchsorted(row, np.arange(batch.num_rows + 1))
        def lists(values):
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
        return {"label": batch.column("label"), "n": pa.array(np.diff(text.rows), pa.int64()),
                "sentence": lists(sentence - text.rows[row]), "word": lists(word)}

    found = map_texts(rows, run, "label int, n long, sentence array<int>, word array<int>").toArrow()
    dropped(rows, counts)
    label_of, n = found["label"].to_numpy(), found["n"].to_numpy()
    sentence, word = found["sentence"].combine_chunks(), found["word"].combine_chunks()
    doc = np.repeat(np.arange(len(n)), np.diff(sentence.offsets.to_numpy()))
    key, of_pair = np.unique(doc * (int(n.max(initial=0)) + 1) + sentence.flatten().to_numpy(), return_inverse=True)
    weight = np.array([sizes[k] / got[k] for k in (0, 1)])[label_of]
    bias, w = fit_noisy_or(label_of, key // (int(n.max(initial=0)) + 1), of_pair, word.flatten().to_numpy(), len(model.words),
                           weight * len(n) / weight.sum())
    return Model(model.words, w, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, n_sentences, offending) of every row; offending: sentence number, characters start and end, score."""
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        text = Sentences(batch.column(text_col))
        sentence, word = model.features(text)
        z = model.bias + np.bincount(sentence, weights=model.weights[word], minlength=len(text.first))
        z[np.bincount(sentence, minlength=len(text.first)) == 0] = -np.inf        # no model word: adds nothing
        p = 1 / (1 + np.exp(-z))
        bad = np.flatnonzero(p >= OFFENDING)
        at = np.searchsorted(text.row[bad], np.arange(batch.num_rows + 1))
        start, end = text.spans(bad)
        parts = pa.StructArray.from_arrays([pa.array(bad - text.rows[text.row[bad]], pa.int32()), pa.array(start, pa.int32()),
                                            pa.array(end, pa.int32()), pa.array(p[bad], pa.float64())], ["sentence", "start", "end", "score"])
        return {n: batch.column(n) for n in (id_col, *keep)} | {
            "score": pa.array(np.clip(-np.expm1(-per_row(softplus(z), text.rows) - softplus(model.bias)), 0.0, 1.0)),
            "n_sentences": pa.array(np.diff(text.rows), pa.int64()),
            "offending": pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts)}

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in (id_col, *keep)), "score double", "n_sentences long",
                        "offending array<struct<sentence: int, start: int, end: int, score: double>>"])
    return map_texts(docs.select(id_col, text_col, *keep), run, schema, text_col)
