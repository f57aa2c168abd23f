"""Language of whole texts and of the spans of mixed texts.

Every word has a score for each language: the sum of log probabilities of its byte 2-, 3- and 4-grams under
the language, against the mean of the languages that its script allows. A script is allowed for a language
if at least one in a thousand of the language's words in training is written in it; words of other languages'
scripts cannot take the language. A Viterbi pass over the words of a text with a penalty for each switch
gives one language per word; neighbouring words of one language form a span.

The model is counted from a sample of at most about `per_class` texts of each language; prediction covers all
rows and whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any training text every
text is `und`; repeated rows are answered each; only id, text and language columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.batches import Words, flat, fold, map_texts
from ostinato.llm.bpe import LETTER, class_table
from ostinato.llm.labels import class_sample

PER_CLASS = 3_000
SLOTS = 1 << 15               # hashed n-grams of one order
ORDERS = (2, 3, 4)
SWITCH = 8.0                  # cost of a change of language between two words
SCALE = 0.5                   # the orders overlap, so their evidence is halved
FORBIDDEN = -1e4
BATCH_BYTES = 12 << 20        # long texts go word by word; more of them at once share the steps
UNKNOWN = "und"
# First code points of script ranges, and what begins there.
RANGES = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
          (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
          (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
          (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
          (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
          (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"),
          (0x20000, "han"), (0x30000, "other")]
SCRIPTS = list(dict.fromkeys(name for _, name in RANGES))


class WordTable:
    """Distinct words of a batch: script (-1 without a letter), letters, and the hashed n-grams of all."""

    def __init__(self, vocabulary: pa.Array):
        data, offsets = flat(vocabulary)
        n = len(offsets) - 1
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[lead].astype(np.int64)
        size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        code = np.where(size == 1, first, np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07)))
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (data[lead[more] + k] & 0x3F)
        letter = class_table()[code] == LETTER
        word = np.searchsorted(offsets, lead, "right") - 1
        self.letters = np.bincount(word[letter], minlength=n)
        script = np.array([SCRIPTS.index(name) for _, name in RANGES])[np.searchsorted([c for c, _ in RANGES], code, "right") - 1]
        self.script = np.full(n, -1)
        np.maximum.at(self.script, word[letter], script[letter])
        # each word between two marks, one array
        length = np.diff(offsets)
        begin = offsets[:-1] + 2 * np.arange(n)
        self.owner = np.repeat(np.arange(n), length + 2)
        padded = np.full(len(data) + 2 * n, 32, np.uint32)
        padded[np.arange(len(data)) + 2 * np.repeat(np.arange(n), length) + 1] = data
        self.begin = begin
        grams, owners = [], []
        for order, width in enumerate(ORDERS):
            if len(padded) < width:
                continue
            at = np.flatnonzero(self.owner[width - 1:] == self.owner[:len(padded) - width + 1])
            key = np.zeros(len(at), np.uint32)
            for k in range(width):
                key = (key << np.uint32(8)) | padded[at + k]
            grams.append(order * SLOTS + ((key * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64))
            owners.append(self.owner[at])
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        self.gram_word = np.concatenate(owners) if owners else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray          # (n-gram slot, language), less the mean over the languages
    allowed: np.ndarray       # (script, language)

    def word_scores(self, table: WordTable) -> np.ndarray:
        n = len(table.letters)
        scores = np.stack([np.bincount(table.gram_word, weights=self.logp[:, k][table.gram], minlength=n) for k in range(len(self.languages))], axis=1)
        allowed = self.allowed[np.maximum(table.script, 0)]
        scores = SCALE * scores
        some = allowed.any(axis=1)
        scores = np.where(some[:, None] & ~allowed, FORBIDDEN, np.where(some[:, None], scores, 0.0))
        scores[table.script < 0] = 0.0
        return scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> Model:
    """Count the sampled texts of each language; `docs` holds only rows that may be learnt from."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sample, sizes = class_sample(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "lang", "id", per_class)
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0), bool))

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = flat(batch.column("text"))
        words = Words(fold(data), offsets)
        table = WordTable(words.vocabulary)
        own = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])
        of_word = own[words.row_of()]
        lang, slot, n = [], [], []
        for k in np.unique(own):
            held = np.bincount(words.codes[of_word == k], minlength=len(words.vocabulary))
            grams = np.bincount(table.gram, weights=held[table.gram_word], minlength=len(ORDERS) * SLOTS)
            scripts = np.bincount(table.script[table.script >= 0], weights=held[table.script >= 0], minlength=len(SCRIPTS))
            both = np.concatenate((grams, scripts))
            used = np.flatnonzero(both)
            lang.append(np.full(len(used), k))
            slot.append(used)
            n.append(both[used])
        return {"lang": pa.array(np.concatenate(lang), pa.int32()), "slot": pa.array(np.concatenate(slot), pa.int32()),
                "n": pa.array(np.concatenate(n).astype(np.int64))}

    found = map_texts(sample.select("text", "lang"), run, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(ORDERS) * SLOTS + len(SCRIPTS), len(languages)))
    counts[found["slot"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = counts[:-len(SCRIPTS)], counts[-len(SCRIPTS):]
    logp = np.concatenate([np.log((part + 0.2) / (part + 0.2).sum(axis=0)) for part in np.split(grams, len(ORDERS))])
    return Model(languages, (logp - logp.mean(axis=1, keepdims=True)), scripts >= 0.001 * np.maximum(scripts.sum(axis=0), 1))


def viterbi(scores: np.ndarray, code: np.ndarray, rows: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word of each text: scores(word number, language), code = word numbers, rows = text bounds.

    All texts of the batch advance together, the longest first, so a step touches those that still have words.
    """
    length = np.diff(rows)
    order = np.argsort(-length, kind="stable")
    begin, length = rows[:-1][order], length[order]
    path = np.zeros(len(code), np.int32)
    if not len(code):
        return path
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")     # texts longer than the step
    stay = np.zeros((len(code), scores.shape[1]), bool)
    came = np.zeros(len(code), np.int32)
    best = scores[code[begin[:active[0]]]]
    for t in range(1, steps):
        m = active[t]
        at = begin[:m] + t
        old = best[:m]
        top = old.argmax(axis=1)
        jump = old[np.arange(m), top] - switch
        stays = old >= jump[:, None]
        best[:m] = np.where(stays, old, jump[:, None]) + scores[code[at]]
        stay[at] = stays
        came[at] = top
    state = np.zeros(len(length), np.int64)
    full = int(active[0])
    state[:full] = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        now = state[:m]
        path[at] = now
        state[:m] = np.where(stay[at, now], now, came[at]) if t else now
    return path


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
             switch: float = SWITCH) -> DataFrame:
    """(id, lang_pred, score, spans): the language of most letters and its share of them; spans hold first word, end and language."""
    kinds = dict(docs.dtypes)
    names = [*model.languages, UNKNOWN]

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = flat(batch.column(text_col))
        words = Words(fold(data), offsets)
        table = WordTable(words.vocabulary)
        rows, wide = batch.num_rows, max(1, len(model.languages))
        if model.languages:
            path = viterbi(model.word_scores(table), words.codes, words.rows, switch)
            row = words.row_of()
            letters = np.bincount(row * wide + path, weights=table.letters[words.codes], minlength=rows * wide).reshape(rows, wide)
        else:
            path, row, letters = np.zeros(len(words.codes), np.int32), words.row_of(), np.zeros((rows, 1))
        total = letters.sum(axis=1)
        best = np.where(total > 0, letters.argmax(axis=1), len(model.languages))
        change = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (row[1:] != row[:-1])))) if len(path) else np.zeros(0, np.int64)
        end = np.append(change[1:], len(path))[:len(change)]
        base = words.rows[row[change]]
        at = np.searchsorted(row[change], np.arange(rows + 1))
        spans = pa.StructArray.from_arrays([pa.array(change - base, pa.int32()), pa.array(end - base, pa.int32()),
                                            pa.DictionaryArray.from_arrays(pa.array(path[change] if model.languages else np.zeros(len(change), np.int32), pa.int32()),
                                                                           pa.array(names, pa.string())).cast(pa.string())], ["start", "end", "lang"])
        return {n: batch.column(n) for n in (id_col, *keep)} | {
            "lang_pred": pa.array([names[k] for k in best], pa.string()),
            "score": pa.array(letters.max(axis=1, initial=0) / np.maximum(total, 1)),
            "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)}

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in (id_col, *keep)), "lang_pred string", "score double",
                        "spans array<struct<start: int, end: int, lang: string>>"])
    return map_texts(docs.select(id_col, text_col, *keep), run, schema, text_col, BATCH_BYTES)
