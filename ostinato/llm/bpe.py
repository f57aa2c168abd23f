"""BPE encoding and decoding with the files of public tokenizers, in batched numpy merge rounds.

The texts of a batch are one byte array. It is cut into words by comparing the character classes of
neighbouring bytes, equal words are numbered once, and the symbols of all new words lie in one flat array.
A round looks up the keys of all neighbouring symbols by binary search over the sorted pair keys, takes the
lowest rank of each word, and merges all its places from the left. Vocabularies in which a pair never ranks
before the pair that makes one of its parts, and in which no symbol has two origins, give the same ids as
merging one place at a time; `MergeTable` refuses others.

Defined cases: a null text is empty and gives no ids; texts may be of any length (a batch is cut by bytes;
a longer text stands alone); special tokens are recognised in the raw text as the library does by default;
rows may repeat and ids may be null, each row is answered; columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ostinato.llm.batches import distinct, flat, map_texts

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# The code points of Unicode's White_Space property.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# English endings that the public patterns split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def class_table() -> np.ndarray:
    """Character class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(code) for code in range(0x110000) if not 0xD800 <= code < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        kinds[[ord(c) for c in regex.findall(pattern, every)]] = kind
    kinds[WHITE] = SPACE
    return kinds


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of a UTF-8 array belongs to."""
    kinds = class_table()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (data[lead[more] + k] & 0x3F)
        kind = class_table()[code]
        kinds[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            kinds[lead[more] + k] = kind[more]
    return kinds


def _contractions(data, flag, first, end, kind, last, open_before):
    """Moves the cut after an apostrophe that begins an English ending."""
    sign = np.flatnonzero((kind == OTHER) & (end - first == 1) & (data[first] == 39) & ~last & open_before)
    sign = sign[kind[np.minimum(sign + 1, len(kind) - 1)] == LETTER]
    at, stop = first[sign] + 1, end[np.minimum(sign + 1, len(end) - 1)]
    one = data[at]
    two = data[np.minimum(at + 1, len(data) - 1)]
    size = np.zeros(len(at), np.int64)
    for ending in ENDINGS:
        fits = (one == ord(ending[0])) & (size == 0)
        if len(ending) == 2:
            fits &= (two == ord(ending[1])) & (at + 1 < stop)
        size[fits] = len(ending)
    used = size > 0
    flag[at[used]] = False
    rest = at[used] + size[used]
    flag[rest[rest < stop[used]]] = True


def cut(data: np.ndarray, edges: np.ndarray, whole: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds of all segments, and which words are kept.

    `edges` are segment bounds, `whole` marks segments that are one word (special tokens). `spaced`: the
    pattern of byte-level vocabularies (a space joins the word after it, all text is kept); else the pattern
    of lower-case word vocabularies (white space dropped, digits one by one).
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, bool)
    kinds = byte_classes(data)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    flag = np.empty(n, bool)
    flag[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=flag[1:])
    flag |= edge[:-1]
    first = np.flatnonzero(flag)
    end = np.append(first[1:], n)
    kind, last = kinds[first], edge[end]
    if spaced:
        open_before = edge[first] | (data[np.maximum(first - 1, 0)] != 32)
        _contractions(data, flag, first, end, kind, last, open_before)
        white = np.flatnonzero((kind == SPACE) & ~last)
        final = end[white] - 1
        for _ in range(3):
            final -= (data[final] & 0xC0) == 0x80
        flag[final] = True
        flag[end[white][data[final] == 32]] = False
    else:
        _contractions(data, flag, first, end, kind, last, np.ones(len(first), bool))
        flag |= (kinds == NUMBER) & ((data & 0xC0) != 0x80)
    for k in np.flatnonzero(whole):
        flag[edges[k] + 1:edges[k + 1]] = False
    starts = np.flatnonzero(flag)
    keep = np.ones(len(starts), bool) if spaced else kinds[starts] != SPACE
    return np.append(starts, n), keep


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else the next code from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeTable:
    """A BPE vocabulary read from a public tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.spaced = not self.suffix
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * self.size
        for token, number in [*vocab.items(), *self.special.items()]:
            self.tokens[number] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.uint32)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.uint32)
        left, right = (np.array([vocab[p[k]] for p in model["merges"]], np.int64) for k in (0, 1))
        made = np.array([vocab["".join(p)] for p in model["merges"]], np.int64)
        rank = np.arange(len(made))
        origin = np.full(self.size, -1)
        origin[made] = rank
        if len(np.unique(made)) < len(made) or (origin[left] > rank).any() or (origin[right] > rank).any():
            raise ValueError("pairs out of order: merging all places of a pair at once would not be exact")
        if self.size > 1 << 16:
            raise ValueError("pair keys are 32 bits wide")
        key = (left << 16 | right).astype(np.uint32)
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], np.append(rank[order], len(rank)).astype(np.int32), made[order].astype(np.uint32)
        self.pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a flat array, and the word bounds in it."""
        data, offsets = flat(words)
        size = np.diff(offsets)
        symbols = self.inner[data]
        symbols[offsets[1:][size > 0] - 1] = self.final[data[offsets[1:][size > 0] - 1]]
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        done_word, done_symbols = [], []
        none = len(self.keys)
        place = np.full(len(symbols), none, np.int32)              # of the pair that begins at the symbol, in the sorted keys
        stale = np.ones(len(symbols), bool)
        while len(symbols):
            look = np.flatnonzero(stale[:-1])
            place[stale] = none
            look = look[word[look] == word[look + 1]]
            key = symbols[look] << 16 | symbols[look + 1]
            found = np.minimum(np.searchsorted(self.keys, key), none - 1)
            place[look] = np.where(self.keys[found] == key, found, none)
            rank = self.ranks[place]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            settled = best == none
            done_word.append(word[settled])
            done_symbols.append(symbols[settled])
            hit = np.flatnonzero((rank == best) & ~settled)
            if not len(hit):
                break
            fresh = np.concatenate(([True], np.diff(hit) > 1))      # of touching places every second one merges
            begun = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begun) % 2 == 0]
            symbols[hit] = self.made[place[hit]]
            stale[:] = False
            stale[hit] = True
            stale[np.maximum(hit - 1, 0)] = True
            keep = ~settled
            keep[hit + 1] = False
            symbols, word, place, stale = symbols[keep], word[keep], place[keep], stale[keep]
        owner = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


@functools.cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def _spread(ids: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Ids of the numbered words one after the other."""
    size = np.diff(at)[number]
    ends = np.cumsum(size)
    take = np.repeat(at[:-1][number] - (ends - size), size)
    take += np.arange(len(take))
    return ids.astype(np.int32)[take]


class Encoder:
    """Ids of the texts of a batch."""

    def __init__(self, path: str):
        self.table = merge_table(path)

    def _segments(self, column: pa.Array):
        """Bytes, segment bounds, which segments are special tokens, and row bounds."""
        table = self.table
        data, rows = flat(column)
        special = bool(table.special) and table.pattern.search(data.tobytes().decode("utf-8", "replace")) is not None
        if table.spaced and not special:
            return data, rows, np.zeros(len(rows) - 1, bool), rows
        parts, whole, per_text = [], [], []
        for text in column.to_pylist():
            split = table.pattern.split(text or "") if special else [text or ""]
            per_text.append(len(split))
            for k, part in enumerate(split):
                whole.append(k % 2 == 1)
                parts.append((part if k % 2 or table.spaced else lower_nfc(part)).encode())
        edges = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        rows = edges[np.concatenate(([0], np.cumsum(per_text, dtype=np.int64)))]
        return np.frombuffer(b"".join(parts), np.uint8), edges, np.array(whole, bool), rows

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of each word of the texts, row bounds among the words; ids of the distinct words, and their bounds."""
        table = self.table
        data, edges, whole, rows = self._segments(column)
        bounds, keep = cut(data, edges, whole, table.spaced)
        codes, spans = distinct(data, bounds)
        used = np.zeros(len(spans), bool)
        used[codes[keep]] = True
        number = np.cumsum(used) - 1
        spans = spans.filter(pa.array(used))
        ids, at = table.merge(spans)
        if whole.any():
            for token, own in table.special.items():
                k = pc.index_in(pa.scalar(token.encode()), value_set=spans).as_py()
                if k is not None:
                    ids = np.concatenate((ids[:at[k]], [own], ids[at[k + 1]:]))
                    at = np.concatenate((at[:k + 1], at[k + 1:] + (at[k] + 1 - at[k + 1])))
        return number[codes[keep]], np.searchsorted(bounds[:-1][keep], rows), ids, at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a flat array, and the row bounds in it."""
        number, rows, ids, at = self.words(column)
        ends = np.concatenate(([0], np.cumsum(np.diff(at)[number])))
        return _spread(ids, at, number), ends[rows]


def lower_nfc(text: str) -> str:
    """NFC, then each character's own lower case (no rule for a final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def detokenize(table: MergeTable, ids) -> str:
    """Text of ids: tokens joined by a space where the vocabulary has word ends, else their bytes."""
    tokens = [table.tokens[i] for i in ids]
    if not table.spaced:
        return " ".join(tokens)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    return bytes(byte_of[c] for t in tokens for c in t).decode("utf-8", "replace")


BATCH_BYTES = 12 << 20       # more text shares the ids of more equal words
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Ids of each text and the text that the ids decode to; `outputs` names the columns that are made.

    For vocabularies with word ends. The digests are SHA-256 of the decimal ids joined by one space and of
    the decoded text, taken beside the ids so that neither has to leave the task. One pass, no shuffle.
    """
    def run(batch: pa.RecordBatch) -> dict:
        own = encoder(path)
        number, rows, ids, at = own.words(batch.column(text_col))
        total = np.concatenate(([0], np.cumsum(np.diff(at)[number])))[rows]
        cuts, numbers, ends = rows.tolist(), number.tolist(), at.tolist()

        def texts(of_id):
            tokens = list(map(of_id, ids.tolist()))
            words = [" ".join(tokens[a:b]) for a, b in zip(ends, ends[1:])]
            return [" ".join(map(words.__getitem__, numbers[a:b])) for a, b in zip(cuts, cuts[1:])]

        out = {id_col: batch.column(id_col)}
        for name in outputs:
            if name == "n_tokens":
                out[name] = pa.array(np.diff(total), pa.int64())
            elif name == "ids":
                out[name] = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(_spread(ids, at, number), pa.int32()))
            else:
                made = texts(str if name == "ids_sha256" else own.table.tokens.__getitem__)
                out[name] = pa.array(made if name == "decoded" else [hashlib.sha256(t.encode()).hexdigest() for t in made], pa.string())
        return out

    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs.select(id_col, text_col), run, ", ".join([f"`{id_col}` {kind}", *(f"{n} {OUTPUTS[n]}" for n in outputs)]),
                     text_col, BATCH_BYTES)
