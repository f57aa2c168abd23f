"""Counts over whole texts, all rows of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ostinato.llm.batches import Words, distinct, flat, per_row, separators

SYMBOLS = b"#*$%&|<>"      # fixed by the rule


def byte_flags(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(characters)] = True
    return flags


def repeated_words(words: Words) -> np.ndarray:
    """Words of each row that lie in a 3-word window which the row holds twice or more."""
    codes, total = words.codes, len(words.codes)
    covered = np.zeros(total, bool)
    if total >= 3:
        row = words.row_of()
        at = np.flatnonzero(row[2:] == row[:-2])
        wide = max(2, len(words.vocabulary))
        if wide < 1 << 21:
            key = (codes[at] << 42) | (codes[at + 1] << 21) | codes[at + 2]
        else:
            pair = np.unique(codes[at] * wide + codes[at + 1], return_inverse=True)[1]
            key = pair * wide + codes[at + 2]
        order = np.argsort(key, kind="stable")
        same = (key[order][1:] == key[order][:-1]) & (row[at[order]][1:] == row[at[order]][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return per_row(covered, words.rows)


def line_counts(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line, for each row."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    start = np.zeros(len(data) + 1, bool)
    breaks = np.flatnonzero(data == 10)
    start[breaks] = True
    start[breaks + 1] = True
    start[offsets] = True
    start[[0, -1]] = True
    bounds = np.flatnonzero(start)
    codes, _ = distinct(data, bounds)
    lines = np.unique(np.searchsorted(bounds, words.starts, "right") - 1)
    row = np.searchsorted(offsets, bounds[:-1][lines], "right") - 1
    once = np.unique(row * (len(bounds) + 1) + codes[lines])
    n = np.bincount(row, minlength=rows)
    return n, n - np.bincount(once // (len(bounds) + 1), minlength=rows)


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each row."""
    data, offsets = flat(column)
    words = Words(data, offsets)
    inside = ~separators(data) & ((data & 0xC0) != 0x80)
    n_lines, n_dup = line_counts(data, offsets, words)
    return {"n_words": words.count, "word_chars": per_row(inside, offsets), "n_symbols": per_row(byte_flags(SYMBOLS)[data], offsets),
            "n_lines": n_lines, "n_dup_lines": n_dup, "n_repeat_words": repeated_words(words)}
