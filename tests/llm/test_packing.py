"""Packing: ids against the tokenizers library, every id in one piece, gapless sequences, little padding."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ostinato.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_pieces(rows, texts, window):
    """rows of pieces against texts {id: text}; returns the padding."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("window", [16, 1024])
def test_pieces(spark, window):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(["the", "of", "ation", "é", "x\n\n", "<|endoftext|>"], rng.integers(0, 60))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "word " * 3000, 1003: "a" * 5000}
    texts |= {i: "same text here" for i in range(2000, 2200)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, rank string").repartition(5)
    assert check_pieces(packing.pack(docs, PATH, window=window).collect(), texts, window) < window


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "x"), (7, "x")], "doc_id long, text string")
    got = packing.pack(docs, PATH, window=8).collect()
    assert sum(r.length for r in got) == 2 * 4 + 2 * 2
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packing.pack(docs, PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_tail_once(seed):
    """All (length, rank) places, unrolled: no overlap, full windows, at most one padded sequence."""
    rng = np.random.default_rng(seed)
    window = 64
    histogram = np.zeros(window, int)
    np.add.at(histogram, rng.integers(1, window, 500), 1)
    histogram[40] += 300 * seed
    made = packing.plan(histogram, window)
    filled = np.zeros((made.sequences, window), int)
    for n in range(1, window):
        for rank in range(histogram[n]):
            s = np.searchsorted(made.key, n * packing.BIG + rank, "right") - 1
            ahead = n * packing.BIG + rank - made.key[s]
            first = made.sequence[s] * window + (made.offset[s] + ahead * n if made.stream[s] else ahead * window + made.offset[s])
            for k in range(first, first + n):
                filled[k // window, k % window] += 1
    assert filled.max() == 1
    assert (filled.sum(axis=1) < window).sum() <= 1
    if seed == 0:
        assert made.sequences == -(-int((histogram * np.arange(window)).sum()) // window)


def test_least_squares_against_exact_solution():
    """A histogram that combinations meet exactly is met."""
    histogram = np.zeros(16, int)
    for n, k in ((3, 40), (5, 40), (8, 60), (4, 20)):
        histogram[n] = k
    combos = packing.combinations(np.flatnonzero(histogram), 16)
    assert sorted(map(tuple, combos.tolist())) == [(3, 5, 8), (4, 4, 8), (8, 8, 0)]
    x = packing.least_squares(combos, histogram.astype(float), 4000)
    used = np.zeros(16)
    for row, times in zip(combos, x):
        for n in row[row > 0]:
            used[n] += times
    assert np.abs(used - histogram).max() < 0.5
