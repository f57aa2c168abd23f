"""Spelling variants against all pairs, trie nodes against the set of prefixes."""
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ostinato.llm import queries, spelling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows, spoil):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoil and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def all_edits(words):
    """Near words by trying every edit of every word; for many words."""
    letters = {c for w in words for c in w}
    found = {}
    for w in words:
        halves = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        tried = {a + b[1:] for a, b in halves if b} | {a + c + b[k:] for a, b in halves for c in letters for k in (0, 1) if len(b) >= k}
        found[w] = [x for x in tried if x != w and x in words]
    return found


def plain(counts, links=None):
    if links is not None:
        return with_forms(counts, links)
    by_length, links = {}, {w: [] for w in counts}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for n, words in by_length.items():
        for a, b in itertools.chain(itertools.combinations(words, 2), itertools.product(words, by_length.get(n + 1, []))):
            if near(a, b):
                links[a].append(b)
                links[b].append(a)
    return with_forms(counts, links)


def with_forms(counts, links):
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), counts[w], len(links[w]), counts[form[w]] if form[w] else None) for w in counts)


def answered(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made_texts(seed, letters="abé", many=400):
    draw = random.Random(seed)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 8))) for _ in range(90)]
    rows = []
    for i in range(many):
        picked = [draw.choice(words[: draw.randint(1, 90)]) for _ in range(12)]
        rows.append((i % 50, draw.choice([" ", ", ", "1", "\n"]).join(w.upper() if draw.random() < .2 and w.isascii() else w for w in picked), "x", 1))
    return rows


@pytest.mark.parametrize("per_task, spoil", [(spelling.WORDS_PER_TASK, True), (7, False), (7, True)])
def test_against_all_pairs(spark, per_task, spoil):
    rows = [*made_texts(per_task), (None, "Queueing queueing queueing QUEUEING", None, 1), (None, None, None, 1), (3, "", None, 1),
            (4, "aaaaaa aaaaaa aaaaaa aaaaa aaaaa aaaaa aaaaa aaaaa aaaaa aaaaa aaaaaaa aaaaaaa aaaaaaa", "x", 2), (5, "ÉTÉS-étésé × ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    got, counts = answered(spelling.spelling_variants(docs, spoil=spoil, per_task=per_task)), counted([r[:2] for r in rows], spoil)
    assert got == plain(counts) == plain(counts, all_edits(counts)) and any(r[1] for r in got)


@pytest.mark.parametrize("per_task", [1, 3, 1000])
def test_nodes_are_the_prefixes(spark, per_task):
    draw = random.Random(per_task)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))) for _ in range(60)} | {"a", "aa", "aaa", "aaaa", "ab" * 40, "ab" * 41})
    table = spark.createDataFrame(list(enumerate(words)), "word_id long, w string").withColumn("spelled", F.encode("w", "ISO-8859-1"))
    nodes = {}
    for r in spelling.trie_nodes(table.repartition(3), F.col("spelled"), per_task).collect():
        word = words[r.word_id]
        assert len(r.path) == len(word) + 1 and r.path[0] == 0
        for d, node in enumerate(r.path):
            assert nodes.setdefault(word[:d], node) == node
    assert len(set(nodes.values())) == len(nodes)


def test_very_long_runs_and_empty(spark):
    long = "abcdefghij" * 700
    rows = [(1, f"{long} {long} {long} {long[:-1]}z {long[:-1]}z {long[:-1]}z {long[1:]} {long[1:]} {long[1:]} {long[1:]} {long[1:]} {long[1:]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answered(spelling.spelling_variants(docs, per_task=1)) == plain(counted(rows, False))
    assert answered(spelling.spelling_variants(docs.filter("false"))) == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = counted(rows, True)
    assert answered(queries.QUERIES["op13_spelling_variants"](spark, sf)) == plain(counts, all_edits(counts))
