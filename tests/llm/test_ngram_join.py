"""N-gram join against all pairs, trie against set arithmetic, components against a union of sets."""
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from ostinato.llm import ngram_join as nj
from ostinato.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)}


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return {k: len(s) for k, s in sets.items()}, groups_of(pairs, sets)


def family(rng, n, length, edits):
    base = [f"w{rng.integers(5000)}" for _ in range(length)]
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, length, edits):
            own[at] = f"x{rng.integers(10000)}"
        yield " ".join(own)


def corpus(seed):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 120))) for _ in range(120)]
    texts += [passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 9999, 90)) for _ in range(40)]
    for length, edits in ((30, 1), (60, 1), (60, 2), (120, 3), (200, 4), (300, 6), (8, 1), (100, 4)):
        texts += family(rng, 12, length, edits)
    texts += [None, "", "  \n", "one", "One", "one two three", "ONE two  three", "one two three four", "a a a a a a a a a", "a a a a a"]
    texts += ["copy " * 3 + passage] * 30 + list(family(rng, 80, 150, 2))
    return dict(enumerate(rng.permutation(np.array(texts, object)).tolist()))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed, monkeypatch):
    texts = corpus(seed)
    if seed == 2:
        monkeypatch.setattr(nj, "BLOCK", 5)
        monkeypatch.setattr(nj, "SEND_TEXTS", 0)
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, node int").repartition(3)
    path = nj.written(docs)
    got = {r.id: r for r in nj.similar_groups(path).collect()}
    n, group = brute(texts)
    assert {k: r.n_shingles for k, r in got.items()} == n
    assert {k: r.component_id for k, r in got.items()} == group
    kept = nj.near_dedup(path)
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, None), (9, "")]
    docs = nj.written(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in nj.similar_groups(docs).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None), (9, 0, 9)], key=str)
    assert nj.near_dedup(docs).count() == 3


def test_empty(spark):
    docs = nj.written(spark.createDataFrame([], "doc_id long, text string"))
    assert nj.similar_groups(docs).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_trie(seed):
    rng = np.random.default_rng(seed)
    probe = np.unique(rng.integers(0, 400, 60).astype(np.uint64))
    sets = []
    for _ in range(40):
        own = set(probe.tolist())
        for x in rng.choice(probe, rng.integers(0, 12), replace=False):
            own.discard(int(x))
        own |= set(rng.integers(0, 400, rng.integers(0, 8)).tolist())
        sets.append(np.array(sorted(own), np.uint64))
    sets += [np.unique(rng.integers(0, 400, rng.integers(1, 80)).astype(np.uint64)) for _ in range(40)] + [probe, probe]
    for percent in (85, 50, 99):
        want = [k for k, s in enumerate(sets) if 100 * len(set(s.tolist()) & set(probe.tolist())) >= percent * len(set(s.tolist()) | set(probe.tolist()))]
        assert sorted(nj.trie_matches(probe, sets, percent)) == want


def test_shingle_sets():
    texts = ["A b\tc d a B c d", "x", "", None, "é É é É é"]
    assert [len(s) for s in nj.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == groups_of([p for p in pairs if p[0] != p[1]], nodes)


@pytest.mark.parametrize("seed", range(10))
def test_prefixes_meet(seed):
    """Every similar pair shares COMMON of the smaller's short and the larger's long prefix, or all it shares."""
    rng = np.random.default_rng(seed)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = set(rng.choice(2000, n, replace=False).tolist())
        y = set(x)
        for k in rng.choice(sorted(x), min(n, int(rng.integers(0, 1 + n // 6))), replace=False):
            y.discard(int(k))
        y |= {int(k) for k in rng.integers(0, 2000, rng.integers(0, 1 + n // 8))}
        if not y or 100 * len(x & y) < 85 * len(x | y):
            continue
        small, large = sorted((sorted(x), sorted(y)), key=len)
        met = set(small[:nj.short_length(len(small))]) & set(large[:nj.prefix_length(len(large))])
        assert len(met) >= min(nj.COMMON, len(x & y))


def test_words_that_a_polynomial_hash_takes_for_one(spark, tmp_path):
    """The Thue-Morse word of 1,024 letters and its complement agree in every polynomial with an odd base modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    docs = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {r.id: r.component_id for r in nj.similar_groups(docs).collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("form", ["filter", "view", "union", "json", "created"])
def test_any_kind_of_table(spark, tmp_path, form):
    from ostinato.llm import exact_dedup
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 0), (2, text + " end", 0), (3, "other", 0), (4, "OTHER", 0)]
    made = spark.createDataFrame(rows, "doc_id long, text string, row_no int")
    made.write.parquet(f"{tmp_path}/p")
    made.write.json(f"{tmp_path}/j")
    stored = spark.read.parquet(f"{tmp_path}/p")
    stored.createOrReplaceTempView("some_docs")
    docs = {"filter": stored.filter("doc_id < 9"), "view": spark.table("some_docs"), "union": stored.filter("doc_id < 3").union(stored.filter("doc_id > 2")),
            "json": spark.read.schema(made.schema).json(f"{tmp_path}/j"), "created": made}[form]
    assert sorted(r.doc_id for r in nj.near_dedup(docs).collect()) == [1, 3]
    assert nj.near_dedup(docs).columns == docs.columns
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == [1, 2, 4]


@pytest.mark.parametrize("seed", range(4))
def test_tiles_lose_no_similar_pair(seed):
    rng = np.random.default_rng(seed)
    sets, labels = [], []
    for base in range(6):
        core = rng.integers(0, 2 ** 63, rng.choice([3, 16, 40, 200, 900])).astype(np.uint64)
        for _ in range(8):
            own = rng.random(len(core)) > rng.choice([0, .02, .1])
            sets.append(np.unique(np.concatenate((core[own], rng.integers(0, 2 ** 63, rng.integers(0, 1 + len(core) // 12)).astype(np.uint64)))))
            labels.append(int(rng.integers(0, 3)))
    sets = [s if len(s) else np.array([k], np.uint64) for k, s in enumerate(sets)]
    half = [k % 2 for k in range(len(sets))]
    for percent in (85, 80):
        for crossing in (False, True):
            tile = nj.Tile(crossing)
            rows = pa.RecordBatch.from_pydict({
                "node": pa.array(range(len(sets))), "n": pa.array([len(s) for s in sets]), "label": pa.array(labels),
                "own": pa.array(half if crossing else [0] * len(sets)), "bits": pa.array([nj.bitmap(s) for s in sets], pa.binary())})
            tile.add(rows.slice(0, 20))
            tile.add(rows.slice(20))
            keys = np.repeat([5, 9], len(sets))              # all sets meet in two keys; the rows of a key come in several parts
            for part in np.array_split(np.arange(len(keys)), 5):
                tile.meet(keys[part], part % len(sets), np.ones(len(part), bool))
            pairs = tile.matches(percent)
            assert set(pairs.column("shared").to_pylist()) == {2}
            got = set(zip(*(pairs.column(c).to_pylist() for c in "ab")))
            assert len(got) == pairs.num_rows
            for a, b in itertools.combinations(range(len(sets)), 2):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                allowed = labels[a] != labels[b] and (not crossing or half[a] != half[b])
                assert not (100 * len(x & y) >= percent * len(x | y) and allowed) or (a, b) in got
                assert allowed or (a, b) not in got
            assert len(got) < len(sets) ** 2 / 6


def test_a_family_just_below_the_threshold_sends_few_pairs(spark, monkeypatch):
    """Texts of 200 words with 8 changed: all share n-grams, none are similar; the pairs whose texts are fetched do not grow with the square."""
    seen, own = [], nj.crossing_pairs

    def counted(*args):
        out = own(*args)
        seen.append(out.count())
        return out
    monkeypatch.setattr(nj, "crossing_pairs", counted)
    monkeypatch.setattr(nj, "TILE", 50)
    for n in (100, 200):
        texts = dict(enumerate(family(np.random.default_rng(7), n, 200, 8)))
        docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
        got = {r.id: r.component_id for r in nj.similar_groups(docs).collect()}
        assert got == brute(texts)[1]
    assert seen[1] <= 3 * seen[0] + 20 and seen[1] < 200


def test_sets_with_one_number_are_numbered_again(spark, monkeypatch):
    own = nj.node_of
    monkeypatch.setattr(nj, "node_of", lambda s, seed=0: 7 if seed == 0 and len(s) else own(s, seed))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, None)], "doc_id long, text string")
    rows, seed = nj.node_rows(nj.numbered(docs, "doc_id", "text"))
    assert seed == 1 and rows.select("node").distinct().count() == 3
