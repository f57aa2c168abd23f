"""The trained operators: held-out accuracy on the driver's tables, exact parts against plain versions, awkward input."""
import itertools
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from plain import lower, words_of
from pyspark.sql import functions as F

from ostinato.llm import labels, langid, lm, quality_gbt, queries, toxicity

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def auc(pairs):
    pairs = sorted(pairs)
    ranks, total = 0, 0
    for _, same in itertools.groupby(pairs, key=lambda p: p[0]):
        same = list(same)
        ranks += sum(y for _, y in same) * (total + (len(same) + 1) / 2)
        total += len(same)
    pos = sum(y for _, y in pairs)
    return (ranks - pos * (pos + 1) / 2) / (pos * (len(pairs) - pos))


@pytest.mark.parametrize("name, label, least", [("op4_toxic_sentences", "toxic", 0.75), ("op10_quality_trees", "quality", 0.97)])
def test_held_out(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert got.count() == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, r[label]) for r in rows if r.held_out]
    assert auc(held) > least
    clean = [r for r in rows if r.held_out and (r.toxic == 0 if label == "toxic" else r.quality == 1)]
    assert sum(r.predicted == (label == "quality") for r in clean) > 0.95 * len(clean)


def test_language_held_out(spark):
    rows = queries.QUERIES["op8_language_spans"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)


def test_sentences():
    text = "One two. Three!  four\nfive a.b? six"
    s = toxicity.Sentences(pa.array([text, None, "x", "\n.\n"]))
    start, end = s.spans(np.arange(len(s.first)))
    spans = [((text, None, "x", "\n.\n")[r] or "")[a:b] for r, a, b in zip(s.row, start, end)]
    assert spans == ["One two.", "Three!", "four", "five a.b?", "six", "x", "."]
    assert np.diff(s.rows).tolist() == [5, 0, 1, 1]
    assert [s.names[int(c)].as_py() for c in s.code[:3]] == ["one", "two", "three"]


def test_noisy_or_by_hand(spark):
    model = toxicity.Model(["bad", "worse"], np.array([4.0, 6.0]), -5.0)
    sig = lambda z: 1 / (1 + math.exp(-z))
    z = {1: [-5 + 4], 2: [-5 + 10], 3: [], 4: [-5 + 4, -5 + 6]}
    texts = {1: "BAD bad. fine", 2: "worse, bad", 3: None, 4: "bad\nand so\nworse"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for k, own in z.items():                    # one background term a document, and its sentences that hold a model word
        assert got[k] == pytest.approx(1 - (1 - sig(-5)) * math.prod(1 - sig(x) for x in own))


def test_length_alone_is_not_toxic(spark):
    model = toxicity.Model(["bad"], np.array([4.0]), -3.0)
    docs = spark.createDataFrame([(1, "All is well here."), (2, "All is well here. " * 100_000), (3, "All is well here. " * 100_000 + "Bad.")], "doc_id long, text string")
    one, many, last = toxicity.score(docs, model).orderBy("doc_id").collect()
    assert one.score == many.score < 0.1 < last.score and many.n_sentences == 100_000 and [o.sentence for o in last.offending] == [100_000]


def test_fit_agrees_with_a_plain_one():
    rng = np.random.default_rng(9)
    docs = [[rng.random(3) < .4 for _ in range(rng.integers(1, 5))] for _ in range(30)]
    label = np.array([int(any(s[0] for s in d)) for d in docs])
    sentences = [(k, s) for k, d in enumerate(docs) for s in d if s.any()]
    pairs = [(i, w) for i, (_, s) in enumerate(sentences) for w in np.flatnonzero(s)]
    weight = np.where(label == 1, 2.0, 1.0)

    def loss(theta):
        total = np.full(len(docs), np.logaddexp(0, theta[-1]))
        for k, s in sentences:
            total[k] += np.logaddexp(0, theta[-1] + theta[:-1] @ s)
        return (weight * np.where(label == 1, -np.log(-np.expm1(-total)), total)).sum() + 0.01 * ((theta[:-1] - 3) ** 2).sum()
    theta, m, v = np.array([3.0, 3.0, 3.0, -7.0]), 0, 0
    for step in range(1, 41):
        g = np.array([(loss(theta + h) - loss(theta - h)) / 2e-5 for h in np.eye(4) * 1e-5])
        m, v = .9 * m + .1 * g, .99 * v + .01 * g ** 2
        theta = theta - .1 * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .99 ** step)) + 1e-8)
        theta[-1] = min(-2.0, theta[-1])
    bias, w = toxicity.fit_noisy_or(label, np.array([k for k, _ in sentences]), np.array([i for i, _ in pairs]), np.array([x for _, x in pairs]), 3, weight, rounds=40)
    assert np.allclose([*w, bias], theta, atol=1e-3)


def test_toxicity_finds_the_sentence(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        parts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 8)) + "." for _ in range(6)]
        if k % 5 == 0:
            parts[k % 6] = parts[k % 6][:-1] + " vile."
        rows.append((k, "É " + " ".join(parts), int(k % 5 == 0)))
    rows += [(900, None, 1), (900, "", 0), (None, "vile.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5000, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert model.words == ["vile"]
    for r in toxicity.score(docs, model).filter("doc_id < 900").collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        assert (r.score >= 0.7) == (r.doc_id % 5 == 0)
        assert all("vile" in text[o.start:o.end] and text[o.start:o.end].count(".") == 1 for o in r.offending) and len(r.offending) == (r.doc_id % 5 == 0)
    for bad in (marks.filter("toxic = 0"), marks.filter("false"), marks.filter("doc_id = 5000")):
        assert toxicity.score(docs, toxicity.train(docs, bad)).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(docs.filter("false"), model).count() == 0


def test_statistics_and_forest(spark):
    x = quality_gbt.statistics(pa.array([None, "", "A b\nA b\n# |", "é" * 100_000]))
    assert x.shape == (4, len(quality_gbt.NAMES)) and not x[:2].any() and np.isfinite(x).all()
    assert x[2][quality_gbt.NAMES.index("dup_lines")] == 1 / 3
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(int)
    forest = quality_gbt.fit(x, y, np.ones(800), trees=30)

    def walk(row):
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - forest.feature.shape[1]]
        return total
    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])
    fresh = rng.normal(size=(400, 4))
    assert ((forest.predict(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 2] > 0))).mean() > 0.93
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    for rows, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, None), (7, 0)], 0.0)):
        model = quality_gbt.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert abs(quality_gbt.score(docs, model).first().score - want) < 1e-5


def test_class_sample_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as label")
    sample, sizes = labels.class_sample(rows, "label", "doc_id", 500)
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    assert sizes == {0: 18_000, 1: 2_000} and all(400 < v < 600 for v in n.values())


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(0, 3, (6, 3))
    length = [0, 4, 1, 6, 0, 3]
    code = rng.integers(0, 6, sum(length))
    rows = np.concatenate(([0], np.cumsum(length)))
    path = langid.viterbi(scores, code, rows, 2.0)
    value = lambda p, c: sum(scores[w, k] for w, k in zip(c, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    for a, b in zip(rows, rows[1:]):
        if b > a:
            best = max(value(p, code[a:b]) for p in itertools.product(range(3), repeat=int(b - a)))
            assert math.isclose(value(path[a:b].tolist(), code[a:b]), best)


def test_mixed_text_and_scripts(spark):
    rows = [(k, "the cat sat on the mat and then went home with that hat", "en") for k in range(20)]
    rows += [(100 + k, "кошка сидела на ковре и потом ушла домой", "ru") for k in range(20)]
    rows += [(200 + k, "der hund lief schnell durch den wald und schlief dann", "de") for k in range(20)]
    rows += [(300, None, "en"), (301, "123 !!", "en"), (302, "x", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, "the cat went home and sat on the mat кошка ушла домой и потом der hund schlief dann im wald und lief"),
                                   (2, None), (3, "12 34"), (4, "кошка"), (None, "the mat")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    assert [(s.start, s.end, s.lang) for s in got[1].spans] == [(0, 9, "en"), (9, 14, "ru"), (14, 22, "de")]
    assert (got[2].lang_pred, got[2].score, got[3].lang_pred) == ("und", 0.0, "und")
    assert got[4].lang_pred == "ru" and got[None].lang_pred == "en" and 0 < got[1].score < 1
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(mixed, none).collect()} == {"und"}


def all_ways(text, price):
    if not text:
        return 1.0
    return sum(price[text[:k]] * all_ways(text[k:], price) for k in range(1, len(text) + 1) if text[:k] in price)


def test_lattice():
    table = lm.pieces(PIECES)
    logp = np.log(table.start)
    price = dict(zip(table.names, table.start))
    words = ["the", "nation", "a", "reading", "station"]
    lattice = lm.Lattice(words, table)
    got = lattice.marginal(logp)
    for word, value in zip(words, got):
        assert math.isclose(math.exp(value), all_ways("▁" + word, price), rel_tol=1e-9)
    # expected uses: the derivative of the log probability by the log of a piece's probability
    n = lattice.expected(logp, len(table.names))
    for k in (table.names.index("▁the"), table.names.index("ing"), table.names.index("a")):
        up = logp.copy()
        up[k] += 1e-5
        assert abs((lattice.marginal(up).sum() - got.sum()) / 1e-5 - n[k]) < 1e-3
    assert np.isfinite(lm.Lattice(["\U0010FFFF▁x" * 50, "a" * 3000], table).marginal(logp)).all()


def test_log_gamma(spark):
    x = np.array([1e-6, 0.003, 0.5, 1.0, 7.7, 120.0, 1e7])
    want = [math.lgamma(v) for v in x]
    assert np.allclose(lm.lgamma(x), want, rtol=1e-10, atol=1e-10)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(lm.lgamma_column(F.col("x"))).collect()]
    assert np.allclose(got, want, rtol=1e-10, atol=1e-10)
    p, times = np.array([[0.2, 0.001], [0.5, 0.3]]), np.array([1, 4])
    assert np.allclose(lm.rising(p, times), [[sum(math.log(lm.BURST * q + k) for k in range(n)) for q in row] for row, n in zip(p, times)])


def test_score_is_the_chain_of_words(spark):
    """With one learnt class and no rare words left out, the score is the product of the word probabilities in order."""
    text = "b a b b"
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "b c", "x"), (4, text, None)], "doc_id long, text string, lang string")
    own = F.col("doc_id") != 4
    scores = {head: {r.doc_id: r.score for r in lm.lm_score(docs, own, PIECES, class_col="lang", head=head, rounds=0).collect()} for head in (0, 100)}
    assert all(math.isclose(scores[0][d], scores[100][d], rel_tol=1e-9) for d in (1, 2, 4))
    table = lm.pieces(PIECES)
    g = dict(zip("abc", (1 - lm.END_SHARE) * np.exp(lm.Lattice(list("abc"), table).marginal(np.log(table.start)))), **{" ": lm.END_SHARE})
    counts = {"a": 1, "b": 2, "c": 1, " ": 2}
    found = []
    for d in lm.DISCOUNTS:
        for t in lm.STRENGTHS:
            plain = {w: (max(c - d, 0) + (t + d * 4) * g[w]) / (6 + t) for w, c in counts.items()}
            price = {w: lm.OWN * counts[w] / 6 + (1 - lm.OWN) * plain[w] for w in counts}
            total, seen = 0.0, []
            for w in [*text.split(), " "]:
                total += math.log10((seen.count(w) + lm.BURST * price[w]) / (lm.BURST + len(seen)))
                seen.append(w)
            found.append(total)
    assert min(abs(x - scores[0][4]) for x in found) < 1e-9


def longhand(docs, text):
    """Scores of a text under learning texts [(text, class)], one for each discount and strength, summed over the classes in log space."""
    own = [(words_of(t) + [" "], k) for t, k in docs]
    every = [w for t, _ in own for w in t]
    kinds = {k: sum(c == k for _, c in own) for _, k in own}
    price = [*text.split(), " "]
    table = lm.pieces(PIECES)
    words = sorted(set(price) - {" "})
    g = dict(zip(words, math.log(1 - lm.END_SHARE) + lm.Lattice(words, table).marginal(np.log(table.start)))) | {" ": math.log(lm.END_SHARE)}
    ln = lambda x: math.log(x) if x > 0 else -math.inf
    for d in lm.DISCOUNTS:
        for t in lm.STRENGTHS:
            ways = []
            for k, n in kinds.items():
                mine = [w for words, c in own if c == k for w in words]
                total, seen = math.log((n + 1) / (len(own) + len(kinds))), []
                for w in price:
                    plain = np.logaddexp(ln(max(every.count(w) - d, 0)), math.log(t + d * len(set(every))) + g[w]) - math.log(len(every) + t)
                    p = np.logaddexp(ln(lm.OWN * mine.count(w) / len(mine)), math.log(1 - lm.OWN) + plain)
                    total += np.logaddexp(ln(seen.count(w)), math.log(lm.BURST) + p) - math.log(lm.BURST + len(seen))
                    seen.append(w)
                ways.append(total)
            yield np.logaddexp.reduce(ways) / math.log(10)


def test_long_unseen_words_cost_what_they_hold(spark):
    """Words whose probability is below the smallest double, once and repeated, with the words of the head and without."""
    rng = np.random.default_rng(5)
    long = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), n)) for n in (3000, 4000)]
    learn = [("a b", "x"), ("b c", "x")]
    texts = {10: long[0], 11: f"a {long[1]} b {long[1]} {long[1]}"}
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(learn)] + [(k, t, None) for k, t in texts.items()], "doc_id long, text string, lang string")
    for head in (0, 100):
        got = {r.doc_id: r.score for r in lm.lm_score(docs, F.col("doc_id") < 10, PIECES, class_col="lang", head=head, rounds=0).collect()}
        assert got[10] < -2000 and got[11] < got[10]
        assert all(min(abs(x - got[k]) for x in longhand(learn, t)) < 1e-6 for k, t in texts.items())


@pytest.mark.parametrize("head", [0, 100])
def test_every_class_has_counts(spark, head):
    """Twelve classes of falling size and unlabelled texts: a text of each is scored with that class's own counts."""
    learn = [(f"k{k} l{k} both", f"lang{k}") for k in range(12) for _ in range(13 - k)] + [("u v both", None)] * 2
    texts = {100 + k: f"k{k} both l{k}" for k in range(12)} | {112: "u both v u"}
    rows = [(k, *r) for k, r in enumerate(learn)] + [(k, t, None) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in lm.lm_score(docs, F.col("doc_id") < 100, PIECES, class_col="lang", head=head, rounds=0).collect()}
    want = {k: list(longhand(learn, t)) for k, t in texts.items()}
    assert min(max(abs(x - got[k]) for x, k in zip(trial, texts)) for trial in zip(*(want[k] for k in texts))) < 1e-9


@pytest.mark.parametrize("head", [0, 300_000])
def test_lm_score(spark, head):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice(["the", "The", "cat", "sat", "on", "é", "mat\n"], rng.integers(0, 30)))) for k in range(60)]
    rows += [(100, None), (101, "unseen words"), (101, "unseen words"), (None, "the cat"), (103, "the " * 5000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    learn = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True)) & (F.coalesce("doc_id", F.lit(0)) != 101)
    got = lm.lm_score(docs, learn, PIECES, head=head, rounds=1).collect()
    own = [words_of(lower(t)) + [" "] for d, t in rows if d is None or d % 4 != 0 and d != 101]
    counts = {}
    for text in own:
        for w in text:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))
                   for d, t in rows for w in [words_of(lower(t)) + [" "]]), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.lm_score(docs.filter("false"), learn, PIECES).count() == 0
    with_class = docs.withColumn("lang", F.when(F.col("doc_id") < 50, F.concat(F.lit("l"), F.col("doc_id") % 12)))
    more = lm.lm_score(with_class, learn, PIECES, class_col="lang", head=head, rounds=1).collect()
    assert len(more) == len(rows) and all(r.score < 0 and math.isfinite(r.score) for r in more)
    assert all(math.isfinite(r.score) for r in lm.lm_score(docs, F.lit(False), PIECES, rounds=1).collect())
