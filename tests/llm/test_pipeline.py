"""The pipeline against a plain version of its stages, stage contracts, and awkward input."""
import itertools
import sys

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.llm import quality_rules, toxicity
from ostinato.llm.storage import written
from plain import base_counts, groups_of, lower, near_groups

SF = "/root/testdata/sf0.001"


def host_verdicts(rows):
    """Plain version of the host rules: id -> kept."""
    failed = {}
    for r in rows:
        c = base_counts(r.text)
        failed[r.doc_id] = (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] or 100 * c["n_symbols"] > 10 * c["word_chars"]
                            or 100 * c["n_dup_lines"] > 30 * c["n_lines"])
    hosts = {}
    for r in rows:
        hosts.setdefault(r.source, []).append(failed[r.doc_id])
    n = len(rows)
    mean = sum(failed.values()) / n
    spread = sum(len(h) * (sum(h) / len(h) - mean) ** 2 for h in hosts.values()) / n - mean * (1 - mean) * len(hosts) / n
    strength = max(1.0, mean * (1 - mean) / spread - 1) if spread > 0 else None
    rate = {k: mean if strength is None else (sum(h) + strength * mean) / (len(h) + strength) for k, h in hosts.items()}
    return {r.doc_id: not failed[r.doc_id] and rate[r.source] <= 0.5 for r in rows}


def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    after = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = written(stage(spark, current, SF))
        after[name] = current
    kept = host_verdicts(rows)
    rows = [r for r in rows if kept[r.doc_id]]
    assert {r.doc_id for r in after["quality rules"].collect()} == {r.doc_id for r in rows}
    # the model is the operator's own; what the stage does with its scores is checked
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(after["quality rules"], labels.filter("crc32(cast(doc_id as string)) % 3 != 1"))
    bad = {r.doc_id for r in toxicity.score(after["quality rules"], model).filter("score >= 0.7").collect()}
    rows = [r for r in rows if r.doc_id not in bad]
    assert {r.doc_id for r in after["toxicity"].collect()} == {r.doc_id for r in rows}
    best = {}
    for r in rows:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    rows = [r for r in rows if best[lower(r.text)] == r.doc_id]
    assert {r.doc_id for r in after["exact dedup"].collect()} == {r.doc_id for r in rows}
    group = near_groups({r.doc_id: r.text for r in rows})
    left = {d for d, g in group.items() if d == g}
    near = after["n-gram Jaccard join"]
    assert {r.doc_id for r in near.collect()} == left
    assert near.schema == docs.schema and near.exceptAll(docs).isEmpty()
    pieces = after["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == left and all(r.n == r["all"] for r in pieces)


def test_stages_keep_columns_and_take_awkward_rows(spark, tmp_path):
    rows = [(None, None, None, None, 1), (1, "", "en", "a", 2), (1, "", "en", "a", 2), (2, "word " * 4000, "en", None, 3)]
    rows += [(10 + i, " ".join(f"token{i}x{k}" for k in range(80)), "en", "a", 4) for i in range(6)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string, source string, row_no int")
    spark.createDataFrame([(1, None, None), (None, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (frame, frame.filter("false")):
        docs = written(docs)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, str(tmp_path)))
            assert out.columns == frame.columns, name
            docs = out
        assert docs.filter("doc_id >= 10").count() == (6 if docs.count() else 0)
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "exact dedup", "n-gram Jaccard join", "packing"]
    assert "ostinato.llm" in sys.modules and quality_rules.HOST_LIMIT == 0.5


def test_near_stage_takes_five_words_and_four_fifths(spark):
    """Pairs that five-word shingles link at 0.8 and four-word shingles at 0.85 do not, against all pairs."""
    rng = np.random.default_rng(3)

    def similar(a, b, size=5, percent=80):
        a, b = ({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
        return 100 * len(a & b) >= percent * len(a | b)

    texts = []
    for every in (40, 44, 46, 48, 60) * 4:
        base = [f"w{x}" for x in rng.integers(0, 9000, 480)]
        texts += [" ".join(base), " ".join(f"x{k}" if k % every == every // 2 else w for k, w in enumerate(base))]
    for extra in (80, 100, 118, 125):
        base = [f"w{x}" for x in rng.integers(0, 9000, 480)]
        texts += [" ".join(base), " ".join(base[:200] + [f"y{x}" for x in rng.integers(0, 9000, extra)] + base[200:])]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(texts[a], texts[b])]
    assert any(not similar(texts[a], texts[b], 4, 85) for a, b in pairs) and len(pairs) < len(texts) // 2
    group = groups_of(pairs, range(len(texts)))
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == {d for d, g in group.items() if d == g}
