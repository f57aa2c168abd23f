"""A training-data pipeline over `documents`: quality rules, toxicity, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. Its result is
written as Parquet and read again as the next stage's `docs`. All stages but the last keep the columns of
`docs`, whatever they are, in their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import exact_dedup, ngram_join, packing, quality_rules, toxicity
from ostinato.llm.batches import bucket_of
from ostinato.llm.storage import drop_rows, with_row_no, written

TOXIC = 0.7
NEAR_WORDS, NEAR_PERCENT = 5, 80      # word shingles of the near-duplicate stage; op9 has a contract of its own


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rows(docs, quality_rules.host_rules(docs).filter("not kept"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False))))
    numbered = with_row_no(docs, "doc_id", "text")
    return drop_rows(docs, toxicity.score(numbered, model, keep=("row_no",)).filter(F.col("score") >= TOXIC))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_dedup(docs, percent=NEAR_PERCENT, size=NEAR_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", rules), ("toxicity", toxic), ("exact dedup", exact), ("n-gram Jaccard join", near), ("packing", pack)]

# The trained scores of the toxicity stage have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
