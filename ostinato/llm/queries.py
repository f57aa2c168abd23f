"""The operators of this subpackage bound to the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import bpe, conversation_repair, exact_dedup, langid, lm, ngram_join, packing, quality_gbt, quality_rules, spelling, token_records, toxicity, warc
from ostinato.llm.batches import bucket_of

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WARC_SQL = """with p as (select page_id, encode(coalesce(html, '')) as body from pages),
 d as (select page_id, octet_length(body) as payload_bytes, sha256(body) as payload_digest from p),
 f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from d)
 select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 100 and first <> page_id then first end as refers_to from f"""


@query("op1_warc_chunks", WARC_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf, "pages")).drop("n_chunks")


RULES_SQL = r"""with t as (select doc_id, source, coalesce(text, '') as text from documents),
 w as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
 c as (select doc_id, source, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, words from w),
 pos as (select doc_id, unnest(generate_series(1, n_words - 2)) as i, words from c where n_words >= 3),
 win as (select doc_id, i, {'a': words[i], 'b': words[i + 1], 'c': words[i + 2]} as v from pos),
 twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, v) as n from win) where n > 1),
 rep as (select doc_id, count(distinct i + k) as n_repeat_words from twice, (values (0), (1), (2)) as s(k) group by doc_id),
 b as (select c.doc_id, source, n_words, word_chars, n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words from c left join rep on c.doc_id = rep.doc_id),
 r as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 100 * n_symbols > 10 * word_chars
  or 100 * n_dup_lines > 30 * n_lines as more_failed from b),
 h as (select source, count(*) as n, count(*) filter (where base_failed or more_failed) as failed from r group by source),
 m as (select sum(failed) / sum(n) as mean, sum(n) as total, count(*) as hosts from h),
 v as (select any_value(mean) as mean, sum(n * (failed / n - mean) ** 2) / any_value(total)
  - any_value(mean * (1 - mean) * hosts / total) as spread from h, m),
 k as (select mean, spread, case when spread > 0 then greatest(1, mean * (1 - mean) / spread - 1) end as strength from v),
 j as (select source, case when spread > 0 then (failed + strength * mean) / (n + strength) else mean end as rate from h, k)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or more_failed) and rate <= 0.5 as kept from r join j on r.source is not distinct from j.source"""


@query("op2_host_rules", RULES_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.host_rules(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_exact_dedup", """with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
 g as (select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size from t)
 select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op6_bpe_merge_rounds")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                             outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def fold_of(modulus: int, own: int):
    """Whether crc32(doc_id as text) leaves `own`; false for a null id."""
    return F.coalesce(bucket_of("doc_id", modulus) == own, F.lit(False))


@query("op4_toxic_sentences")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs, labels.filter(~fold_of(3, 1)))
    return toxicity.score(docs, model).select("doc_id", fold_of(3, 1).alias("held_out"), "score",
                                              (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_sentences", "offending")


@query("op8_language_spans")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.train(docs.filter(~fold_of(5, 0)))
    return langid.identify(docs, model).select("doc_id", fold_of(5, 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op10_quality_trees")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_gbt.train(docs, labels.filter(~fold_of(4, 2)))
    return quality_gbt.score(docs, model).select("doc_id", fold_of(4, 2).alias("held_out"), "score",
                                                 (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_least_squares_packing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_subword_lattice")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    own = F.coalesce(bucket_of("doc_id", 10) != 0, F.lit(True))
    return lm.lm_score(table(spark, sf, "documents"), own, public_tokenizers.path("piece_bpe_32k.model"), class_col="lang").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_prefix_trie_join")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf, "conversations"))


@query("op12_token_records")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return token_records.token_round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"), spoil=True)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
