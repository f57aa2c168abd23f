"""Host-level quality rules: failures by host, rates shrunk with an empirical beta prior, verdicts joined back.

A document fails a rule on its own counts. The failures are summed by host; the rate of each host is shrunk
towards the rate of all hosts with a beta prior whose strength is fitted to the spread between hosts by
moments, so a host with a few documents is not judged by them alone. Documents of a host whose shrunk rate
passes `host_limit` go, and so do documents that fail a rule themselves.

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of its own;
texts may be of any length; repeated rows are counted and answered each; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.batches import map_texts
from ostinato.llm.storage import with_row_no, written
from ostinato.llm.text_stats import base_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# rule -> failure, in whole numbers so that every engine decides alike
RULES = {
    "base_failed": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols_failed": "100 * n_symbols > 10 * word_chars",
    "lines_failed": "100 * n_dup_lines > 30 * n_lines",
}
HOST_LIMIT = 0.5


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every whole text, beside the id and the columns in `keep`."""
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        found = base_counts(batch.column(text_col))
        return {n: batch.column(n) for n in (id_col, *keep)} | {n: pa.array(found[n], pa.int64()) for n in COUNTS}

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in (id_col, *keep)), *(f"{n} long" for n in COUNTS)])
    return map_texts(docs.select(id_col, text_col, *keep), run, schema, text_col)


def shrunk_rates(hosts: DataFrame) -> DataFrame:
    """hosts(host, n, failed) with `rate`: (failed + s * mean) / (n + s), s the strength of the beta prior.

    By moments: with the mean m of all documents and the spread v of host rates about it, weighted by documents,
    less the m (1 - m) hosts / documents that chance alone would give, s = m (1 - m) / v - 1, at least 1.
    Without any spread every host gets the mean.
    """
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count(F.lit(1)).alias("h")).first()
    if not total["n"]:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = total["f"] / total["n"]
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.lit(mean), 2)).alias("v")).first()["v"] / total["n"]
    spread -= mean * (1 - mean) * total["h"] / total["n"]
    if spread <= 0:
        return hosts.withColumn("rate", F.lit(mean))
    strength = max(1.0, mean * (1 - mean) / spread - 1)
    return hosts.withColumn("rate", (F.col("failed") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength)))


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               host_limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, rule failures, the host's shrunk failure rate and `kept` for every row; row_no numbers the rows of `docs`.

    Texts are read once; what follows works on written counts. Host sums are partial sums, and the host table
    is written before the join, so a host with a third of all rows is split by Spark.
    """
    numbered = with_row_no(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    found = written(counts(numbered, "id", "text", ("host", "row_no")).selectExpr("*", *(f"{rule} as {name}" for name, rule in RULES.items())))
    failed = F.expr(" or ".join(RULES))
    hosts = written(found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failed")))
    verdict = written(shrunk_rates(hosts)).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    return (found.join(verdict, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
            .withColumn("host_failed", F.col("host_rate") > host_limit)
            .withColumn("kept", ~failed & ~F.col("host_failed")))
