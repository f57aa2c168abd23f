"""Exact duplicates by a tree merge of digest runs, with DataFrame functions only.

The digests of the rows form runs by the partition that made them. In each round `fan_in` neighbouring runs
are dealt out by digest, sorted and merged into one; of equal digests the merge keeps the row that stays and
the number of rows. A digest meets at most `fan_in` rows of itself in a round, however many copies it has,
because every run holds it once. Texts are equal only if SHA-256, length and a second hash all agree.

Defined cases: null is the empty text; exactly one row of equal texts stays, also where ids repeat or are
null (a null id is the smallest); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.storage import as_table, drop_rows, with_row_no, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS, FAN_IN = 64, 8
SAME = ["digest", "size", "check"]


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_no, id, digest, size, check, run) of every row, written once."""
    text = fold_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return written(with_row_no(docs, F.col(id_col).alias("id"), text.alias("text"), F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"))
                   .select("row_no", "id", "run", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"),
                           F.xxhash64("text").alias("check")))


def merged(rows: DataFrame, keep: str = "max") -> DataFrame:
    """One row for each distinct text: keep.id, keep.row_no and n, by merging the runs in rounds."""
    best = F.max if keep == "max" else F.min
    runs = rows.groupBy("run", *SAME).agg(best(F.struct("id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("n"))
    left = RUNS
    while left > 1:
        left = -(-left // FAN_IN)
        runs = (runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")).repartition("run", "digest")
                .sortWithinPartitions("run", *SAME).groupBy("run", *SAME).agg(best("keep").alias("keep"), F.sum("n").alias("n")))
    return runs.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Each row with its group: row_no, id, keep_id, group_size, kept, text_sha256.

    Only texts that occur more than once are joined back. They are written first, so the join has a plain
    shuffle on both sides and Spark splits the rows of a text with very many copies.
    """
    rows = digests(docs, id_col, text_col)
    again = written(merged(rows, keep).filter("n > 1").select(*SAME, "keep.id", "keep.row_no", "n")
                    .withColumnsRenamed({"id": "first_id", "row_no": "first_row"}))
    return rows.join(again, SAME, "left").select(
        "row_no", "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first_row") == F.col("row_no"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = as_table(docs)
    return drop_rows(docs, exact_groups(docs, id_col, text_col, keep).filter("not kept"))
