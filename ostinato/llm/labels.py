"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 8_000
SLOTS = 1 << 30


def class_sample(rows: DataFrame, label: str, key: str, per_class: int = PER_CLASS) -> tuple[DataFrame, dict]:
    """About `per_class` rows of each class, by a hash of the key, and the rows that each class has.

    Every class is counted whole; a row stays if its hash lies in the class's share of the hash range. Null
    labels are left out.
    """
    sizes = {r[0]: r[1] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1))).collect()}
    share: Column = F.lit(-1)
    for name, n in sizes.items():
        share = F.when(F.col(label) == F.lit(name), F.lit(int(SLOTS * min(1.0, per_class / n)))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(SLOTS)) < share), sizes


def one_label(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label): one row per id; of repeated labels the larger counts."""
    return labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
