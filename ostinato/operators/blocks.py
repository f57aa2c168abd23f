"""Blocks of a dense integer index, with neighbouring rows copied in.

Series rows carry a dense index (frame, window number). Cutting the index into fixed blocks bounds the
rows of a group exactly, however long one series is, and needs no look at the data beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "_block"
CORE = "_core"
DEFAULT_BLOCK = 4096


def with_halo(df: DataFrame, index: str, before: int, after: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Copy each row to the blocks that need it; `_core` marks the one block that owns it."""
    at = F.col(index)
    first = F.greatest(F.lit(0), F.floor((at - after) / block))
    last = F.floor((at + before) / block)
    return (df.withColumn(BLOCK, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
            .withColumn(CORE, F.col(BLOCK) == F.floor(at / block)))
