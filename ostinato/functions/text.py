"""Unicode forms that Spark has no function for, taken over distinct values only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinato.operators.skew import attach, row_count


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


def composer_key(pieces: DataFrame, column: str = "composer", out: str = "composer_key") -> DataFrame:
    """Compatibility form, case folded, white space collapsed; a missing name is an error.

    Computed once per distinct name and joined back.
    """
    names = pieces.groupBy(column).agg(row_count())
    key = _folded(F.col(column))
    blank = F.col(column).isNull() | (F.length(key) == 0)
    keyed = names.withColumn(out, F.when(blank, F.raise_error(F.lit("missing composer")).cast("string")).otherwise(key))
    checked = pieces.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit("missing composer")).cast("string")).otherwise(F.col(column)))
    return attach(checked, keyed, [column])
