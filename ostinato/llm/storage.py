"""Written steps of longer jobs, and rows taken out of a table by number."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.session import forget, settled, shared_folder

# A table written once to the folder that the cluster shares and read back: short lineage that survives lost
# executors. It stays until `dropped` or `ostinato.session.release_steps`.
written = settled


def step_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def dropped(*tables: DataFrame) -> None:
    """Delete steps whose rows have been used."""
    for df in tables:
        forget(df)


ROW_BITS = 40                 # of a row number, for the row within its file


def as_read(docs: DataFrame) -> bool:
    """Whether `docs` is a table of Parquet files without any step after its reading, so that rows have places in files."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return False
    return "row_index" in docs.select(docs.metadataColumn("_metadata").alias("m")).schema["m"].dataType.names


def as_table(docs: DataFrame) -> DataFrame:
    """`docs` where it is a table as read, else its rows written once: the one form in which rows are numbered alike in every scan."""
    return docs if as_read(docs) else written(docs)


def with_row_no(docs: DataFrame, *columns: Column | str, name: str = "row_no") -> DataFrame:
    """`columns` of `docs` and a number for each row.

    Of a table as read the number is the place of the row's file among the table's files, by path, and of the row in
    the file, so every scan gives the same numbers however it splits the files. The rows of other tables are numbered
    as they come; those numbers hold within one job.
    """
    if not as_read(docs):
        return docs.select(*columns, F.monotonically_increasing_id().alias(name))
    path, row, known, place = (f"_{uuid.uuid4().hex}" for _ in range(4))
    source = docs.metadataColumn("_metadata")
    files = sorted(r[0] for r in docs.select(source["file_path"]).distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), f"{known} string, {place} long")
    rows = docs.select(*columns, source["file_path"].alias(path), source["row_index"].alias(row))
    return (rows.join(F.broadcast(numbers), F.col(path) == F.col(known))
            .withColumn(name, F.shiftleft(place, ROW_BITS) + F.col(row)).drop(path, row, known, place))


def drop_rows(docs: DataFrame, gone: DataFrame, row_no: str = "row_no") -> DataFrame:
    """`docs`, an `as_table`, without the rows whose numbers (`with_row_no`) are in `gone`.

    The names used for the join are new, so no column of `docs` clashes.
    """
    if not as_read(docs):
        raise ValueError("rows are dropped by number from a table as read; give it as as_table(docs)")
    own, other = (f"_{uuid.uuid4().hex}" for _ in range(2))
    return with_row_no(docs, "*", name=own).join(gone.select(F.col(row_no).alias(other)), F.col(own) == F.col(other), "left_anti").drop(own)
