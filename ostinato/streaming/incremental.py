"""Extraction that goes on where it stopped: a file stream over a growing folder, with keys that are made again on demand.

New files are taken in by a stream with a checkpoint, which ends when it has caught up; its file sink lists what is
committed, so files of a broken run are never read and nothing is computed twice. Keys that are forced are computed again from all source files
into a numbered generation of their own, which replaces their earlier rows when the result is read. Both paths have to be
in storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENERATION = "generation"


def _stream_of(spark: SparkSession, source: str, schema: T.StructType | str) -> DataFrame:
    """The files of a folder as a stream; of a single file, that file of its folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(source)


def take_new(spark: SparkSession, source: str, schema: T.StructType | str, compute: Callable[[DataFrame], DataFrame], target: str) -> None:
    """Compute the rows of all source files that no earlier call has seen and add them to `target`.

    `compute` works row by row on the source (no aggregation over files), keeps the key in `id`, and is the same in every call.
    """
    rows = compute(_stream_of(spark, source, schema))
    stream = (rows.writeStream.format("parquet").outputMode("append").option("path", f"{target}/rows")
              .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start())
    stream.awaitTermination()


def make_again(spark: SparkSession, source: str, schema: T.StructType | str, compute: Callable[[DataFrame], DataFrame], target: str,
               keys: DataFrame, generation: int) -> None:
    """Compute the rows of `keys`(id) again from all source files, as `generation` (1, 2, ...); never overwrites."""
    wanted = keys.select("id").distinct()
    rows = compute(spark.read.schema(schema).parquet(source)).join(wanted, "id", "left_semi")
    path = f"{target}/again/{GENERATION}={generation}"
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    wanted.write.mode("errorifexists").parquet(f"{path}/keys")      # written last: without it the generation does not count


def _folders(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in system.listStatus(place)] if system.exists(place) else []


def taken(spark: SparkSession, target: str, result: T.StructType | str) -> DataFrame:
    """All rows extracted so far, of each key the last generation. `result` is the schema of the rows."""
    rows = spark.read.schema(result).parquet(f"{target}/rows")
    done = [f for f in _folders(spark, f"{target}/again") if _folders(spark, f"{f}/keys/_SUCCESS")]
    if not done:
        return rows
    number = F.regexp_extract(F.col("_metadata.file_path"), f"/{GENERATION}=([0-9]+)/", 1).cast("int")
    again = spark.read.schema(result).parquet(*[f"{f}/rows" for f in done]).select("*", number.alias(GENERATION))
    keys = spark.read.parquet(*[f"{f}/keys" for f in done]).select("id", number.alias(GENERATION)).groupBy("id").agg(F.max(GENERATION).alias(GENERATION))
    return rows.join(keys, "id", "left_anti").unionByName(again.join(keys, ["id", GENERATION], "left_semi").drop(GENERATION))


def index_of(rows: DataFrame) -> DataFrame:
    """The index, rebuilt from what was written: id, length."""
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("length"))
