"""Runs over a growing folder against one run over all of it."""
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ostinato.streaming import incremental

SCHEMA = "id string, t double, value double"
RESULT = "id string, second long, value double"


def strengths(df):
    return df.filter("value is not null").select("id", F.floor("t").alias("second"), F.abs("value").alias("value"))


def put(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


FIRST = [("a", 0.5, -1.0), ("a", 1.5, 2.0), ("b", 0.2, None), ("c", 3.0, 4.0)]
SECOND = [("d", 9.0, -9.0), ("b", 2.0, 5.0)]


def test_two_runs_equal_one(spark, tmp_path):
    source, once, twice = (str(tmp_path / n) for n in ("in", "once", "twice"))
    put(spark, source, FIRST)
    incremental.take_new(spark, source, SCHEMA, strengths, twice)
    assert incremental.taken(spark, twice, RESULT).count() == 3
    incremental.take_new(spark, source, SCHEMA, strengths, twice)          # nothing new
    assert incremental.taken(spark, twice, RESULT).count() == 3
    put(spark, source, SECOND)
    incremental.take_new(spark, source, SCHEMA, strengths, twice)
    incremental.take_new(spark, source, SCHEMA, strengths, once)
    got = [rows(incremental.taken(spark, t, RESULT), "id", "second") for t in (once, twice)]
    assert got[0] == got[1] == sorted((i, int(t), abs(v)) for i, t, v in FIRST + SECOND if v is not None)
    assert rows(incremental.index_of(incremental.taken(spark, twice, RESULT)), "id") == [("a", 2), ("b", 1), ("c", 1), ("d", 1)]


def test_forced_keys_replace_their_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, FIRST)
    incremental.take_new(spark, source, SCHEMA, strengths, target)
    doubled = lambda df: strengths(df).withColumn("value", F.col("value") * 2)
    keys = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    incremental.make_again(spark, source, SCHEMA, doubled, target, keys, 1)
    assert rows(incremental.taken(spark, target, RESULT), "id", "second") == [("a", 0, 2.0), ("a", 1, 4.0), ("c", 3, 4.0)]
    gone = lambda df: strengths(df).filter("second > 0")
    incremental.make_again(spark, source, SCHEMA, gone, target, keys, 2)
    assert rows(incremental.taken(spark, target, RESULT), "id", "second") == [("a", 1, 2.0), ("c", 3, 4.0)]
    with pytest.raises(Exception, match="(?i)exists"):
        incremental.make_again(spark, source, SCHEMA, gone, target, keys, 2)
