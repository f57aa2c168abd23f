"""Row numbers that hold from one scan to the next, however the files are split."""
import pytest
from pyspark.sql import functions as F

from ostinato.llm import ngram_join as nj
from ostinato.llm.storage import drop_rows, with_row_no

SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def split_files(spark):
    """Sets how many bytes of files a task reads, as another number of cores would."""
    before = {name: spark.conf.get(name) for name in SPLITS}

    def split(size):
        for name in SPLITS:
            spark.conf.set(name, size)
    yield split
    for name, value in before.items():
        spark.conf.set(name, value)


def table(spark, tmp_path):
    rows = [(k, " ".join(f"w{k // 2}x{i}" for i in range(60)) + (" end" if k % 2 else ""), None) for k in range(120)]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string, row_no string").repartition(12).write.parquet(path)
    return path


def test_drop_rows_after_another_split(spark, tmp_path, split_files):
    path = table(spark, tmp_path)
    split_files("64m")
    gone = nj.written(with_row_no(spark.read.parquet(path), "doc_id").filter("doc_id % 3 = 0"))
    for size in ("1k", "3k", "64m"):
        split_files(size)
        docs = spark.read.parquet(path)
        left = drop_rows(docs, gone)
        assert left.columns == docs.columns
        assert sorted(r.doc_id for r in left.collect()) == [k for k in range(120) if k % 3]
    with pytest.raises(ValueError):
        drop_rows(docs.filter("doc_id > 3"), gone)


def test_groups_when_the_split_changes_between_scans(spark, tmp_path, split_files, monkeypatch):
    path = table(spark, tmp_path)
    split_files("64m")
    node_rows = nj.node_rows

    def then_other_cores(*args):
        out = node_rows(*args)
        split_files("1k")
        return out
    monkeypatch.setattr(nj, "node_rows", then_other_cores)
    got = nj.similar_groups(spark.read.parquet(path)).select("id", "component_id").collect()
    assert {r.id: r.component_id for r in got} == {k: k - k % 2 for k in range(120)}


def test_numbers_are_distinct(spark, tmp_path):
    path = table(spark, tmp_path)
    for docs in (spark.read.parquet(path), spark.read.parquet(path).withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))):
        numbers = [r.n for r in with_row_no(docs, "doc_id", name="n").collect()]
        assert len(set(numbers)) == len(numbers) == docs.count()
