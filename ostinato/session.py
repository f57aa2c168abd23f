"""Session settings shared by the library, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Rows that one task may hold for one key. Keys with more rows are split.
ROWS_PER_TASK = "spark.ostinato.rowsPerTask"
# Largest number of per-key rows that may be sent to every executor.
BROADCAST_KEYS = "spark.ostinato.broadcastKeys"

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", app: str = "ostinato") -> SparkSession:
    """Single-machine session used by the bench and the tests."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK, "4000000"))


def broadcast_keys(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_KEYS, "100000"))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Without one, a local folder if all tasks run on this machine, else an error."""
    context = spark.sparkContext
    folder = (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
              or context.getConf().get("spark.checkpoint.dir", None))
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_steps: list[str] = []
_summaries: list[DataFrame] = []


def settled(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, short lineage, known size.

    The folder stays until `forget` or `release_steps`, as it is read when the result made from it is.
    """
    path = step_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def step_folder(spark: SparkSession) -> str:
    """A new folder in the shared one for files that `release_steps` deletes."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _steps.append(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """Persist a summary until `release_steps`; it spills to disk and is recomputed where lost."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _summaries.append(df)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _steps.remove(path)


def forget(df: DataFrame) -> None:
    """Delete the folder of a settled table of which no row is needed any more."""
    _delete(df.sparkSession, df._step)


def release_steps(spark: SparkSession) -> None:
    """Delete all steps and drop all persisted summaries of this process, once the results made from them are stored."""
    for path in list(_steps):
        _delete(spark, path)
    for df in _summaries:
        df.unpersist()
    _summaries.clear()
