"""Readers and writers: metadata, splits, manifests, files, series, features, runs, norms."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinato.functions.columns import is_bad_number
from ostinato.functions.text import nfc
from ostinato.operators.registry import METRICS

MAX_FRAME_FILE = 64 * 1024 * 1024
# Metadata fields that are read.
PIECE_TEXTS = ("ps", "composer", "youtube_link")
PIECE_NUMBERS = ("duration", "start", "end", "only_start", "only_end")


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Metadata object keyed by id, one row per key, keys in NFC; two keys with one NFC form are an error.

    The file is one JSON value. It is read once and is meant to be kept as parquet afterwards.
    """
    raw = spark.read.text(path, wholetext=True)
    # a field of another kind than its type, such as a quoted number or a boolean, is null and leaves the rest of the record
    entry = T.StructType([T.StructField(f, T.StringType()) for f in PIECE_TEXTS] + [T.StructField(f, T.DoubleType()) for f in PIECE_NUMBERS]
                         + [T.StructField("YT_chapters", T.StringType())])
    parsed = F.from_json("value", T.MapType(T.StringType(), entry))
    rows = raw.select(F.explode(F.when(F.size(parsed) > 0, parsed).otherwise(
        F.raise_error(F.lit("metadata must be a nonempty object")).cast(T.MapType(T.StringType(), entry)))).alias("key", "p"))
    rows = rows.select(nfc(F.col("key")).alias("id"), "p.*")
    repeated = rows.groupBy("id").count().filter("count > 1").take(3)
    if repeated:
        raise ValueError(f"keys collide in NFC: {[r['id'] for r in repeated]}")
    chapters = F.from_json("YT_chapters", T.ArrayType(T.StringType())).alias("yt_chapters")
    return rows.select("id", *PIECE_TEXTS, *PIECE_NUMBERS, chapters)


def read_split(spark: SparkSession, path: str, pieces: DataFrame | None = None) -> DataFrame:
    """Split document to (id, part); with `pieces`, an unknown id is an error."""
    raw = spark.read.text(path, wholetext=True)
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("metadata_sha256", T.StringType()),
                           T.StructField("parts", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
    parts = raw.select(F.explode(F.from_json("value", schema).getField("parts")).alias("part", "ids"))
    split = parts.select(F.explode("ids").alias("id"), "part").select(nfc(F.col("id")).alias("id"), "part")
    if pieces is not None:
        unknown = split.join(pieces, "id", "left_anti").take(3)
        if unknown:
            raise ValueError(f"split has unknown ids: {[r['id'] for r in unknown]}")
    return split


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records, one row per id."""
    record = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()),
                           T.StructField("status", T.StringType()), T.StructField("cqt_sha256", T.StringType()),
                           T.StructField("rhythm_sha256", T.StringType())])
    schema = T.StructType([T.StructField("records", T.ArrayType(record)), T.StructField("split_sha256", T.StringType())])
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select("split_sha256", F.inline("records")).withColumn("id", nfc(F.col("id")))


def without_links(files: DataFrame) -> DataFrame:
    """The listing as it is; a file of a local or mounted folder that is a symbolic link fails the job. Object stores have none."""
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                parts = urlsplit(path)
                if parts.scheme in ("", "file") and os.path.islink(unquote(parts.path) if parts.scheme else path):
                    raise ValueError(f"symbolic links are not read: {path}")
            yield batch
    return files.mapInArrow(run, files.schema)


def scan_files(spark: SparkSession, folder: str, suffix: str, links: bool = False) -> DataFrame:
    """Files with a suffix by stem: id, path, bytes. index.npz is skipped; equal NFC stems, and links unless `links`, are an error.

    Only the listing is used; contents are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length")
    files = files if links else without_links(files)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    rows = files.withColumn("name", name).filter("name != 'index.npz'")
    stem = F.expr(f"substring(name, 1, length(name) - {len(suffix)})")
    rows = rows.select(nfc(stem).alias("id"), "path", F.col("length").alias("bytes"))
    repeated = rows.groupBy("id").count().filter("count > 1").take(3)
    if repeated:
        raise ValueError(f"file names collide in NFC: {[r['id'] for r in repeated]}")
    return rows


def with_sha256(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Content digest per file: path, bytes, sha256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_frames(spark: SparkSession, path: str, channels: int = 88, limit: int = MAX_FRAME_FILE) -> DataFrame:
    """Frame rows (id, frame, values); width, finite values and the size of the files are checked as rows are read."""
    rows = spark.read.parquet(path)
    size = F.col("_metadata.file_size")
    small = F.when(size > limit, F.raise_error(F.concat(F.lit("unexpectedly large file: "), F.col("_metadata.file_path"))).cast("boolean")).otherwise(True)
    rows = rows.filter(small)
    x = F.col("values")
    bad = x.isNull() | (F.size(x) != channels) | F.exists(x, lambda v: v.isNull() | is_bad_number(v.cast("double")))
    kind = rows.schema["values"].dataType
    return rows.withColumn("values", F.when(bad, F.raise_error(F.concat(
        F.lit("bad frame of "), F.col("id").cast("string"))).cast(kind)).otherwise(x))


def refuse_large(files: DataFrame, limit: int = MAX_FRAME_FILE) -> None:
    """Error for files over the size limit."""
    large = files.filter(F.col("bytes") > limit).take(3)
    if large:
        raise ValueError(f"unexpectedly large files: {[r['path'] for r in large]}")


def write_new(df: DataFrame, path: str) -> None:
    """Parquet that never replaces; the output committer makes it appear as a whole."""
    df.write.mode("errorifexists").parquet(path)


def write_windows(windows: DataFrame, path: str, index: DataFrame, index_path: str) -> None:
    """Window rows, one file set spread by series and window range, and one index row per series."""
    spread = windows.repartition("id", F.floor(F.col("win") / 100_000)).sortWithinPartitions("id", "win")
    write_new(spread, path)
    write_new(index, index_path)


def read_windows(spark: SparkSession, path: str, index_path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(path), spark.read.parquet(index_path)


def write_features(df: DataFrame, path: str, names: Sequence[str], provenance: Mapping[str, str]) -> None:
    """Feature rows (id, grade, features) with a names table and one provenance row beside them."""
    spark = df.sparkSession
    write_new(df, f"{path}/data")
    write_new(spark.createDataFrame(list(enumerate(names)), "position int, name string").coalesce(1), f"{path}/names")
    write_new(spark.createDataFrame([(dict(provenance),)], "provenance map<string,string>").coalesce(1), f"{path}/provenance")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """(rows, names, provenance). A row whose width differs from the names or with a bad value fails the job."""
    names = [r["name"] for r in spark.read.parquet(f"{path}/names").orderBy("position").collect()]
    provenance = spark.read.parquet(f"{path}/provenance").first()["provenance"]
    rows = spark.read.parquet(f"{path}/data")
    x = F.col("features")
    bad = (F.size(x) != len(names)) | F.exists(x, lambda v: v.isNull() | is_bad_number(v))
    checked = F.when(bad, F.raise_error(F.lit("bad feature row")).cast("array<double>")).otherwise(x)
    return rows.withColumn("features", checked), names, provenance


def wide_features(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per feature, taken from the array at the very end."""
    return rows.select("id", "grade", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _run_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(run, file, path, content) of the files under root; `run` is the folder relative to root, in NFC."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    rel = F.replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(base, F.lit("/")), F.lit(""))
    return files.select(F.regexp_replace(rel, "/?[^/]*$", "").alias("run"), F.regexp_extract(rel, "([^/]*)$", 1).alias("file"), "path", "content")


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run folder under root that holds metrics.json; complete if all three files are there.

    Whether a file is there comes from the listing. Only metrics and config, which are small, are read. Folders whose names
    are equal in NFC, and links, fail the job.
    """
    listed = without_links(_run_files(spark, root, "*.json").select("run", "file", "path"))
    has = lambda name: F.bool_or(F.col("file") == name)
    folders = listed.groupBy("run").agg(has("metrics.json").alias("m"), has("config.json").alias("c"), has("predictions_val.json").alias("p")).filter("m")
    folders = folders.withColumn("key", nfc(F.col("run")))
    same = F.count(F.lit(1)).over(Window.partitionBy("key"))
    clash = F.raise_error(F.concat(F.lit("run folders collide in NFC: "), F.col("key")))
    folders = folders.select("run", F.when(same > 1, clash).otherwise(F.col("key")).alias("key"), (F.col("c") & F.col("p")).alias("complete"))
    text = F.col("content").cast("string")
    of = lambda name: F.max(F.when(F.col("file") == name, text))
    read = _run_files(spark, root, "{metrics,config}.json").groupBy("run").agg(of("metrics.json").alias("m"), of("config.json").alias("c"))
    value = lambda c, path, kind: F.get_json_object(c, path).cast(kind)
    return folders.join(read, "run").select(
        F.col("key").alias("run"), F.when(F.col("complete"), "complete").otherwise("partial").alias("status"),
        F.coalesce(value("c", "$.model", "string"), value("c", "$.feature_group", "string"), F.lit("unknown")).alias("model"),
        value("c", "$.feature_group", "string").alias("feature_group"), value("m", "$.validation.n", "int").alias("n_validation"),
        *[value("m", f"$.validation.{k}", "double").alias(k) for k in METRICS],
        F.coalesce(value("m", "$.test_evaluated", "boolean"), F.lit(False)).alias("test_evaluated"),
        value("c", "$.split_sha256", "string").alias("split_sha256"),
        F.coalesce(value("c", "$.training.seed", "int"), value("c", "$.model_seed", "int")).alias("seed"),
        value("c", "$.training.best_epoch", "int").alias("best_epoch"), value("c", "$.training.epochs_run", "int").alias("epochs_run"),
        value("c", "$.runtime_seconds", "double").alias("runtime_seconds"),
        F.sha2("c", 256).alias("config_sha256"), F.sha2("m", 256).alias("metrics_sha256"))


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with `error`: the text of a line that is no record of the schema, whose other columns are then what could be read of it.

    A broken line becomes a row of its own and the job goes on. Lines are always parsed whole: a reader that leaves out
    columns nobody asks for would not see what is wrong with them.
    """
    whole = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    record = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "error"})
    return spark.read.text(path).filter(F.trim("value") != "").select(record.alias("r")).select("r.*")


def write_window_table(windows: DataFrame, name: str, path: str, index: DataFrame, buckets: int = 64) -> None:
    """Windows and their index as tables `name` and `name`_index under `path`, both in buckets of id and sorted by it.

    Joins and groupings by id read them without an exchange. The number of buckets is for good; choose it for the size that is to come.
    """
    for rows, table, order in ((windows, name, ("id", "win")), (index, f"{name}_index", ("id",))):
        (rows.repartition(buckets, "id").write.mode("errorifexists").bucketBy(buckets, "id").sortBy(*order)
         .option("path", f"{path}/{table}").saveAsTable(table))


def open_window_table(spark: SparkSession, name: str, path: str, windows: T.StructType, index: T.StructType, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """The two tables of `write_window_table` in a session that does not know them yet."""
    for table, schema, order in ((name, windows, "id, win"), (f"{name}_index", index, "id")):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"create table if not exists `{table}` ({columns}) using parquet clustered by (id) sorted by ({order}) into {buckets} buckets location '{path}/{table}'")
    return spark.table(name), spark.table(f"{name}_index")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction lists under path: run (from the file's folder), id, truth, score."""
    schema = "id string, true_grade int, score double"
    rows = (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "predictions_*.json").json(path))
    folder = F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]*$", 1)
    part = F.regexp_extract(F.input_file_name(), "predictions_([^/.]*)", 1)
    return rows.select(folder.alias("run"), part.alias("part"), "id", F.col("true_grade").alias("truth"), "score")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Training history, one JSON object per line."""
    rows = spark.read.schema("epoch int, train_mse double, validation struct<kendall_tau_c: double, mse: double>").json(path)
    run = F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]*$", 1)
    return rows.select(run.alias("run"), "epoch", "train_mse", F.col("validation.kendall_tau_c").alias("tau_c"),
                       F.col("validation.mse").alias("mse"))


def write_registry_csv(runs: DataFrame, path: str) -> None:
    runs.write.mode("errorifexists").option("header", True).csv(path)


def save_norm(norm: DataFrame, path: str, provenance: Mapping[str, str]) -> None:
    """Normalization rows and one provenance row."""
    write_new(norm, f"{path}/norm")
    write_new(norm.sparkSession.createDataFrame([(dict(provenance),)], "provenance map<string,string>").coalesce(1), f"{path}/provenance")


def load_norm(spark: SparkSession, path: str, expected: Mapping[str, str], channels: int = 97) -> DataFrame:
    """Normalization rows after checking provenance, channel count and values."""
    provenance = spark.read.parquet(f"{path}/provenance").first()["provenance"]
    differs = sorted(k for k in expected if provenance.get(k) != expected[k])
    if differs:
        raise ValueError(f"normalization was made from other inputs: {differs}")
    norm = spark.read.parquet(f"{path}/norm")
    bad = F.coalesce(is_bad_number(F.col("mean")) | is_bad_number(F.col("std")) | (F.col("std") <= 0), F.lit(True))
    found = norm.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("channel").alias("d"), F.count_if(bad).alias("bad")).first()
    if found["n"] != channels or found["d"] != channels or found["bad"]:
        raise ValueError("normalization has wrong channels or values")
    return norm
