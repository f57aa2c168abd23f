"""Feature tables for models, fitting, selection and scoring, and length-ordered batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinato.functions.columns import is_bad_number
from ostinato.operators.metrics import evaluate
from ostinato.operators.ordering import positions, running_sums
from ostinato.operators.registry import best_trial
from ostinato.operators.skew import attach, row_count
from ostinato.operators.trees import BoostedTrees, _matrix, _tasks, feature_rows, fit_boosted_trees, score_trees
from ostinato.session import forget, settled, shared_folder


def _unusable(table: DataFrame, columns: Iterable[str]) -> Column:
    """Whether a row lacks a value, or has a number that is not finite, in one of the columns."""
    columns = list(columns)
    numbers = [F.col(c).cast("double") for c in columns if isinstance(table.schema[c].dataType, (T.FloatType, T.DoubleType))]
    lacking = F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x) if columns else F.lit(False)
    return lacking | F.coalesce(F.exists(F.array(*numbers), is_bad_number), F.lit(False)) if numbers else lacking


def check_features(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Violations of a feature table: repeated ids, missing values and numbers that are not finite."""
    bad = _unusable(table, columns)
    per_id = table.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(bad).alias("_bad"))
    problem = F.when(F.col("_n") > 1, "duplicate_id").when(F.col("_bad"), "not_finite")
    return per_id.select("id", problem.alias("problem")).filter("problem is not null")


def assemble_features(truth: DataFrame, tables: Iterable[DataFrame]) -> DataFrame:
    """Columns of all tables side by side for the ids of truth(id, grade).

    Each table has id and grade. A missing or repeated id, another grade or none, a missing value and a number that
    is not finite fail the job, whichever table it is in. Features of any type pass as they are.
    """
    out = truth.select("id", "grade")
    for i, table in enumerate(tables):
        bad = _unusable(table, (c for c in table.columns if c not in ("id", "grade")))
        rows = F.count(F.lit(1)).over(Window.partitionBy("id"))      # on the shuffle that the join needs anyway
        side = table.withColumn(f"_in{i}", rows).withColumn(f"_bad{i}", bad).withColumnRenamed("grade", f"_g{i}")
        absent, differs, repeated, unusable = (
            F.raise_error(F.concat(F.lit(f"{what} feature table {i}: "), F.col("id").cast("string"))).cast("int")
            for what in ("missing in", "label differs in", "repeated in", "no usable value in"))
        grade = F.when(F.col(f"_in{i}").isNull(), absent).when(
            ~F.coalesce(F.col(f"_g{i}") == F.col("grade"), F.lit(False)), differs).when(F.col(f"_in{i}") > 1, repeated).when(
            F.col(f"_bad{i}"), unusable).otherwise(F.col("grade"))
        out = out.join(side, "id", "left").withColumn("grade", grade).drop(f"_g{i}", f"_in{i}", f"_bad{i}")
    return out


def stack_features(truth: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> tuple[DataFrame, list[str]]:
    """One feature array per id of truth(id, grade), from tables of (id, grade, features array<double>) with their names.

    The plan has the same size for any number of features. A table is brought to one row per id first, so a repeated
    id is seen without a window over it. Errors as with `assemble_features`, and an array of another length than its names.
    """
    names = [n for _, own in tables for n in own]
    if len(set(names)) < len(names):
        raise ValueError("feature names repeat")
    out = truth.select("id", "grade")
    for i, (table, own) in enumerate(tables):
        values = F.col("features").cast("array<double>")
        bad = F.coalesce((F.size(values) != len(own)) | F.exists(values, lambda x: x.isNull() | is_bad_number(x)), F.lit(True))
        side = table.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("grade").alias("_g"), F.max(values).alias("_f"), F.bool_or(bad).alias("_bad"))
        stop = lambda what, i=i: F.raise_error(F.concat(F.lit(f"{what} feature table {i}: "), F.col("id").cast("string"))).cast("int")
        grade = F.when(F.col("_n").isNull(), stop("missing in")).when(F.col("_n") > 1, stop("repeated in")).when(
            ~F.coalesce(F.col("_g") == F.col("grade"), F.lit(False)), stop("label differs in")).when(F.col("_bad"), stop("no usable value in")).otherwise(F.col("grade"))
        joined = F.concat("features", "_f") if i else F.col("_f")
        out = out.join(side, "id", "left").select("id", grade.alias("grade"), joined.alias("features"))
    return out, names


def missing_features(truth: DataFrame, table: DataFrame) -> DataFrame:
    """Ids of truth that the table lacks or labels otherwise: id, problem."""
    side = table.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("grade").alias("_g"), F.count("grade").alias("_labels"), F.max("grade").alias("_h"))
    same = F.coalesce((F.col("_g") == F.col("grade")) & (F.col("_h") == F.col("grade")), F.lit(False)) & (F.col("_labels") == F.col("_n"))
    problem = F.when(F.col("_n").isNull(), "missing").when(~same, "label_differs").when(F.col("_n") > 1, "duplicate_id")
    return truth.join(side, "id", "left").select("id", problem.alias("problem")).filter("problem is not null")


@dataclass
class Ridge:
    """A fitted linear model on raw feature values."""
    names: list[str]
    weights: list[float]
    intercept: float

    def score(self, table: DataFrame) -> DataFrame:
        rows = feature_rows(table, self.names, table.columns)
        pairs = F.zip_with("_x", F.array(*map(F.lit, self.weights)), lambda x, w: x * w)
        return rows.withColumn("score", F.lit(self.intercept) + F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)).drop("_x")


def co_moments(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred sums of products of all pairs of the values in `_x`, in one pass.

    Each task centres on its own means. The rows of the matrices are then added by their number in parallel, with the
    correction for the means; the driver gets one row of `width` sums per feature, whatever the number of rows and tasks.
    """
    def local(batches):
        n, mean, product = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("_x"), width)
                own = x.mean(axis=0)
                x = x - own
                shift, many = own - mean, n + len(x)
                product += x.T @ x + np.outer(shift, shift) * (n * len(x) / many)
                n, mean = many, mean + shift * (len(x) / many)
        if n:
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(width + 1) * width, pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([TaskContext.get().partitionId()] * width, pa.int32()),
                                              pa.array([n] * width, pa.int64()), lists(np.tile(mean, (width, 1))), lists(product)],
                                             names=["i", "task", "n", "mean", "products"])

    def merge(batches):
        at, done = None, []
        for batch in batches:
            means, products = _matrix(batch.column("mean"), width), _matrix(batch.column("products"), width)
            for k, (i, n) in enumerate(zip(batch.column("i").to_pylist(), batch.column("n").to_pylist())):
                if i != at:
                    done.append([i, n, means[k].copy(), products[k].copy()])
                    at = i
                    continue
                held = done[-1]
                shift, many = means[k] - held[2], held[1] + n
                held[3] += products[k] + shift * shift[i] * (held[1] * n / many)
                held[1], held[2] = many, held[2] + shift * (n / many)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()),
                                              *(pa.array([d[k].tolist() for d in done], pa.list_(pa.float64())) for k in (2, 3))],
                                             names=["i", "n", "mean", "products"])
    partial = rows.select("_x").mapInArrow(local, "i int, task int, n long, mean array<double>, products array<double>")
    dealt = partial.repartition(min(width, 64), "i").sortWithinPartitions("i", "task")
    found = sorted(dealt.mapInArrow(merge, "i int, n long, mean array<double>, products array<double>").collect())
    if not found:
        raise ValueError("a fit needs rows")
    return found[0]["n"], np.array(found[0]["mean"]), np.array([r["products"] for r in found])


def fit_ridge(train: DataFrame, columns: Sequence[str], alphas: Iterable[float], label: str = "grade") -> dict[float, Ridge]:
    """Standardized ridge regression with a free intercept for every penalty, from one pass over the rows.

    Columns are centred and scaled by their population deviation; a constant column counts as deviation 1.
    """
    columns = list(columns)
    n, mean, products = co_moments(feature_rows(train, [*columns, label]), len(columns) + 1)
    spread = np.sqrt(np.diag(products)[:-1] / n)
    spread[spread == 0] = 1.0
    gram, target = products[:-1, :-1] / np.outer(spread, spread), products[:-1, -1] / spread
    out = {}
    for alpha in alphas:
        weights = np.linalg.solve(gram + alpha * np.eye(len(columns)), target) / spread
        out[alpha] = Ridge(columns, weights.tolist(), float(mean[-1] - weights @ mean[:-1]))
    return out


def boosted_trees(**settings) -> Callable[[DataFrame, Sequence[str], Sequence[int]], dict[int, BoostedTrees]]:
    """A fit for `select_model` over numbers of leaves."""
    return lambda train, columns, leaves: fit_boosted_trees(train, columns, leaves, **settings)


MAX_BINS = 32             # of a feature, as Spark's trees have by default


def _cut_points(firsts: Mapping[int, int], distinct: int, bins: int) -> list[int]:
    """Positions of the values that a bin begins with, from the first position of each share of the rows.

    At most `bins` values have a bin each. Of more, a bin ends where its rows come nearest to their share; after a value
    of several shares the values that follow have bins of their own, until the bins are again as many as the shares.
    """
    if distinct <= bins:
        return list(range(1, distinct))
    out, at = [], 0
    for k in range(1, bins):
        at = max(at + 1, min((first for share, first in firsts.items() if share >= k), default=distinct))
        if at >= distinct:
            break
        out.append(at)
    return out


def even_bins(rows: DataFrame, width: int, bins: int = MAX_BINS) -> tuple[int, list[list[float]]]:
    """Number of rows, and for each feature the ascending last values of its bins but the last, from all rows.

    The rule is that of Spark's trees, which apply it to about 10,000 rows: bins of about equally many rows, bounds halfway
    between neighbouring values.
    """
    n = rows.count()
    counts = rows.select(F.posexplode("_x").alias("feature", "value")).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    one = counts.withColumn("one", F.lit(1).cast("long"))
    placed = settled(running_sums(one, ["feature"], ["value"], {"before": "n", "at": "one"}).drop("one"))
    share = F.expr(f"({bins} * (2 * before + n) - 1) div {2 * max(n, 1)}")
    firsts = placed.filter("at > 0").groupBy("feature", share.alias("share")).agg(F.min("at").alias("first"))
    sizes = {r["feature"]: r["count"] for r in placed.groupBy("feature").count().collect()}
    of = [{} for _ in range(width)]
    for r in firsts.collect():                                # at most `bins` rows a feature
        of[r["feature"]][r["share"]] = r["first"]
    cuts = [_cut_points(of[f], sizes.get(f, 0), bins) for f in range(width)]
    wanted = sorted({(f, at) for f, own in enumerate(cuts) for cut in own for at in (cut - 1, cut)})
    asked = rows.sparkSession.createDataFrame(wanted, "feature int, at long")
    value = {(r["feature"], r["at"]): r["value"] for r in placed.join(F.broadcast(asked), ["feature", "at"]).collect()}
    forget(placed)
    return n, [sorted({(value[f, at - 1] + value[f, at]) / 2 for at in own}) for f, own in enumerate(cuts)]


@dataclass
class FeatureCells:
    """Training rows whose features lie in the same bins as one row: the bins, `_n` rows and their mean label `_y`.

    Trees on squared error split and predict the same on these as on the rows. However long the table, there are no more
    cells than combinations of bins.
    """
    bins: Bucketizer
    table: DataFrame
    cells: int
    rows: int

    def unpersist(self) -> None:
        forget(self.table)


def feature_cells(train: DataFrame, columns: Sequence[str], label: str = "grade", bins: int = MAX_BINS) -> FeatureCells:
    """The cells of a table. A value or label that is no finite number fails, and an empty table."""
    columns = list(columns)
    n, bounds = even_bins(feature_rows(train, columns), len(columns), bins)
    if not n:
        raise ValueError("a fit needs rows")
    # a bin holds its last value, a bucket does not; a constant feature still needs one inner bound
    inner = [[float(np.nextafter(b, np.inf)) for b in own] or [0.0] for own in bounds]
    split = Bucketizer(inputCols=columns, outputCols=[f"_bin{f}" for f in range(len(columns))], splitsArray=[[-np.inf, *own, np.inf] for own in inner])
    y = F.col(label).cast("double")
    y = F.when(y.isNull() | is_bad_number(y), F.raise_error(F.lit("labels must be finite numbers")).cast("double")).otherwise(y)
    grouped = split.transform(train.select(*columns, y.alias("_y"))).groupBy(*split.getOutputCols()).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_y").alias("_y"))
    # buckets are marked as categories, but the trees have to keep their order
    cells = settled(grouped.select(*[F.col(c).alias(c, metadata={"ml_attr": {"type": "numeric"}}) for c in split.getOutputCols()], "_n", "_y"))
    many = cells.count()
    tasks = _tasks(many * len(columns), train.sparkSession.sparkContext.defaultParallelism)
    dealt = settled(cells.repartition(tasks, *split.getOutputCols()))
    forget(cells)
    return FeatureCells(split, dealt, many, n)


def gbt_pipeline(train: DataFrame | FeatureCells, columns: Sequence[str], depth: int, label: str = "grade", rounds: int = 300,
                 rate: float = 0.05, min_rows: int = 20, seed: int = 42) -> PipelineModel:
    """Boosted regression trees of Spark's own; the depth bounds a tree. Rounds are checkpointed to the shared folder.

    They are fitted to the cells of the rows, so that the rows are read for the cells only and not once a level of a tree.
    """
    shared_folder((train.table if isinstance(train, FeatureCells) else train).sparkSession)
    cells = train if isinstance(train, FeatureCells) else feature_cells(train, columns, label)
    if list(columns) != list(cells.bins.getInputCols()):
        raise ValueError("feature names differ from those of the cells")
    whole = cells.rows < 2 * min_rows                       # no side of a split has so many rows
    vector = VectorAssembler(inputCols=cells.bins.getOutputCols(), outputCol="features")
    # so many bins that Spark looks at the bins of all cells and not of a sample
    trees = GBTRegressor(labelCol="_y", weightCol="_n", predictionCol="score", maxDepth=depth, maxIter=rounds, stepSize=rate,
                         minInstancesPerNode=cells.cells if whole else 1, minWeightFractionPerNode=0.0 if whole else (min_rows - .5) / cells.rows,
                         maxBins=max(MAX_BINS, int(cells.cells ** .5) + 1), checkpointInterval=10, seed=seed)
    try:
        return PipelineModel([cells.bins, vector, trees.fit(vector.transform(cells.table))])
    finally:
        if cells is not train:
            cells.unpersist()


def one_by_one(fit: Callable[[DataFrame | FeatureCells, Sequence[str], float], PipelineModel],
               prepare: Callable[[DataFrame, Sequence[str]], FeatureCells] | None = None) -> Callable[[DataFrame, Sequence[str], Sequence], dict]:
    """A fit for `select_model` from one that takes a single parameter; they run at the same time, as their small jobs wait more than they work.

    `prepare` makes once what all of them are fitted to, in place of the cached rows.
    """
    def every(train, columns, params):
        ready = prepare(train, columns) if prepare else train.cache()
        try:
            with ThreadPoolExecutor(max(1, len(params))) as pool:
                fits = [pool.submit(inheritable_thread_target(train.sparkSession)(fit), ready, columns, param) for param in params]
                return {param: one.result() for param, one in zip(params, fits)}
        finally:
            ready.unpersist()
    return every


def score(model: Ridge | BoostedTrees | PipelineModel, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`table` with the scores of a fitted model; the feature names have to be those it was fitted with."""
    if isinstance(model, BoostedTrees):
        return score_trees(model, table, columns)
    own = isinstance(model, Ridge)
    names = model.names if own else next(s for s in model.stages if isinstance(s, (Bucketizer, VectorAssembler))).getInputCols()
    if list(columns) != list(names):
        raise ValueError("feature names differ from those of the model")
    if own:
        return model.score(table)
    return model.transform(table).drop("features", *(c for s in model.stages if isinstance(s, Bucketizer) for c in s.getOutputCols()))


def save_ridge(spark: SparkSession, model: Ridge, path: str) -> None:
    """One row; never overwrites."""
    spark.createDataFrame([(model.names, model.weights, model.intercept)], "names array<string>, weights array<double>, intercept double"
                          ).coalesce(1).write.mode("errorifexists").parquet(path)


def load_ridge(spark: SparkSession, path: str) -> Ridge:
    row = spark.read.parquet(path).first()
    return Ridge(list(row["names"]), list(row["weights"]), row["intercept"])


Fit = Callable[[DataFrame, Sequence[str], Sequence], Mapping]


def select_model(table: DataFrame, columns: Sequence[str], params: Iterable, fit: Fit) -> tuple[Ridge | BoostedTrees | PipelineModel, DataFrame, DataFrame]:
    """Fit on part train for all parameters at once, choose on part val: (model, trials, validation predictions).

    The features are written once and the written table is deleted when the trials are known.
    """
    used = settled(table.select("id", "grade", "part", *columns))
    train, val = used.filter("part = 'train'"), used.filter("part = 'val'")
    fitted = dict(fit(train, list(columns), sorted(set(params))))
    scored = None
    for param, model in fitted.items():
        rows = score(model, val, columns).select(F.lit(float(param)).alias("param"), "grade", "score")
        scored = rows if scored is None else scored.unionByName(rows)
    scored = settled(scored)                                 # the metrics read the scores more than once
    trials = evaluate(scored, ["param"], truth="grade")
    trials = used.sparkSession.createDataFrame(trials.collect(), trials.schema)  # one row per candidate
    forget(scored)
    best = fitted[type(next(iter(fitted)))(best_trial(trials).first()["param"])]
    predictions = settled(score(best, val, columns).select("id", F.col("grade").alias("truth"), "score"))
    forget(used)
    return best, trials, predictions


def ridge_closed_form(train: DataFrame, x: str, y: str, alphas: Sequence[float]) -> DataFrame:
    """One standardized column, closed form, for each penalty: alpha, slope, intercept, one pass over the rows."""
    sums = train.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("sx"),
                     F.covar_pop(x, y).alias("cxy"))
    grid = sums.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    weight = F.col("n") * (F.col("cxy") / F.col("sx")) / (F.col("n") + F.col("alpha"))
    slope = weight / F.col("sx")
    return grid.select("alpha", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def length_batches(items: DataFrame, batch: int, shuffle: bool = False, seed: int = 42, epoch: int = 0, buckets: int = 20) -> DataFrame:
    """Batches of similar length. items(id, length) -> id, length, bucket, slot, batch.

    Rows are numbered by (length, id) over all tasks, cut into buckets of batch*buckets rows, and with
    `shuffle` mixed inside the buckets and among them in order of SHA-256 of seed + epoch and the id or bucket.
    """
    size = batch * buckets
    placed = positions(items.select("id", "length"), [], ["length", "id"], "_at")
    placed = placed.withColumn("bucket", F.floor(F.col("_at") / size))
    if not shuffle:
        return placed.select("id", "length", "bucket", F.col("_at").alias("slot"), F.floor(F.col("_at") / batch).alias("batch"))
    drawn = lambda c: F.sha2(F.concat(F.lit(f"{seed + epoch}:"), F.col(c).cast("string")), 256)
    # a bucket has at most `size` rows
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy(drawn("id"), "id")) - 1
    mixed = placed.withColumn("_inner", inner)
    sizes = placed.groupBy("bucket").agg(row_count(), F.count(F.lit(1)).alias("_size")).withColumn("_order", drawn("bucket"))
    offsets = running_sums(sizes, [], ["_order", "bucket"], {"_start": "_size"}).drop("_order", "_size")
    slot = F.col("_start") + F.col("_inner")
    return attach(mixed, offsets, ["bucket"]).select(
        "id", "length", "bucket", slot.alias("slot"), F.floor(slot / batch).alias("batch"))


def pad_batches(frames: DataFrame, batches: DataFrame) -> DataFrame:
    """Frames of each batch filled up with zero frames to the longest series of the batch.

    frames(id, frame, values), batches(id, length, batch) -> batch, id, frame, values, real. All vectors
    have to have one width. Long form: a series is never held in one row.
    """
    width = frames.select(F.min(F.size("values")).alias("lo"), F.max(F.size("values")).alias("hi")).first()
    if width["lo"] is None or width["lo"] != width["hi"]:
        raise ValueError("all frames of a batch need the same number of channels")
    # a batch has a fixed number of series
    longest = F.max("length").over(Window.partitionBy("batch"))
    sized = batches.select("id", "batch", "length").withColumn("_max", longest)
    per_id = frames.groupBy("id").agg(row_count())
    real = attach(frames, sized.select("id", "batch").join(per_id, "id"), ["id"]).select(
        "batch", "id", F.col("frame").cast("long").alias("frame"), "values", F.lit(True).alias("real"))
    kind = frames.schema["values"].dataType
    zeros = F.array_repeat(F.lit(0), width["lo"]).cast(kind)
    fill = sized.filter("length < _max").select(
        "batch", "id", F.explode(F.sequence(F.col("length").cast("long"), F.col("_max").cast("long") - 1)).alias("frame"),
        zeros.alias("values"), F.lit(False).alias("real"))
    return real.unionByName(fill)
