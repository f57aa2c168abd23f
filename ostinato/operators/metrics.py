"""Rank and error metrics over (model, truth, score) rows.

Ranks need one global order per model. Rows are first reduced to counts per (model, score), and the
running counts over the scores are taken with `running_sums`, which splits a model over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions.columns import GRADES, grade_band, is_bad_number, is_close, rounded_grade
from ostinato.operators.ordering import running_sums


def checked(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Fail the job on a score that is not finite or a truth that is no grade."""
    y, s = F.col(truth), F.col(score)
    bad = y.isNull() | s.isNull() | is_bad_number(s.cast("double")) | ~y.isin(GRADES)
    return df.withColumn(score, F.when(bad, F.raise_error(F.lit("scores must be finite and grades 0..10")).cast("double"))
                         .otherwise(s.cast("double")))


def _score_cells(df: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """One row per (by, score): how many rows of each grade."""
    counts = [F.expr(f"count_if(`{truth}` = {g}) as g{g}") for g in GRADES]
    # -0.0 and 0.0 are one score
    return df.groupBy(*by, (F.col(score) + F.lit(0.0)).alias("_score")).agg(*counts)


def rank_metrics(df: DataFrame, by: Sequence[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Kendall tau-c and Spearman rho with ties, one row per `by`; null where one side is constant."""
    by = list(by)
    cells = running_sums(_score_cells(df, by, truth, score), by, ["_score"], {f"b{g}": f"g{g}" for g in GRADES})
    # expression text: one parse instead of some hundred column calls
    add = lambda terms: "(" + " + ".join(terms) + ")"
    # exact up to 9e15; beyond that the relative error stays near 1e-16
    wide = lambda text: f"double({text})"
    size = add(f"g{i}" for i in GRADES)
    rank = f"({add(f'b{i}' for i in GRADES)} + ({size} + 1) / 2)"
    concordant = add(f"{wide(f'g{i}')} * {wide(add(f'b{j}' for j in GRADES if j < i))}" for i in GRADES[1:])
    discordant = add(f"{wide(f'g{i}')} * {wide(add(f'b{j}' for j in GRADES if j > i))}" for i in GRADES[:-1])
    sums = cells.groupBy(*by).agg(
        F.expr(f"sum({concordant} - {discordant}) as _pq"),
        F.expr("count(1) as _scores"), F.expr(f"sum({rank} * {rank} * {size}) as _rank2"),
        *[F.expr(f"sum(g{i}) as n{i}") for i in GRADES], *[F.expr(f"sum({rank} * g{i}) as r{i}") for i in GRADES])
    sums = sums.withColumn("n", F.expr(add(f"n{i}" for i in GRADES)))
    sums = sums.withColumn("_truths", F.expr(add(f"int(n{i} > 0)" for i in GRADES)))
    # average rank of each grade about the mean rank
    y = [f"({add([f'n{j}' for j in GRADES if j < i] + ['0'])} + (n{i} + 1) / 2 - (n + 1) / 2)" for i in GRADES]
    xy = add(f"{y[i]} * (r{i} - (n + 1) / 2 * n{i})" for i in GRADES)
    xx = "(_rank2 - n * ((n + 1) / 2) * ((n + 1) / 2))"
    yy = add(f"n{i} * {y[i]} * {y[i]}" for i in GRADES)
    m = "least(_scores, _truths)"
    defined = "_scores > 1 and _truths > 1"
    tau = f"2 * _pq / (double(n) * double(n) * ({m} - 1) / {m})"
    return sums.select(*by, "n", F.expr(f"case when {defined} then {tau} end as kendall_tau_c"),
                       F.expr(f"case when {defined} then {xy} / sqrt({xx} * {yy}) end as spearman"))


def error_metrics(df: DataFrame, by: Sequence[str], truth: str = "truth", score: str = "score") -> DataFrame:
    """Mean absolute error, mean squared error and the share within one grade."""
    err = F.col(score) - F.col(truth)
    near = F.abs(rounded_grade(F.col(score)) - F.col(truth)) <= 1
    return df.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.avg(near.cast("double")).alias("acc_pm1"))


def evaluate(df: DataFrame, by: Sequence[str] = (), truth: str = "truth", score: str = "score",
             ranking: str | None = None) -> DataFrame:
    """All metrics per `by`; `ranking` names another column to rank with."""
    by = list(by)
    df = checked(df, truth, score)
    if ranking is not None:
        df = checked(df, truth, ranking)
    errors = error_metrics(df, by, truth, score)
    if by:
        both = rank_metrics(df, by, truth, ranking or score).join(errors, by)
    else:
        ranks = rank_metrics(df.withColumn("_whole", F.lit(0)), ["_whole"], truth, ranking or score).drop("_whole")
        one = errors.select(F.struct("mae", "mse", "acc_pm1")).scalar()
        both = ranks.withColumn("_e", one).select(*ranks.columns, "_e.*")
    note = F.when(F.col("kendall_tau_c").isNull(), "Undefined for constant truth or predictions")
    return both.withColumn("correlation_note", note)


def mean_baseline(df: DataFrame, part: str = "part", truth: str = "truth") -> DataFrame:
    """Metrics of the constant mean train grade on the other parts."""
    mean = df.filter(F.col(part) == "train").agg(F.avg(truth).alias("score"))
    rest = df.filter(F.col(part) != "train").select(part, truth).withColumn("score", mean.scalar())
    return evaluate(rest, [part], truth)


def grade_stats(df: DataFrame, model: str = "model", truth: str = "truth", score: str = "score") -> DataFrame:
    """Error by grade, by band and overall in one pass; `level` tells the three apart."""
    rows = df.select(F.col(model).alias("model"), F.col(truth).cast("int").alias("grade"),
                     grade_band(F.col(truth)).alias("band"), (F.col(score) - F.col(truth)).alias("err"))
    cube = rows.groupingSets(
        [[F.col("model"), F.col("grade")], [F.col("model"), F.col("band")], [F.col("model")]], "model", "grade", "band")
    out = cube.agg(
        F.grouping("grade").alias("_no_grade"), F.grouping("band").alias("_no_band"),
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("err")).alias("mae"), F.avg("err").alias("bias"),
        F.avg((F.abs("err") <= 1).cast("double")).alias("acc_pm1"))
    level = F.when(F.col("_no_grade") == 0, "grade").when(F.col("_no_band") == 0, "band").otherwise("overall")
    return out.select("model", level.alias("level"), "grade", "band", "n", "mae", "bias", "acc_pm1")


def pivot_predictions(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per id, one score column per model; fails where models disagree on the truth or repeat an id."""
    of = lambda m: F.col("model") == m
    per_model = [F.when(F.count_if(of(m)) > 1, F.raise_error(F.lit(f"{m} scores an id twice")).cast("double"))
                 .otherwise(F.max(F.when(of(m), F.col("score")))).alias(m) for m in models]
    rows = df.filter(F.col("model").isin(list(models)))
    wide = rows.groupBy("id").agg(F.min("truth").alias("_lo"), F.max("truth").alias("_hi"), *per_model)
    agreed = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.raise_error(F.lit("models disagree on the truth of an id")).cast("int"))
    return wide.select("id", agreed.alias("truth"), *models)


def verify_predictions(predictions: DataFrame, members: DataFrame, reported: DataFrame,
                       rtol: float = 1e-6, atol: float = 1e-7) -> DataFrame:
    """Violations of a predictions table: ids, labels and metrics against what is expected.

    predictions(id, truth, score); members(id, grade) is the part; reported is one row of metrics.
    """
    sized = predictions.groupBy("id").agg(F.count(F.lit(1)).alias("_rows"), F.min("truth").alias("_lo"),
                                          F.max("truth").alias("_hi"))
    joined = sized.join(members.select("id", F.col("grade")), "id", "full_outer")
    problem = (F.when(F.col("_rows").isNull(), "missing_prediction")
               .when(F.col("grade").isNull(), "unknown_id")
               .when(F.col("_rows") > 1, "duplicate_id")
               .when((F.col("_lo") != F.col("grade")) | (F.col("_hi") != F.col("grade")), "label_differs"))
    rows = joined.select(F.col("id").cast("string").alias("subject"), problem.alias("problem")).filter("problem is not null")
    names = ["n", "kendall_tau_c", "spearman", "mae", "mse", "acc_pm1"]
    computed = evaluate(predictions).select(F.array(*[F.col(c).cast("double") for c in names]).alias("a"))
    claimed = reported.select(F.array(*[F.col(c).cast("double") for c in names]).alias("b"))
    pairs = computed.withColumn("b", claimed.scalar()).select(F.explode(F.arrays_zip(
        F.array(*[F.lit(c) for c in names]).alias("name"), F.col("a"), F.col("b"))).alias("m"))
    metrics = pairs.filter(~is_close(F.col("m.a"), F.col("m.b"), rtol, atol)).select(
        F.col("m.name").alias("subject"), F.lit("metric_differs").alias("problem"))
    return rows.unionByName(metrics)


def verify_release(predictions: DataFrame, members: DataFrame, reported: DataFrame, claims: Mapping[str, object], split: DataFrame,
                   split_sha256: str, seed: int, rtol: float = 1e-6, atol: float = 1e-7) -> DataFrame:
    """`verify_predictions` and the claims of a saved run against the split it has to come from: subject, problem.

    claims holds split_sha256, seed and n_<part> of the run; a claim that is missing differs. split is (id, part).
    """
    sizes = {f"n_{r['part']}": r["n"] for r in split.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}     # a few parts
    expected = {"split_sha256": split_sha256, "seed": seed, **sizes}
    unknown = {k for k in claims if k.startswith("n_") and k not in expected}
    wrong = sorted({k for k, v in expected.items() if claims.get(k) != v} | unknown)
    found = verify_predictions(predictions, members, reported, rtol, atol)
    if not wrong:
        return found
    return found.unionByName(predictions.sparkSession.createDataFrame([(k, f"{k}_differs") for k in wrong], "subject string, problem string"))
