"""Provenance checks, run tables, training histories and report selections."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.columns import is_bad_number
from ostinato.operators.blocks import BLOCK, with_halo
from ostinato.operators.ordering import positions
from ostinato.operators.skew import attach, row_count
from ostinato.session import forget, settled

DIGEST_DIGITS = 8
METRICS = ("kendall_tau_c", "spearman", "mae", "mse", "acc_pm1")


def select_experiments(experiments: DataFrame, ids: Sequence[str] | None = None, group: str | None = None) -> DataFrame:
    """Experiments by id list and group; unknown ids and an empty selection are errors."""
    out = experiments
    if ids:
        wanted = experiments.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        unknown = [r["id"] for r in wanted.join(experiments, "id", "left_anti").collect()]
        if unknown:
            raise ValueError(f"unknown experiments: {sorted(unknown)}")
        out = out.filter(F.col("id").isin(list(ids)))
    if group:
        out = out.filter(F.col("group") == group)
    if out.isEmpty():
        raise ValueError("no experiment selected")
    return out


def verify_manifest(items: DataFrame, manifest: DataFrame, hashes: Sequence[str] = ("cqt_sha256", "rhythm_sha256")) -> DataFrame:
    """Violations of items(id, label, hashes) against manifest(id, label, status, hashes): id, problem."""
    right = manifest.select("id", F.lit(True).alias("_in"), F.col("label").alias("_label"), F.col("status").alias("_status"),
                            *[F.col(h).alias(f"_{h}") for h in hashes])
    changed = F.lit(False)
    for h in hashes:
        changed = changed | ~F.col(h).eqNullSafe(F.col(f"_{h}"))
    problem = (F.when(F.col("_in").isNull(), "absent").when(~F.col("_status").eqNullSafe("included"), "not_included")
               .when(F.col("label").isNull() | ~F.col("label").eqNullSafe(F.col("_label")), "label_differs").when(changed, "content_changed"))
    return items.join(right, "id", "left").select("id", problem.alias("problem")).filter("problem is not null")


def window_index(windows: DataFrame, labels: DataFrame, win_sec: float, hop_sec: float) -> DataFrame:
    """Index row per series: label, number of windows, content hash, window sizes."""
    lengths = windows.groupBy("id").agg(F.count(F.lit(1)).alias("length"))
    return labels.join(lengths, "id").withColumn("win_sec", F.lit(win_sec)).withColumn("hop_sec", F.lit(hop_sec))


def verify_index(windows: DataFrame, index: DataFrame, labels: DataFrame, win_sec: float, hop_sec: float) -> DataFrame:
    """Ids whose windows, label, hash or window sizes differ from the index: id, problem."""
    actual = windows.groupBy("id").agg(F.count(F.lit(1)).alias("_length")).join(
        labels.select("id", F.col("y").alias("_y"), F.col("audio_sha256").alias("_hash")), "id", "left")
    problem = (F.when(F.col("_in").isNull(), "not_indexed").when(~F.col("length").eqNullSafe(F.col("_length")), "length_differs")
               .when(~F.col("y").eqNullSafe(F.col("_y")), "label_differs")
               .when(~F.col("audio_sha256").eqNullSafe(F.col("_hash")), "hash_differs")
               .when(~F.col("win_sec").eqNullSafe(win_sec) | ~F.col("hop_sec").eqNullSafe(hop_sec), "window_differs"))
    return actual.join(index.withColumn("_in", F.lit(True)), "id", "left").select("id", problem.alias("problem")).filter("problem is not null")


def run_status(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Every attempt of every experiment, `unmanaged` where it has no status; one `not_started` row where there is none."""
    sizes = runs.groupBy("experiment_id").agg(row_count())
    # an experiment may hold most of the runs, so runs take up their experiment, not the other way round
    tried = attach(runs, experiments.join(sizes, "experiment_id"), ["experiment_id"]).withColumn(
        "status", F.coalesce("status", F.lit("unmanaged")))
    untried = experiments.join(sizes, "experiment_id", "left_anti").withColumn("status", F.lit("not_started"))
    return tried.unionByName(untried, allowMissingColumns=True)


def comparable(runs: DataFrame) -> DataFrame:
    """Runs that may be compared: same split and same validation size."""
    return runs.groupBy(F.coalesce("split_sha256", F.lit("unknown")).alias("split_sha256"), "n_validation").agg(
        F.count(F.lit(1)).alias("n_runs"))


def comparable_members(runs: DataFrame) -> DataFrame:
    """The runs of each comparison group, one row per run, so that a group of any size stays distributed."""
    named = runs.withColumn("split_sha256", F.coalesce("split_sha256", F.lit("unknown"))).withColumn(
        "n_validation", F.coalesce(F.col("n_validation").cast("string"), F.lit("none")))
    groups = named.groupBy("split_sha256", "n_validation").agg(F.count(F.lit(1)).alias("n_runs"), row_count())
    return attach(named.select("split_sha256", "n_validation", "run"), groups, ["split_sha256", "n_validation"])


def registry_summary(runs: DataFrame) -> DataFrame:
    """Totals, evaluated runs and runs per validation size: name, n."""
    totals = runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if("test_evaluated").alias("test_evaluated"))
    long = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in totals.columns])).alias("r"))
    by_size = runs.groupBy("n_validation").agg(F.count(F.lit(1)).alias("n"))
    return long.select("r.*").unionByName(by_size.select(
        F.concat(F.lit("n_validation="), F.coalesce(F.col("n_validation").cast("string"), F.lit("none"))).alias("name"), "n"))


def leaderboard(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("kendall_tau_c").desc_nulls_last(), F.col("run").asc())


def ids_digest(ids: DataFrame, column: str = "id") -> DataFrame:
    """One digest of a set of ids, whatever their order and number.

    Each id is hashed. The hashes that share their first 8 hex digits are joined in order by line feeds and hashed
    again, then those that share 6, 4, 2 and no digits. The depth is the same for every size, so that a set
    keeps its definition when it grows; above the first level a group has at most 256 members.
    """
    rows = ids.select(F.sha2(F.col(column).cast("string"), 256).alias("h")).distinct().select(F.substring("h", 1, DIGEST_DIGITS).alias("p"), "h")
    for digits in range(DIGEST_DIGITS, -1, -2):
        digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("p", "h"))).getField("h"), "\n"), 256)
        key = F.substring("p", 1, digits) if digits else F.lit("")
        rows = rows.groupBy(key.alias("q")).agg(digest.alias("h")).select(F.col("q").alias("p"), "h")
    return rows.select(F.col("h").alias("digest"))


def best_epoch(history: DataFrame, by: str = "run") -> DataFrame:
    """Epoch of the largest tau, then the smallest error, then the earliest; a missing tau ranks last."""
    order = F.struct(F.col("tau_c").isNotNull(), F.coalesce("tau_c", F.lit(0.0)), -F.col("mse"), -F.col("epoch"))
    row = F.struct("epoch", "tau_c", "mse")
    return history.groupBy(by).agg(F.max_by(row, order).alias("b")).select(by, "b.epoch", "b.tau_c", "b.mse")


def best_trial(trials: DataFrame, param: str = "param") -> DataFrame:
    """The winning candidate; without any defined tau the job fails."""
    first = trials.orderBy(F.col("kendall_tau_c").desc_nulls_last(), F.col("mse").asc(), F.col(param).asc()).limit(1)
    undefined = F.raise_error(F.lit("no candidate has a defined rank correlation")).cast("double")
    return first.withColumn("kendall_tau_c", F.when(F.col("kendall_tau_c").isNull(), undefined).otherwise(F.col("kendall_tau_c")))


EPOCHS_PER_BLOCK = 4096


def early_stop(history: DataFrame, patience: int = 15, min_delta: float = 0.001, by: str = "run", block: int = EPOCHS_PER_BLOCK) -> DataFrame:
    """Replay of early stopping: epochs run, whether it stopped, and the last reference tau, per run.

    Each epoch points to the next one that would reset the reference if it set it: the first of the next `patience`
    epochs with a tau larger by at least `min_delta`. The epochs of a run lie in blocks; a block follows the pointers of
    its first epochs until they leave it. Where a run has several blocks, the pointers between them double their
    reach in rounds, over `patience` written rows a block.
    """
    if patience <= 0 or not math.isfinite(min_delta) or min_delta < 0:
        raise ValueError("patience must be positive and min_delta finite and not negative")
    tau = F.col("tau_c").cast("double")
    bad = tau.isNotNull() & is_bad_number(tau)
    clean = history.select(F.col(by).alias("run"), "epoch", F.when(bad, F.raise_error(F.lit("tau must be finite")).cast("double")).otherwise(tau).alias("tau"))
    at = positions(clean, ["run"], ["epoch"], "at").select("run", "at", "tau")
    block = max(block, patience)
    ahead = with_halo(at, "at", 0, patience, block)          # a block also has the epochs that its last ones may point to
    sorted_rows = ahead.select("run", F.col(BLOCK).alias("block"), "at", "tau").repartition("run", "block").sortWithinPartitions("run", "block", "at")
    kind = at.schema["run"].dataType.simpleString()
    hops = sorted_rows.mapInArrow(lambda batches: _hops(batches, patience, min_delta, block), f"run {kind}, here long, there long, done boolean, ref double")
    hops = settled(hops)
    while hops.filter("not done").limit(1).count():
        there = hops.select("run", F.col("here").alias("there"), F.struct("there", "done", "ref").alias("next"))
        further = settled(hops.join(there, ["run", "there"], "left").select(
            "run", "here", *[F.when(F.col("done"), F.col(c)).otherwise(F.col(f"next.{c}")).alias(c) for c in ("there", "done", "ref")]))
        forget(hops)
        hops = further
    ends = hops.filter("here = -1").select("run", "there", "ref")
    out = attach(ends, clean.groupBy("run").agg(row_count(), F.count(F.lit(1)).alias("n")), ["run"])
    stop = F.col("there") + patience < F.col("n")
    return out.select(F.col("run").alias(by), F.when(stop, F.col("there") + patience + 1).otherwise(F.col("n")).alias("epochs_run"),
                      stop.alias("stopped"), F.col("ref").alias("reference_tau"))


def _hops(batches, patience: int, min_delta: float, block: int):
    """(run, here, there, done, ref): where the pointers lead from the start (-1) and from the first epochs of each later block.

    `done` means that no pointer leads on from `there`; otherwise it lies in the next block.
    """
    def settle(run, number, taus):
        start = number * block
        own = min(len(taus), block)
        tau = np.array([np.nan if t is None else t for t in taus])
        point = np.full(own, -1)
        open_rows = np.flatnonzero(~np.isnan(tau[:own]))
        for step in range(1, patience + 1):
            open_rows = open_rows[open_rows + step < len(tau)]
            if not len(open_rows):
                break
            gain = (tau[open_rows + step] > tau[open_rows]) & (tau[open_rows + step] - tau[open_rows] >= min_delta)
            point[open_rows[gain]] = open_rows[gain] + step
            open_rows = open_rows[~gain]
        end, done = np.arange(own), np.ones(own, bool)
        for k in range(own - 1, -1, -1):
            if point[k] >= own:
                end[k], done[k] = point[k], False
            elif point[k] >= 0:
                end[k], done[k] = end[point[k]], done[point[k]]
        if number == 0:
            known = np.flatnonzero(~np.isnan(tau[:patience]))
            k = int(known[0]) if len(known) else -1
            yield (run, -1, -1, True, None) if k < 0 else (run, -1, int(end[k]), bool(done[k]), float(tau[end[k]]))
        else:
            for k in range(min(patience, own)):
                if not np.isnan(tau[k]):
                    yield run, start + k, start + int(end[k]), bool(done[k]), float(tau[end[k]])

    held, group = [], None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("run", "block", "at", "tau")]
        for run, number, at, tau in zip(*columns):
            if (run, number) != group:
                if group is not None:
                    out += settle(*group, held)
                group, held = (run, number), []
            held.append(tau)
        if out:
            yield _hop_batch(out, batch.schema.field("run").type)
    if group is not None:
        out = list(settle(*group, held))
        if out:
            yield _hop_batch(out, batch.schema.field("run").type)


def _hop_batch(rows, kind) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.int64(), pa.bool_(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["run", "here", "there", "done", "ref"])


def pick_cases(wide: DataFrame, base: str, rhythm: str | None = None, structure: str | None = None,
               full: str | None = None, k: int = 3) -> DataFrame:
    """Pieces worth a look, per category, each piece under its first category: category, rank, id, score.

    wide(id, truth, <model columns>). Ties are broken by id.
    """
    err = lambda m: F.abs(F.col(m) - F.col("truth"))
    delta = lambda m: err(m) - err(base)
    wanted = [("baseline_large_err", F.lit(True), err(base), 4)]
    if structure:
        wanted += [("structure_improved", delta(structure) < -0.5, -delta(structure), k),
                   ("structure_worsened", delta(structure) > 0.5, delta(structure), k)]
    if rhythm:
        wanted += [("rhythm_improved", delta(rhythm) < -0.5, -delta(rhythm), k),
                   ("rhythm_worsened", delta(rhythm) > 0.5, delta(rhythm), k)]
    if full:
        wanted += [("full_still_bad", err(full) >= 2.0, err(full), k)]
    chosen = None
    for place, (category, rule, score, limit) in enumerate(wanted):
        top = (wide.filter(rule).select("id", score.alias("score")).orderBy(F.col("score").desc(), F.col("id").asc()).limit(limit)
               .select(F.lit(place).alias("place"), F.lit(category).alias("category"), "id", "score"))
        chosen = top if chosen is None else chosen.unionByName(top)
    # at most 4 + 5k rows from here on
    in_category = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("id").asc())
    chosen = chosen.withColumn("rank", F.row_number().over(in_category))
    first = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    return chosen.withColumn("_n", first).filter("_n = 1").select("place", "category", "rank", "id", "score")


def _first_of(rows: DataFrame, n: int | None) -> DataFrame:
    """Rows(id, reason, a, b) without repeats in the order (a, b); the first n."""
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("a", "b"))).filter("_n = 1").drop("_n")
    return once.orderBy("a", "b").limit(n) if n is not None else once


def pick_examples(mode: str, cases: DataFrame, wide: DataFrame | None = None, pieces: DataFrame | None = None,
                  base: str | None = None, structure: str | None = None, n: int = 6) -> DataFrame:
    """Report examples: "errors", "structure" or "merged"; position, id, reason.

    Every input below is a short top-k list.
    """
    errors = cases.select("id", F.concat(F.lit("from_error:"), "category").alias("reason"), F.lit(3).alias("a"),
                          (F.col("place") * 1000 + F.col("rank")).alias("b"))
    if mode == "errors":
        picked = _first_of(errors, n)
    else:
        picked = None
        if structure:
            gap = F.abs(F.col(structure) - F.col("truth")) - F.abs(F.col(base) - F.col("truth"))
            for a, reason, key in ((0, "structure_improved", gap), (1, "structure_worsened", -gap)):
                top = wide.select("id", key.alias("_k")).orderBy("_k", "id").limit(2)
                top = top.withColumn("b", F.row_number().over(Window.partitionBy(F.lit(a)).orderBy("_k", "id")))
                top = top.select("id", F.lit(reason).alias("reason"), F.lit(a).alias("a"), "b")
                picked = top if picked is None else picked.unionByName(top)
        chapters = (pieces.filter(F.size("yt_chapters") >= 4).select("id").orderBy("id").limit(1)
                    .select("id", F.lit("has_chapters").alias("reason"), F.lit(2).alias("a"), F.lit(1).alias("b")))
        picked = chapters if picked is None else picked.unionByName(chapters)
        picked = _first_of(picked.unionByName(errors), n)
        if mode == "merged":
            listed = errors.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("b")))
            unseen = listed.join(picked.select("id"), "id", "left_anti")
            unseen = unseen.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("b")))
            open_errors = unseen.filter(F.col("_at") <= n).agg(F.count(F.lit(1))).scalar()
            short = F.lit(n) - picked.agg(F.count(F.lit(1))).scalar()
            more = unseen.filter(F.col("_r") <= F.greatest(F.lit(1), open_errors, short))
            picked = picked.unionByName(more.select("id", "reason", F.lit(4).alias("a"), "b"))
        elif mode != "structure":
            raise ValueError(f"unknown mode {mode}")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("a", "b"))
    return picked.select(place.alias("position"), "id", "reason")
