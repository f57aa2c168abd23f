"""Boosted regression trees on squared error, grown best first up to a number of leaves, with an L2 term.

Features are cut into at most 256 bins, a row keeps them as one byte string. A pass over the rows sums gradients by node,
feature and bin in the tasks that hold the rows; the sums of a node meet in one task, which reports the node's best split
and nothing else. Trees of all wanted sizes grow in the same passes. A pass takes every node that the best-first order
may still reach: a node is split only if it is among the first by gain whatever its unknown neighbours turn out to be,
so the tree is the one that would come of one split at a time, in as many passes as it is deep. As trees of neighbouring
rounds are much alike, the splits of the last tree serve as guesses: a pass also sums below the nodes it is asked for, and
where the guesses hold, many levels are known at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinato.functions.columns import is_bad_number
from ostinato.session import forget, settled

BINS = 256
CELLS = 1 << 23                 # sums that a task holds in one pass; more nodes take more passes
CELLS_PER_MERGE = 1 << 20       # sums of nodes that one task brings together
DRIVER_CELLS = 1 << 17          # sums of all tasks that the driver brings together itself
BYTES_PER_TASK = 8 << 20        # of bins, at most
BYTES_PER_CORE = 64 << 10       # of bins that are worth a task of their own while there are cores for it
ROUNDS_PER_WRITE = 20           # rounds after which the scores of the rows are written, so that lost ones are soon made again
LEAF = -1


@dataclass
class Tree:
    """Nodes as arrays; `bound` is the last bin (while it grows) and the last value that goes left."""
    feature: list[int] = field(default_factory=lambda: [LEAF])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, values: tuple[float, float]) -> None:
        for side, value in zip((self.left, self.right), values):
            side[node] = len(self.feature)
            for column, new in zip((self.feature, self.bin, self.left, self.right, self.value), (LEAF, 0, 0, 0, value)):
                column.append(new)
        self.feature[node], self.bin[node] = feature, bin_

    def arrays(self, bounds: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        bound = self.bin if bounds is None else [0.0 if f == LEAF else bounds[f][b] for f, b in zip(self.feature, self.bin)]
        return tuple(map(np.array, (self.feature, bound, self.left, self.right, self.value)))


def leaves_of(tree: tuple[np.ndarray, ...], rows: np.ndarray) -> np.ndarray:
    """The leaf of each row of a matrix of bins or values."""
    feature, bound, left, right, _ = tree
    at = np.zeros(len(rows), np.int64)
    open_rows = np.flatnonzero(feature[at] != LEAF)
    while len(open_rows):
        node = at[open_rows]
        at[open_rows] = np.where(rows[open_rows, feature[node]] <= bound[node], left[node], right[node])
        open_rows = open_rows[feature[at[open_rows]] != LEAF]
    return at


@dataclass
class BoostedTrees:
    """A fitted model: its score is `base` and the leaf values of all trees."""
    names: list[str]
    base: float
    trees: list[tuple[np.ndarray, ...]]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        for tree in self.trees:
            out += tree[4][leaves_of(tree, rows)]
        return out


def feature_rows(table: DataFrame, columns: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """`keep` and the columns as one array of doubles; a value that is no finite number fails the job."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    bad = F.exists("_x", lambda x: x.isNull() | is_bad_number(x))
    stop = F.raise_error(F.lit("features must be finite numbers")).cast("array<double>")
    return table.select(*keep, values.alias("_x")).withColumn("_x", F.when(bad, stop).otherwise(F.col("_x")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bin_bounds(rows: DataFrame, width: int) -> list[np.ndarray]:
    """For each feature the ascending last values of its bins but the last.

    Few distinct values have a bin each, with bounds halfway; of more the bins hold about equally many rows.
    """
    long = rows.select(F.posexplode("_x").alias("feature", "value"))
    fractions = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    spread = long.groupBy("feature").agg(F.approx_count_distinct("value").alias("about"), F.percentile_approx("value", fractions, F.lit(20_000)).alias("cuts"))
    spread = {r["feature"]: r for r in spread.collect()}                   # one row per feature
    few = [f for f, r in spread.items() if r["about"] <= BINS * 3 // 2]
    seen = long.filter(F.col("feature").isin(few)).distinct().groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("values"))
    values = {r["feature"]: np.array(r["values"]) for r in seen.collect()}    # some hundred values a feature
    out = []
    for f in range(width):
        own = values.get(f, ())
        out.append((own[1:] + own[:-1]) / 2 if 0 < len(own) <= BINS else np.unique(spread[f]["cuts"])[: BINS - 1] if f in spread else np.zeros(0))
    return out


def binned(rows: DataFrame, bounds: list[np.ndarray], label: str, base: float, models: int) -> DataFrame:
    """(bins binary, y double, s array<double>): bins, label and the score of each model."""
    width = len(bounds)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("_x"), width)
            bins = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], axis=1).astype(np.uint8)
            n = len(x)
            yield pa.RecordBatch.from_arrays([
                pa.array([r.tobytes() for r in bins], pa.binary()), batch.column("y"),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * models, pa.int32()), pa.array(np.full(n * models, base)))], names=["bins", "y", "s"])
    return rows.select("_x", F.col(label).cast("double").alias("y")).mapInArrow(run, "bins binary, y double, s array<double>")


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("bins")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, width)


def _leaves_under(tree: tuple[np.ndarray, ...], nodes: list[int]) -> dict[int, list[int]]:
    """The leaves below each of the nodes; a leaf is below itself."""
    feature, _, left, right, _ = tree

    def below(node):
        return [node] if feature[node] == LEAF else below(left[node]) + below(right[node])
    return {node: below(node) for node in nodes}


def best_splits(rows: DataFrame, width: int, tasks: int, grown: list[tuple[np.ndarray, ...]], wanted: list[list[int]], l2: float, min_rows: int) -> list[tuple]:
    """(model, node, gradient, rows, gain, feature, bin, gradient and rows of the left side) for the wanted nodes of each model.

    A wanted node need not be a leaf: its sums are those of the leaves below it.
    """
    size, nodes = width * BINS, [(m, node) for m, some in enumerate(wanted) for node in some]
    under = [_leaves_under(tree, some) for tree, some in zip(grown, wanted)]
    number, leaves, firsts = [np.full(len(tree[0]), -1) for tree in grown], 0, []
    for m, own in enumerate(under):
        firsts.append(leaves)
        for leaf in sorted({x for some in own.values() for x in some}):
            number[m][leaf], leaves = leaves, leaves + 1
    firsts.append(leaves)
    place = np.arange(width) * BINS

    def sums(batches):
        total, count = np.zeros(leaves * size), np.zeros(leaves * size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y = _bins_of(batch, width), batch.column("y").to_numpy()
            scores = _matrix(batch.column("s"), len(grown))
            for m in range(len(grown)):
                if not wanted[m]:
                    continue
                own = number[m][leaves_of(grown[m], bins)]
                inside = np.flatnonzero(own >= 0)
                cells = ((own[inside, None] - firsts[m]) * size + place + bins[inside]).ravel()
                part = slice(firsts[m] * size, firsts[m + 1] * size)       # the sums of this model
                total[part] += np.bincount(cells, np.repeat(scores[inside, m] - y[inside], width), part.stop - part.start)
                count[part] += np.bincount(cells, minlength=part.stop - part.start)
        total, count, found = total.reshape(-1, size), count.reshape(-1, size), []
        for k, (m, node) in enumerate(nodes):
            parts = number[m][under[m][node]]
            n = count[parts].sum(axis=0)
            used = np.flatnonzero(n)
            if len(used):
                found.append((k, used.astype(np.int32).tobytes(), total[parts].sum(axis=0)[used].tobytes(), n[used].tobytes()))
        if found:
            k, *parts = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(k), pa.int32()),
                                              *(pa.array(p, pa.binary()) for p in parts)], names=["node", "task", "cells", "sums", "counts"])

    def best(node, total, count):
        g, n = total[:BINS].sum(), int(count[:BINS].sum())
        left, many = np.cumsum(total.reshape(width, BINS), axis=1), np.cumsum(count.reshape(width, BINS), axis=1)
        gain = left ** 2 / (many + l2) + (g - left) ** 2 / (n - many + l2) - g ** 2 / (n + l2)
        gain[(many < min_rows) | (n - many < min_rows)] = -np.inf
        k = int(np.argmax(gain))
        return node, float(g), n, float(gain.flat[k]), k // BINS, k % BINS, float(left.flat[k]), int(many.flat[k])

    def merged(batches):
        """Best splits from partial sums sorted by node."""
        node, total, count = None, np.zeros(size), np.zeros(size, np.int64)
        for batch in batches:
            for k, cells, some, counts in zip(*(batch.column(c).to_pylist() for c in ("node", "cells", "sums", "counts"))):
                if k != node:
                    if node is not None:
                        yield best(node, total, count)
                        total[:], count[:] = 0, 0
                    node = k
                at = np.frombuffer(cells, np.int32)
                total[at] += np.frombuffer(some)
                count[at] += np.frombuffer(counts, np.int64)
        if node is not None:
            yield best(node, total, count)

    def merge(batches):
        done = list(merged(batches))
        if done:
            kinds = (pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["node", "g", "n", "gain", "feature", "bin", "left_g", "left_n"])

    partial = rows.mapInArrow(sums, "node int, task int, cells binary, sums binary, counts binary")
    if tasks * len(nodes) * size <= DRIVER_CELLS:
        # few enough sums for the driver, by a bound that holds before they are made: one stage instead of two
        found = list(merged(partial.toArrow().sort_by([("node", "ascending"), ("task", "ascending")]).to_batches()))
    else:
        # sums of one node are added in order of the tasks, so that a fit gives the same trees again
        together = partial.repartition(max(1, min(len(nodes), len(nodes) * size // CELLS_PER_MERGE)), "node").sortWithinPartitions("node", "task")
        found = map(tuple, together.mapInArrow(merge, "node int, g double, n long, gain double, feature int, bin int, left_g double, left_n long").collect())
    return [(*nodes[k], *rest) for k, *rest in found]


class _Growth:
    """One tree while it grows: what is known of its nodes, and which nodes the best-first order has reached.

    It may start from the splits of the tree before as guesses. What lies below a node that is not known yet is asked for
    in the same pass under the guessed splits. A guess that proves wrong is replaced; the guesses below it are tried again there.
    """

    def __init__(self, leaves: int, l2: float, rate: float, min_rows: int, guess: Tree | None = None):
        self.leaves, self.l2, self.rate, self.min_rows = leaves, l2, rate, min_rows
        self.tree, self.known, self.rows = Tree(), {}, {0: None}
        if guess is not None:
            self._graft(0, guess, 0)

    def _graft(self, node: int, source: Tree, at: int) -> None:
        if source.feature[at] != LEAF:
            left, right = source.left[at], source.right[at]
            self.tree.split(node, source.feature[at], source.bin[at], (0.0, 0.0))
            sides = self.tree.left[node], self.tree.right[node]
            self._graft(sides[0], source, left)
            self._graft(sides[1], source, right)

    def learn(self, node: int, g: float, n: int, gain: float, feature: int, bin_: int, left_g: float, left_n: int) -> None:
        self.known[node] = (gain, feature, bin_, left_g, left_n, g, n)
        self.rows[node] = n

    def _below(self, node: int) -> list[int]:
        if self.tree.feature[node] == LEAF:
            return []
        sides = self.tree.left[node], self.tree.right[node]
        return [x for s in sides for x in (s, *self._below(s))]

    def reached(self) -> tuple[list[int], list[int]]:
        """Nodes split by the order as far as it is known, and nodes that it needs next, those below them under the guesses included."""
        order, taken, unknown = [], [], []

        def meet(node):
            n = self.rows.get(node)
            if node in self.known:
                if self.known[node][0] > 0:
                    heapq.heappush(order, (-self.known[node][0], len(taken), node))
            elif n is None or n >= 2 * self.min_rows:
                unknown.append(node)
        meet(0)
        while order and len(taken) + 1 < self.leaves:
            *_, node = heapq.heappop(order)
            taken.append(node)
            tree, (gain, feature, bin_, left_g, left_n, g, n) = self.tree, self.known[node]
            if (tree.feature[node], tree.bin[node]) != (feature, bin_):
                before = tree.left[node], tree.right[node]
                guessed = tree.feature[node] != LEAF
                tree.split(node, feature, bin_, (0.0, 0.0))
                if guessed:
                    for new, old in zip((tree.left[node], tree.right[node]), before):
                        self._graft(new, tree, old)
            value = lambda a, b: -self.rate * a / (b + self.l2)
            for side, (own_g, own_n) in ((tree.left[node], (left_g, left_n)), (tree.right[node], (g - left_g, n - left_n))):
                tree.value[side], self.rows[side] = value(own_g, own_n), own_n
                meet(side)
        if taken and len(taken) + 1 == self.leaves:      # what comes of the last split's children is never asked
            last = {self.tree.left[taken[-1]], self.tree.right[taken[-1]]}
            unknown = [node for node in unknown if node not in last]
        return taken, [x for node in unknown for x in (node, *self._below(node))]

    def finished(self) -> Tree:
        """The tree of the nodes that were split, without those tried in vain."""
        taken, out, number = self.reached()[0], Tree(), {0: 0}
        for node in taken:
            sides = self.tree.left[node], self.tree.right[node]
            out.split(number[node], self.tree.feature[node], self.tree.bin[node], tuple(self.tree.value[s] for s in sides))
            number |= {sides[0]: out.left[number[node]], sides[1]: out.right[number[node]]}
        if not taken and 0 in self.known:
            *_, g, n = self.known[0]
            out.value[0] = -self.rate * g / (n + self.l2)
        return out


def grow(rows: DataFrame, width: int, tasks: int, leaves: Sequence[int], rate: float, l2: float, min_rows: int, guesses: list[Tree] | None = None) -> list[Tree]:
    """One tree of each size on the gradients of its own scores."""
    at_once = max(1, CELLS // (width * BINS))
    if guesses and sum(t.feature.count(LEAF) for t in guesses) > at_once:
        guesses = None                                    # too many sums for one pass: level by level
    growing = [_Growth(k, l2, rate, min_rows, guesses[i] if guesses else None) for i, k in enumerate(leaves)]
    while any(wanted := [g.reached()[1] for g in growing]):
        if not guesses:
            room = at_once
            for m, nodes in enumerate(wanted):
                wanted[m] = nodes[:room]
                room -= len(wanted[m])
        for m, node, *found in best_splits(rows, width, tasks, [g.tree.arrays() for g in growing], wanted, l2, min_rows):
            growing[m].learn(node, *found)
        for g, nodes in zip(growing, wanted):             # a guess may leave a node without rows
            for node in nodes:
                g.known.setdefault(node, (0.0, LEAF, 0, 0.0, 0, 0.0, 0))
    return [g.finished() for g in growing]


def _moved(rows: DataFrame, width: int, trees: list[tuple[np.ndarray, ...]]) -> DataFrame:
    """The rows with the leaf values of one more tree of each model added to their scores."""
    def run(batches):
        for batch in batches:
            bins, scores = _bins_of(batch, width), _matrix(batch.column("s"), len(trees)).copy()
            for m, tree in enumerate(trees):
                scores[:, m] += tree[4][leaves_of(tree, bins)]
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.ListArray.from_arrays(
                pa.array(np.arange(len(scores) + 1) * len(trees), pa.int32()), pa.array(scores.ravel()))], names=["bins", "y", "s"])
    return rows.mapInArrow(run, "bins binary, y double, s array<double>")


def _tasks(size: int, cores: int) -> int:
    """Tasks for so many bytes of bins: all cores if there is work for them, no more while the rows fit, as each task reports sums of its own."""
    return max(1, size // BYTES_PER_TASK, min(size // BYTES_PER_CORE, cores))


def fit_boosted_trees(train: DataFrame, columns: Sequence[str], leaves: Sequence[int], label: str = "grade", rounds: int = 300,
                      rate: float = 0.05, l2: float = 1.0, min_rows: int = 20) -> dict[int, BoostedTrees]:
    """Models of `rounds` trees with at most so many leaves each, fitted at the same time: leaves -> model.

    An empty table and a value or label that is no finite number fail.
    """
    columns, leaves = list(columns), sorted(set(leaves))
    if not columns or not leaves or min(leaves) < 2 or rounds < 1 or min_rows < 1 or l2 < 0:
        raise ValueError("columns, at least two leaves, rounds and rows of a leaf must be given")
    rows = settled(feature_rows(train, columns, [label]))
    y = F.col(label).cast("double")
    base, n, bad = rows.agg(F.avg(y), F.count(F.lit(1)), F.count_if(y.isNull() | is_bad_number(y))).first()
    if not n or bad:
        raise ValueError("a fit needs rows, and labels that are finite numbers")
    bounds = bin_bounds(rows, len(columns))
    tasks = _tasks(n * len(columns), rows.sparkSession.sparkContext.defaultParallelism)
    stored = settled(binned(rows, bounds, label, base, len(leaves)).repartition(tasks))
    forget(rows)
    here, older, grown, made = stored, None, None, [[] for _ in leaves]
    for done in range(1, rounds + 1):
        grown = grow(here, len(columns), tasks, leaves, rate, l2, min_rows, grown)          # fills `here`, so what it was made from may go
        if older is not None:
            older.unpersist()
        for m, tree in enumerate(grown):
            made[m].append(tree.arrays(bounds))
        moved, older = _moved(here, len(columns), [t.arrays() for t in grown]), None if here is stored else here
        if done == rounds:
            break
        if done % ROUNDS_PER_WRITE:
            here = moved.persist(StorageLevel.MEMORY_AND_DISK)
            continue
        here = settled(moved)
        forget(stored)
        stored = here
    if older is not None:
        older.unpersist()
    forget(stored)
    return {k: BoostedTrees(columns, float(base), made[m]) for m, k in enumerate(leaves)}


def score_trees(model: BoostedTrees, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`table` with the model's score; the feature names have to be those it was fitted with."""
    if list(columns) != list(model.names):
        raise ValueError("feature names differ from those of the model")
    rows = feature_rows(table, columns, table.columns)
    width, names = len(model.names), [*table.columns, "score"]

    def run(batches):
        for batch in batches:
            kept = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != "_x"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.predict(_matrix(batch.column("_x"), width)))], names=names)
    return rows.mapInArrow(run, T.StructType([*table.schema.fields, T.StructField("score", T.DoubleType())]))


def save_trees(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    """One row per node, and one with the base and the names; never overwrites."""
    head = [(-1, 0, None, None, None, None, model.base, model.names)]
    nodes = [(t, k, int(f), float(b), int(left), int(right), float(v), None) for t, tree in enumerate(model.trees) for k, (f, b, left, right, v) in enumerate(zip(*tree))]
    schema = "tree int, node int, feature int, bound double, left int, right int, value double, names array<string>"
    spark.createDataFrame(head + nodes, schema).write.mode("errorifexists").parquet(path)


def load_trees(spark: SparkSession, path: str) -> BoostedTrees:
    rows = sorted(spark.read.parquet(path).collect())          # as many rows as the model has nodes
    trees: list[list] = []
    for r in rows[1:]:
        if r["tree"] == len(trees):
            trees.append([])
        trees[-1].append(tuple(r)[2:7])
    return BoostedTrees(list(rows[0]["names"]), rows[0]["value"], [tuple(map(np.array, zip(*t))) for t in trees])
