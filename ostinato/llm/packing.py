"""Packing of token sequences: non-negative least squares over window-filling combinations, then residuals in a stream.

Whole windows of a document are sequences of their own; what is left, shorter than a window, is a tail. Only
the histogram of tail lengths (at most `window` numbers) reaches the driver. There all pairs and triples of
lengths that fill a window exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares, rounded down and held to the histogram. The tails that remain follow one another
greedily and are cut where a window ends. Nothing but the last sequence is padded.

A tail finds its place from its rank among the tails of its length. Ranks are counted in groups of (length,
salt) whose number grows with the input, so a length that a third of all documents share is not one task.

Defined cases: a null or empty text is the single end id; repeated rows are packed each; ids may be null;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.llm.batches import map_texts
from ostinato.llm.bpe import BATCH_BYTES, encoder
from ostinato.llm.storage import written

WINDOW = 1024
END_ID = 0
ROWS_PER_GROUP = 1_000_000
BIG = 1 << 44                 # more than the rows of any length


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """(row_no, id, doc_tokens, checks, tail) written: CRC-32 of each whole window, and the ids of the tail (16 bits each)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        own = encoder(path)
        ids, at = own.encode(batch.column("text"))
        rows = batch.num_rows
        ends = at + np.arange(rows + 1)                               # one more id in each document
        flat = np.full(int(ends[-1]), END_ID, "<u4")
        flat[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(at))] = ids
        short = flat.astype("<u2").tobytes()
        view = memoryview(flat).cast("B") if len(flat) else b""
        checks, tails = [], []
        for first, last in zip(ends.tolist(), ends[1:].tolist()):
            cut = first + (last - first) // window * window
            checks.append([zlib.crc32(view[4 * k:4 * (k + window)]) for k in range(first, cut, window)])
            tails.append(short[2 * cut:2 * last])
        return {"row_no": batch.column("row_no"), "id": batch.column("id"), "doc_tokens": pa.array(np.diff(ends), pa.int64()),
                "checks": pa.array(checks, pa.list_(pa.int64())), "tail": pa.array(tails, pa.binary())}

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(map_texts(rows, run, f"row_no long, id {kind}, doc_tokens long, checks array<long>, tail binary", limit=BATCH_BYTES))


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the given lengths, ascending, that fill the window; 0 stands for no third length."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    found = [np.stack([lengths, window - lengths, np.zeros_like(lengths)], axis=1)[(2 * lengths <= window) & present[window - lengths]]]
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[present[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used closest to the histogram (multiplicative updates)."""
    used = combos > 0
    def lengths_of(x):
        return sum(np.bincount(combos[:, k], weights=x * used[:, k], minlength=len(histogram)) for k in range(3))
    def over(v):
        return sum(v[combos[:, k]] * used[:, k] for k in range(3))
    target = over(histogram)
    per_length = np.maximum(lengths_of(np.ones(len(combos))), 1)
    x = np.min(np.where(used, (histogram / per_length)[combos], np.inf), axis=1)
    for _ in range(rounds):
        x = x * target / np.maximum(over(lengths_of(x)), 1e-12)
    return x


@dataclass
class Plan:
    """Places by (length, rank). A slot holds the tails of one length from rank `first` on."""
    key: np.ndarray           # length * BIG + first rank, ascending
    sequence: np.ndarray      # of the first rank; of the stream's first sequence for a stream slot
    offset: np.ndarray        # in the sequence; stream position of the first rank for a stream slot
    stream: np.ndarray        # whether the slot lies in the stream
    sequences: int            # sequences that tails fill


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """histogram: number of tails of each length, index 0 unused."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros_like(left)
    slots, sequence = [], 0
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window) if len(lengths) else np.zeros((0, 3), np.int64)
    if len(combos):
        x = least_squares(combos, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            times = int(x[k] + 0.5)
            if not times:
                break
            parts = [int(n) for n in combos[k] if n]
            times = min(times, *(int(left[n]) // parts.count(n) for n in parts))
            if times:
                offset = 0
                for n in parts:
                    slots.append((n * BIG + int(taken[n]), sequence, offset, False))
                    taken[n] += times
                    left[n] -= times
                    offset += n
                sequence += times
    position = 0
    for n in np.flatnonzero(left)[::-1].tolist():
        slots.append((n * BIG + int(taken[n]), sequence, position, True))
        position += n * int(left[n])
    slots.sort()
    columns = [np.array([s[k] for s in slots], np.int64) for k in range(4)]
    return Plan(columns[0], columns[1], columns[2], columns[3].astype(bool), sequence - (-position // window))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id and offset; CRC-32 is of the ids in 32 bits each."""
    kind = dict(docs.dtypes)[id_col]
    rows = tokenized(docs, path, id_col, text_col, window)
    size = (F.octet_length("tail") / 2).cast("int")
    by_length = {r["n"]: r for r in rows.groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("checks")).alias("whole")).collect()}
    histogram = np.array([by_length[n]["rows"] if n in by_length else 0 for n in range(window)])
    made = plan(histogram, window)
    # whole windows are numbered after the tails' sequences, length by length
    whole = [by_length[n]["whole"] if n in by_length else 0 for n in range(window)]
    base = made.sequences + np.concatenate(([0], np.cumsum(whole)))[:-1]

    salts = 16 + int(histogram.sum()) // ROWS_PER_GROUP
    keyed = rows.withColumn("n", size).withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(salts)).cast("int"))
    groups = keyed.groupBy("n", "salt").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("checks")).alias("whole"))
    before = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("n", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("whole_before"))
    order = Window.partitionBy("n", "salt").orderBy("row_no")
    ranked = (keyed.withColumn("rank", F.row_number().over(order) - 1)
              .withColumn("whole_rank", F.sum(F.size("checks")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.size("checks"))
              .join(starts, ["n", "salt"]).select("id", "doc_tokens", "checks", "tail", "n", (F.col("rank") + F.col("rows_before")).alias("rank"),
                                                  (F.col("whole_rank") + F.col("whole_before")).alias("whole_rank")))

    def run(batches):
        for batch in batches:
            tail_size = batch.column("n").to_numpy()
            key = tail_size.astype(np.int64) * BIG + batch.column("rank").to_numpy()
            slot = np.searchsorted(made.key, key, "right") - 1
            pieces = []
            for k, (checks, tail, whole_rank) in enumerate(zip(batch.column("checks").to_pylist(), batch.column("tail").to_pylist(),
                                                               batch.column("whole_rank").to_pylist())):
                n = int(tail_size[k])
                first = int(base[n]) + whole_rank
                pieces += [(k, i * window, window, check, first + i, 0) for i, check in enumerate(checks)]
                if n:
                    s, start = int(slot[k]), len(checks) * window
                    ahead = int(key[k] - made.key[s])
                    ids = np.frombuffer(tail, "<u2").astype("<u4")
                    if made.stream[s]:
                        at = int(made.offset[s]) + ahead * n
                        cuts = [0, *range(window - at % window, n, window), n]
                        pieces += [(k, start + a, b - a, zlib.crc32(ids[a:b].tobytes()), int(made.sequence[s]) + (at + a) // window, (at + a) % window)
                                   for a, b in itertools.pairwise(cuts)]
                    else:
                        pieces.append((k, start, n, zlib.crc32(ids.tobytes()), int(made.sequence[s]) + ahead, int(made.offset[s])))
            owner, *columns = map(list, zip(*pieces)) if pieces else [[] for _ in range(6)]
            start, length, check, sequence, offset = (pa.array(c, pa.int64()) for c in columns)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(owner, pa.int64())), "start": start, "length": length, "ids_crc32": check,
                "doc_tokens": batch.column("doc_tokens").take(pa.array(owner, pa.int64())), "sequence_id": sequence, "offset": offset})

    out = ranked.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
