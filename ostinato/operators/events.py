"""Event sequences: intervals, densities, envelopes, lag profiles, tempo and local peaks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ostinato.operators.blocks import BLOCK, CORE, DEFAULT_BLOCK, with_halo
from ostinato.operators.ordering import exact_percentiles, previous
from ostinato.operators.skew import ROWS, attach
from ostinato.operators.windows import NOT_DENSE, window_strength, window_table
from ostinato.session import forget, settled

# The tempo prior and its range.
TEMPO_CENTRE = 120.0
TEMPO_MAX = 320.0
FRAMES_PER_TASK = 1 << 19       # frames of which one task takes the lag profiles
BLOCKS_AT_ONCE = 32             # blocks whose profiles are taken together
VALUES_AT_ONCE = 1 << 15        # values of the windows that are worked on together
HELD_VALUES = 1 << 20           # values of windows that wait for others of their length
TILE = 64                       # frames of a window in one product of matrices
# Channel order of a rhythm window.
RHYTHM_NAMES = ("onset_density", "onset_strength_mean", "onset_strength_std", "onset_strength_max",
                "ioi_mean", "ioi_std", "ioi_cv", "tempo_bpm", "tempo_confidence")


def intervals(onsets: DataFrame, tie: str | None = None) -> DataFrame:
    """Add `ioi`, the seconds since the onset before (null for the first)."""
    order = ["t", tie] if tie else ["t"]
    return previous(onsets, ["id"], order, {"t_before": "t"}).withColumn("ioi", F.col("t") - F.col("t_before"))


def ioi_stats(onsets: DataFrame) -> DataFrame:
    """Mean, deviation, variation and quartiles of the intervals; all 0 with fewer than two onsets."""
    gaps = intervals(onsets).select("id", "ioi")
    stats = exact_percentiles(gaps, ["id"], "ioi", {"ioi_p25": 0.25, "ioi_p50": 0.5, "ioi_p75": 0.75},
                              [F.avg("ioi").alias("ioi_mean"), F.stddev_pop("ioi").alias("ioi_std")])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    cv = F.when(F.col("ioi_mean") > 0, F.col("ioi_std") / F.col("ioi_mean")).otherwise(0.0)
    return stats.select(
        "id", zero("ioi_mean"), zero("ioi_std"), cv.alias("ioi_cv"), zero("ioi_p25"), zero("ioi_p50"), zero("ioi_p75"))


def strength_stats(envelope: DataFrame, value: str = "strength") -> DataFrame:
    """Mean, deviation, maximum and four percentiles of a scalar series."""
    return exact_percentiles(envelope, ["id"], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95},
                             [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max")])


def event_density(onsets: DataFrame, durations: DataFrame, bins: int = 8) -> DataFrame:
    """Events per second overall and in equal time bins; durations(id, duration).

    A bin is closed on the left and open on the right, so an event at the very end falls in none.
    """
    step = F.col("duration") / bins
    edge = lambda i: step * i if i < bins else F.col("duration")
    timed = durations.select("id", "duration")
    counts = onsets.groupBy("id").agg(F.count(F.lit(1)).alias(ROWS))
    placed = attach(onsets.select("id", "t"), timed.join(counts, "id"), ["id"])
    per_bin = [F.count_if((F.col("t") >= edge(i)) & (F.col("t") < edge(i + 1))).alias(f"_c{i}") for i in range(bins)]
    found = placed.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), *per_bin)
    joined = timed.join(found, "id", "left")
    rate = lambda c, width: F.when(width > 0, F.coalesce(F.col(c), F.lit(0)) / width).otherwise(0.0)
    dens = [rate(f"_c{i}", edge(i + 1) - edge(i)).alias(f"bin_{i}") for i in range(bins)]
    out = joined.select("id", rate("_n", F.col("duration")).alias("density"), *dens)
    cols = [F.col(f"bin_{i}") for i in range(bins)]
    mean = sum(cols[1:], cols[0]) / bins
    var = sum([(c - mean) * (c - mean) for c in cols[1:]], (cols[0] - mean) * (cols[0] - mean)) / bins
    return out.withColumn("bin_std", F.sqrt(var)).withColumn("bin_max", F.greatest(*cols))


def _block_arrays(envelope: DataFrame, before: int, after: int, value: str, block: int) -> DataFrame:
    """One row per (series, block): the block's values with neighbours, ordered; bounded by the block size."""
    around = with_halo(envelope.select("id", "frame", F.col(value).cast("double").alias("x")), "frame", before, after, block)
    pairs = F.array_sort(F.collect_list(F.struct("frame", "x")))
    arrays = around.groupBy("id", BLOCK).agg(
        pairs.alias("_p"), F.count_if(CORE).alias("core"), F.min(F.when(F.col(CORE), F.col("frame"))).alias("first"))
    return (arrays.filter("core > 0")
            .select("id", F.col("first"), F.col("core"), (F.col("first") - F.get("_p", F.lit(0))["frame"]).alias("lead"),
                    F.transform("_p", lambda p: p["x"]).alias("xs")))


def lag_autocorr(envelope: DataFrame, lags: int, value: str = "strength", block: int = 4096) -> DataFrame:
    """Sum of x[t] * x[t+lag] per series for lags 0..lags-1: id, lag, r."""

    @F.pandas_udf("array<double>")
    def products(xs: pd.Series, core: pd.Series) -> pd.Series:
        def one(x, c):
            c = int(c)
            x = np.concatenate((np.asarray(x, float), np.zeros(lags)))
            return [float(x[:c] @ x[k:k + c]) for k in range(lags)]
        return pd.Series([one(x, c) for x, c in zip(xs, core)])

    blocks = _block_arrays(envelope, 0, lags - 1, value, block)
    return (blocks.select("id", F.posexplode(products("xs", "core")).alias("lag", "r"))
            .groupBy("id", "lag").agg(F.sum("r").alias("r")))


def _block_rows(envelope: DataFrame, before: int, after: int, value: str, block: int) -> DataFrame:
    """Frames of each (series, block) with their neighbours, sorted by frame; for `_blocks`.

    The rows are numbers and compress well, but each means much work, so they are dealt out by their count, not by bytes.
    """
    frame = F.coalesce(F.col("frame").cast("long"), F.raise_error(F.lit(NOT_DENSE)).cast("long"))
    own = envelope.filter("id is not null").select("id", frame.alias("frame"), F.col(value).cast("double").alias("x"))
    tasks = max(1, -(-envelope.count() // FRAMES_PER_TASK))
    around = with_halo(own, "frame", before, after, block).select("id", BLOCK, "frame", "x")
    return around.repartition(tasks, "id", BLOCK).sortWithinPartitions("id", BLOCK, "frame")


def _blocks(batches: Iterable[pa.RecordBatch], before: int, block: int) -> Iterator[tuple[object, int, np.ndarray, int, int]]:
    """(id, first own frame, values with neighbours, values ahead of the first own one, own values) of `_block_rows`.

    Fails where the frames of a series are not 0..n-1, each once. A block sees the frame after its last one, so a gap between
    blocks shows as well.
    """
    def whole(key, parts):
        series, number = key
        frame, x = (np.concatenate(p) if len(p) > 1 else p[0] for p in zip(*parts))
        first = number * block
        if frame[-1] < first:                                # the end of a series that has no frame of this block
            return
        start = max(0, first - before)
        if frame[0] != start or frame[-1] != start + len(frame) - 1 or (np.diff(frame) != 1).any():
            raise ValueError(NOT_DENSE)
        yield series, first, x, first - start, min(block, len(x) - (first - start))

    key, parts = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, number = batch.column("id"), batch.column(BLOCK).to_numpy()
        frame, x = batch.column("frame").to_numpy(), batch.column("x").to_numpy(zero_copy_only=False)
        new = (number[1:] != number[:-1]) | pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            here = ids[a].as_py(), int(number[a])
            if parts and here != key:
                yield from whole(key, parts)
                parts = []
            key = here
            parts.append((frame[a:b], x[a:b]))
    if parts:
        yield from whole(key, parts)


def _padded(x: np.ndarray, left: int, right: int) -> np.ndarray:
    """Rows of x with ramps from 0 to the first value and from the last to 0."""
    return np.pad(x, ((0, 0), (left, right)), mode="linear_ramp", end_values=0.0)


def _local_lags(x: np.ndarray, size: int, tile: int) -> Iterator[np.ndarray]:
    """Local autocorrelation, lag by lag, of the frames of `size` values that start at the first `tile` columns: rows by frames.

    Frames are Hann windows, scaled to a maximum of 1, which is that of lag 0. A lag of a frame is a sum of products of values
    under a window that moves with the frame: a product of matrices for all rows and frames.
    """
    hann, zeros = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size), np.zeros(tile - 1)
    top = 1.0
    for k in range(size):
        long = tile + size - 1 - k
        moved = np.concatenate((zeros, hann[:size - k] * hann[k:], zeros))
        band = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(moved, tile)[:long, ::-1])
        r = (x[:, :long] * x[:, k:k + long]) @ band
        if not k:
            top = np.where(r < np.finfo(float).tiny, 1.0, r)
        r /= top
        yield r


def _mean_profiles(x: np.ndarray, size: int) -> np.ndarray:
    """The mean over its values of the local autocorrelation about each, for every row of x."""
    n, half = x.shape[1], size // 2
    padded, out = _padded(x, half, half), np.zeros((len(x), size))
    for at in range(0, n, TILE):
        tile = min(TILE, n - at)
        for k, r in enumerate(_local_lags(padded[:, at:at + tile + size - 1], size, tile)):
            out[:, k] += r.sum(axis=1)
    return out / n


def _block_moments(blocks: Sequence[tuple[np.ndarray, int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and sums of squared deviations by lag of the local autocorrelation in blocks (values, values ahead, own values)."""
    half, tiles, valid, firsts = size // 2, [], [], []
    for x, lead, core in blocks:
        behind = len(x) - lead - core
        # fewer neighbours than a frame reaches: the series ends there, and its ramp has its whole length
        left, right = half * (lead < half), half * (behind < half)
        whole = _padded(x[None, :], left, right)[0, left + lead - half:]
        count = -(-core // TILE)
        whole = np.concatenate((whole, np.zeros(max(0, count * TILE + size - 1 - len(whole)))))
        firsts.append(sum(map(len, tiles)))
        tiles.append(np.lib.stride_tricks.sliding_window_view(whole, TILE + size - 1)[:count * TILE:TILE])
        valid.append(np.arange(count * TILE).reshape(count, TILE) < core)
    x, own, n = np.concatenate(tiles), np.concatenate(valid), np.array([core for *_, core in blocks])
    many, means, spreads = np.diff([*firsts, len(x)]), np.zeros((len(blocks), size)), np.zeros((len(blocks), size))
    for k, r in enumerate(_local_lags(x, size, TILE)):
        means[:, k] = np.add.reduceat(r.sum(axis=1, where=own), firsts) / n
        away = r - np.repeat(means[:, k], many)[:, None]
        spreads[:, k] = np.add.reduceat((away * away).sum(axis=1, where=own), firsts)
    return means, spreads


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def lag_profile(envelope: DataFrame, lags: int = 192, value: str = "strength", block: int = 2048) -> DataFrame:
    """Mean and population deviation over time of the local autocorrelation: id, lag, mean, std.

    Centred Hann frames; a series end is padded by a ramp down to 0. A task holds the frames and the sums of a few blocks.
    """
    half, at_once = lags // 2, BLOCKS_AT_ONCE
    kind = to_arrow_type(envelope.schema["id"].dataType)

    def summed(batches):
        blocks = _blocks(batches, half, block)
        while some := list(islice(blocks, at_once)):
            means, spreads = _block_moments([(x, lead, core) for _, _, x, lead, core in some], lags)
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in some], kind), pa.array([b[-1] for b in some], pa.int64()), _lists(means), _lists(spreads)],
                                             names=["id", "c", "m", "v"])

    id_type = envelope.schema["id"].dataType.simpleString()
    rows = _block_rows(envelope, half, max(1, half), value, block)
    parts = rows.mapInArrow(summed, f"id {id_type}, c long, m array<double>, v array<double>")
    rows = parts.select("id", "c", F.posexplode(F.arrays_zip("m", "v")).alias("lag", "p"))
    c, m = F.col("c"), F.col("p.m")
    n, mean = F.sum("c"), F.sum(c * m) / F.sum("c")
    var = (F.sum(F.col("p.v")) + F.sum(c * m * m)) / n - mean * mean
    return rows.groupBy("id", "lag").agg(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def tempo(profile: DataFrame, frame_seconds: float, value: str = "mean") -> DataFrame:
    """Beats per minute and pulse clarity from a lag profile (id, lag, value).

    The lag is weighed by a log-normal prior about 120 beats per minute.
    """
    bpm = 60.0 / (F.col("lag") * F.lit(float(frame_seconds)))
    prior = -0.5 * F.pow(F.log2(bpm / TEMPO_CENTRE), F.lit(2.0))
    usable = (F.col("lag") > 0) & (bpm <= TEMPO_MAX)
    weight = F.when(usable, F.log1p(F.lit(1e6) * F.greatest(F.col(value), F.lit(0.0))) + prior)
    scored = profile.withColumn("_bpm", F.when(usable, bpm)).withColumn("_w", weight)
    # of equal weights the shorter lag wins
    return scored.groupBy("id").agg(
        F.max_by("_bpm", F.when(usable, F.struct(F.col("_w"), -F.col("lag")))).alias("tempo_bpm"),
        (F.max(value) / (F.avg(value) + F.lit(1e-8))).alias("tempo_confidence"))


def onset_windows(onsets: DataFrame, windows: DataFrame, win: int, hop: int, frame_seconds: float) -> DataFrame:
    """Onset count and interval statistics per window; both ends of an interval lie inside the window.

    Each onset is copied to the windows that cover it, so the join with the windows is on equal keys.
    """
    dt = F.lit(float(frame_seconds))
    gaps = intervals(onsets)
    lengths = windows.groupBy("id").agg(F.max("n").alias("n"))
    counts = onsets.groupBy("id").agg(F.count(F.lit(1)).alias(ROWS))
    sized = attach(gaps, lengths.join(counts, "id"), ["id"])
    at, n = F.floor(F.col("t") / dt).cast("long"), F.col("n").cast("long")
    last = F.greatest(n - win, F.lit(0))
    low = F.greatest(F.lit(0), F.ceil((at - win - 1) / hop)).cast("long")
    high = F.floor(F.least(at + 1, last) / hop).cast("long")
    starts = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * hop)).otherwise(F.array().cast("array<bigint>"))
    starts = F.array_distinct(F.concat(starts, F.array(last)))
    t0 = F.col("start") * dt
    t1 = F.least(F.col("start") + win, n) * dt
    rows = (sized.withColumn("start", F.explode(starts)).filter((F.col("t") >= t0) & (F.col("t") < t1))
            .withColumn("_gap", F.when(F.col("t_before") >= t0, F.col("ioi"))))
    return rows.groupBy("id", "start").agg(
        F.count(F.lit(1)).alias("events"), F.avg("_gap").alias("ioi_mean"), F.stddev_pop("_gap").alias("ioi_std"))


def window_tempo(envelope: DataFrame, win: int, hop: int, frame_seconds: float, lags: int = 192,
                 value: str = "strength", block: int = 1024) -> DataFrame:
    """Tempo and pulse clarity inside each window: id, start, tempo_bpm, tempo_confidence.

    Windows of one length are worked on together, some hundred at a time, whichever series they are of.
    """
    kind = to_arrow_type(envelope.schema["id"].dataType)
    at_once, most_held = VALUES_AT_ONCE, HELD_VALUES

    def starts(first, seen, core):
        # a block sees `win` frames beyond its own; where it sees fewer, the series ends, and the last window is known
        n = first + seen if seen < block + win else None
        at = np.arange(-(-first // hop) * hop, first + core, hop)
        if n is None:
            return at
        last = max(0, n - win)
        at = at[at <= last]
        return np.append(at, last) if last % hop and first <= last < first + core else at

    def found(held):
        x = np.concatenate([w for *_, w in held])
        size = min(lags, max(2, x.shape[1]))
        profile = _mean_profiles(x, size)
        bpm = 60.0 / (np.arange(1, size) * frame_seconds)
        weight = np.log1p(1e6 * np.maximum(profile[:, 1:], 0)) - 0.5 * np.log2(bpm / TEMPO_CENTRE) ** 2
        weight[:, bpm > TEMPO_MAX] = -np.inf
        best = np.where(np.isfinite(weight).any(axis=1), bpm[np.argmax(weight, axis=1)], 0.0)
        ids = [series for series, at, _ in held for _ in range(len(at))]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, kind), pa.array(np.concatenate([at for _, at, _ in held]), pa.int64()), pa.array(best),
            pa.array(profile.max(axis=1) / (profile.mean(axis=1) + 1e-8))], names=["id", "start", "tempo_bpm", "tempo_confidence"])

    def rows(batches):
        held, many = {}, {}
        for series, first, x, _, core in _blocks(batches, 0, block):
            at = starts(first, len(x), core)
            if not len(at):
                continue
            long = min(win, len(x))
            windows, room = np.lib.stride_tricks.sliding_window_view(x, long), max(1, at_once // long)
            for a in range(0, len(at), room):
                some = at[a:a + room]
                held.setdefault(long, []).append((series, some, windows[some - first]))
                many[long] = many.get(long, 0) + len(some)
                if many[long] >= room:
                    yield found(held.pop(long))
                    many[long] = 0
            if sum(n * size for size, n in many.items()) > most_held:      # short series of many lengths
                yield from map(found, held.values())
                held, many = {}, {}
        yield from map(found, held.values())

    id_type = envelope.schema["id"].dataType.simpleString()
    around = _block_rows(envelope, 0, win, value, block)
    return around.mapInArrow(rows, f"id {id_type}, start long, tempo_bpm double, tempo_confidence double")


def event_windows(onsets: DataFrame, envelope: DataFrame, win: int, hop: int, frame_seconds: float,
                  with_tempo: bool = False) -> DataFrame:
    """Rhythm row per window: density, strength mean/std/max, interval mean/std/cv, optionally tempo."""
    windows = window_table(envelope, win, hop)
    found = onset_windows(onsets, windows, win, hop, frame_seconds)
    strength = window_strength(envelope, win, hop)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    dt = F.lit(float(frame_seconds))
    t0, t1 = F.col("start") * dt, F.col("stop") * dt
    cv = F.when(F.col("ioi_mean") > 0, zero("ioi_std") / F.col("ioi_mean")).otherwise(0.0)
    out = windows.join(strength, ["id", "start"], "left").join(found, ["id", "start"], "left").select(
        "id", "start", t0.alias("t_start"), t1.alias("t_end"),
        (F.coalesce(F.col("events"), F.lit(0)) / (t1 - t0)).alias("onset_density"),
        zero("strength_mean").alias("onset_strength_mean"), zero("strength_std").alias("onset_strength_std"),
        zero("strength_max").alias("onset_strength_max"),
        zero("ioi_mean").alias("ioi_mean"), zero("ioi_std").alias("ioi_std"), cv.alias("ioi_cv"))
    if with_tempo:
        out = out.join(window_tempo(envelope, win, hop, frame_seconds), ["id", "start"], "left")
    return out


def window_values(rows: DataFrame) -> Column:
    """The nine channels of `event_windows(with_tempo=True)` as an array."""
    return F.array(*[F.col(c) for c in RHYTHM_NAMES])


def local_peaks(envelope: DataFrame, before: int, after: int, mean_before: int, mean_after: int, delta: float,
                value: str = "strength") -> DataFrame:
    """Frames above all `before` frames ahead of them, not below the next `after`, and above the local mean.

    Two peaks are more than min(before, after) frames apart, as one comparison is strict.
    """
    around = with_halo(envelope, "frame", max(before, mean_before), max(after, mean_after))
    by = Window.partitionBy("id", BLOCK).orderBy("frame")
    x = F.col(value)
    seen = around.withColumns({
        "_before": F.max(value).over(by.rowsBetween(-before, -1)),
        "_after": F.max(value).over(by.rowsBetween(1, max(after, 1))),
        "_mean": F.avg(value).over(by.rowsBetween(-mean_before, mean_after))})
    peak = F.coalesce(x > F.col("_before"), F.lit(True)) & (x >= F.col("_mean") + delta)
    if after:
        peak &= F.coalesce(x >= F.col("_after"), F.lit(True))
    return seen.filter(F.col(CORE) & peak).select("id", "frame", value)


def spaced_peaks(peaks: DataFrame, gap: int, value: str = "strength", block: int = DEFAULT_BLOCK) -> DataFrame:
    """The peaks that are left when of two at most `gap` frames apart the stronger stays, then the earlier; strongest first.

    A peak is settled once all stronger ones around it are. A block of frames, with its neighbours' peaks in reach, settles
    what depends on nothing open outside; the rest is settled in rounds over written rows. The strongest open
    peak is settled in every round, mostly almost all of them.
    """
    if gap < 0:
        raise ValueError("a gap is not negative")
    kind = peaks.schema["id"].dataType.simpleString()
    schema = f"id {kind}, frame long, value double, kept boolean, source {peaks.schema[value].dataType.simpleString()}"
    here = peaks.select("id", F.col("frame").cast("long").alias("frame"), F.col(value).cast("double").alias("value"), F.lit(None).cast("boolean").alias("kept"),
                        F.col(value).alias("source"))
    written = None
    while True:
        around = with_halo(here, "frame", gap, gap, block).select("id", BLOCK, "frame", "value", "kept", "source", CORE)
        grouped = around.repartition("id", BLOCK).sortWithinPartitions("id", BLOCK, "frame")
        further = settled(grouped.mapInArrow(lambda batches: _settle_peaks(batches, gap), schema))
        if written is not None:
            forget(written)
        here = written = further
        if not here.filter("kept is null").limit(1).count():
            return here.filter("kept").select("id", "frame", F.col("source").alias(value))


def _settle_peaks(batches, gap: int):
    """The own peaks of each block with what could be settled; the input is sorted by id, block and frame."""
    def settle(rows: pa.Table) -> pa.Table:
        frame, value = rows.column("frame").to_numpy(), rows.column("value").to_numpy()
        own = rows.column(CORE).to_numpy(zero_copy_only=False).astype(bool)
        state = [None if s is None else bool(s) for s in rows.column("kept").to_pylist()]
        first, last = np.searchsorted(frame, frame - gap, "left"), np.searchsorted(frame, frame + gap, "right")
        for k in np.lexsort((frame, -value)).tolist():
            if state[k] is not None or not own[k]:
                continue
            stronger = [state[j] for j in range(first[k], last[k]) if (value[j], -frame[j]) > (value[k], -frame[k])]
            if True in stronger:
                state[k] = False
            elif None not in stronger:
                state[k] = True
        out = rows.select(["id", "frame", "value", "kept", "source"]).set_column(3, "kept", pa.array(state, pa.bool_()))
        return out.filter(pa.array(own))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("id").to_pylist(), batch.column(BLOCK).to_pylist()))
        cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if held and (held[0].column("id")[0].as_py(), held[0].column(BLOCK)[0].as_py()) != keys[a]:
                yield from settle(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from settle(pa.Table.from_batches(held)).to_batches()
