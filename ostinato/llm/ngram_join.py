"""N-gram Jaccard self-join by prefixes and tries, and the groups that its links connect.

A text is the set of its word n-grams (64-bit hashes). Texts of equal sets are one node. N-grams have one
global order: those of few nodes first, by hash, then the frequent ones by number of nodes. Of two sets that are
similar enough, the first n - ceil(t n) + COMMON n-grams of the larger and the first n - ceil(2 t / (1 + t) n) +
COMMON of the smaller have at least `COMMON` n-grams in common (all that they share, where that is less), so
only these are keys. The candidates of a node are read as a trie of their ordered sets: partial overlaps with
the node are counted once for all sets below, and a subtree is left as soon as its remaining length cannot
reach the threshold.

Connecting needs no list of all pairs. In each of the first rounds a key links its nodes to one of them (first
the one with the fewest n-grams of its own, the centre of a family of copies), and only nodes of other groups;
nodes of a key that are already in one group are never compared. The last round compares, for every key, what
is still in different groups, so no link between groups is missed. There keys with the same smallest group are a family; its
nodes are dealt to tiles of two blocks, with bitmaps of each set, which come once and not for every key. A tile counts the keys
that each two of its nodes share. Bits that differ come of n-grams that differ, so each bitmap bounds the overlap from above. Pairs
that a bound rules out never become rows, the others once per family, and texts are fetched for these alone. A key has few nodes
unless it is frequent, and frequent keys come last in the order.

Words and n-grams have 64-bit hashes. A set has a 64-bit number; its size and a second hash are compared over all texts,
and if two sets have one number, all are numbered again with another seed.

Defined cases: a text without words (or null) has an empty set and links with nothing; fewer than n words are
one n-gram; repeated rows and null ids are answered each, a group's id is the smallest id in it; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.llm.batches import distinct, flat, fold, map_texts, runs, slices
from ostinato.llm.graph import components
from ostinato.llm.storage import as_table, drop_rows, dropped, with_row_no, written

SIZE = 4                      # words of an n-gram
PERCENT = 85
COMMON = 4                    # prefix n-grams that a pair must share (fewer if its overlap may be smaller)
FREQUENT = 8                  # nodes from which an n-gram may count as frequent
MAX_FREQUENT = 1_000_000       # frequent n-grams that go to every task; the bound of FREQUENT rises until they fit
KEY_ROWS = 50_000             # nodes of a key beyond which its rows are dealt out by salt
STAR_ROUNDS = 2
OWN = 1 << 20                 # more than the n-grams of one text that are counted as its own
BLOCK = 256                   # candidates in one trie
TILE = 1024                   # nodes of a block; two blocks meet at once
TILE_SHINGLES = 1 << 24       # n-grams of a block's sets
MAPS = 4                      # bitmaps of a set
MAP_SHIFTS = np.arange(MAPS, dtype=np.uint64) * np.uint64(11)
SEND_TEXTS = 200_000          # ids of wanted texts up to which they are broadcast
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX[0]
    h = (h ^ (h >> np.uint64(29))) * MIX[1]
    return h ^ (h >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20             # bytes hashed at once


@functools.lru_cache(maxsize=8)
def places(size: int) -> np.ndarray:
    """A factor for each place of a word in its n-gram."""
    return mixed(np.arange(1001, 1001 + size, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def word_hashes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """64-bit hash of each word among the runs between `bounds`; equal words are hashed once."""
    codes, spans = distinct(data, bounds)
    seen = np.fromiter(map(xxhash.xxh3_64_intdigest, spans.to_pylist()), np.uint64, len(spans))
    return seen[codes[is_word]] if len(seen) else np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    data, offsets = flat(column)
    bounds, is_word = runs(data, offsets)
    rows = np.searchsorted(bounds[:-1][is_word], offsets)
    word = word_hashes(fold(data), bounds, is_word)
    total = len(word) - size + 1
    whole = np.zeros(len(word), np.uint64)
    if total > 0:
        for k in range(size):
            whole[:total] += word[k:total + k] * places(size)[k]
        whole = mixed(whole)
    cuts = rows.tolist()
    for first, last in zip(cuts, cuts[1:]):
        if last - first >= size:
            whole[first:last - size + 1].sort()
        elif last > first:
            whole[first] = xxhash.xxh3_64_intdigest(word[first:last].tobytes(), last - first)
    fresh = np.ones(len(word), bool)
    fresh[1:] = whole[1:] != whole[:-1]
    out = []
    for first, last in zip(cuts, cuts[1:]):
        end = last - size + 1 if last - first >= size else min(last, first + 1)
        if end > first:
            keep = fresh[first:end]
            keep[0] = True
            out.append(whole[first:end][keep])
        else:
            out.append(whole[first:first])
    return out


def node_of(shingles: np.ndarray, seed: int = 0) -> int:
    """Number of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed)).astype(np.int64)) if len(shingles) else 0


def width_of(n: int) -> int:
    """Bits in a bitmap of a set of n."""
    return 1 << max(6, (2 * n - 1).bit_length())


def bitmap(shingles: np.ndarray) -> bytes:
    """`MAPS` bitmaps by different bits of the hashes: for each remainder whether an odd number of n-grams has it."""
    if not len(shingles):
        return b""
    width = width_of(len(shingles))
    place = (shingles[None, :] >> MAP_SHIFTS[:, None]) & np.uint64(width - 1)
    odd = np.bincount((place + np.arange(MAPS, dtype=np.uint64)[:, None] * np.uint64(width)).astype(np.int64).ravel(), minlength=MAPS * width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def needed(n: int, percent: int = PERCENT) -> int:
    """Overlap that a set of n needs with any similar set."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """First n-grams of a set that meet those of any smaller set."""
    return min(n, n - needed(n, percent) + COMMON)


def short_length(n: int, percent: int = PERCENT) -> int:
    """First n-grams of a set that meet those of any set at least as large."""
    return min(n, n + -(2 * percent * n) // (100 + percent) + COMMON)


def node_rows(texts: DataFrame, size: int = SIZE) -> tuple[DataFrame, int]:
    """(row_no, id, node, n, bits) of every row of texts(row_no, id, text), written, and the seed of the node numbers."""
    kind = dict(texts.dtypes)["id"]
    seed = 0
    while True:
        def run(batch: pa.RecordBatch, seed=seed) -> dict:
            sets = shingle_sets(batch.column("text"), size)
            return {"row_no": batch.column("row_no"), "id": batch.column("id"), "node": pa.array([node_of(s, seed) for s in sets], pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()), "bits": pa.array(map(bitmap, sets), pa.binary()),
                    "other": pa.array([node_of(s, seed + 1_000_003) for s in sets], pa.int64())}

        rows = written(map_texts(texts, run, f"row_no long, id {kind}, node long, n long, bits binary, other long"))
        same = rows.groupBy("node").agg(F.min(F.struct("n", "other")).alias("lo"), F.max(F.struct("n", "other")).alias("hi"))
        if same.filter("lo != hi").limit(1).count() == 0:
            return rows.drop("other"), seed
        seed += 1


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_row_no(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def frequent_shingles(texts: DataFrame, percent: int, size: int = SIZE, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams near the front of the hash order, ascending, and their numbers of nodes.

    Counted over all texts, for the n-grams that lie in the first part of a text's hash order (a quarter more
    than a prefix): n-grams further back become keys only of texts whose front is frequent throughout.
    """
    def run(batch: pa.RecordBatch) -> dict | None:
        seen, found = set(), []
        for s in shingle_sets(batch.column("text"), size):
            node = node_of(s, number)
            if len(s) and node not in seen:
                seen.add(node)
                found.append(s[:prefix_length(len(s), percent) * 5 // 4])
        if not found:
            return None
        key, n = np.unique(np.concatenate(found), return_counts=True)
        return {"key": pa.array(key.view(np.int64)), "n": pa.array(n, pa.int64())}

    counts = map_texts(texts, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    kept = written(counts)
    sizes = sorted(((r["k"], r["count"]) for r in kept.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()), reverse=True)
    least, held = None, 0
    for k, n in sizes:
        if held + n > MAX_FREQUENT:
            break
        least, held = 2 ** k, held + n
    if not held:
        dropped(kept)
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = kept.filter(F.col("n") >= least).toArrow()
    dropped(kept)
    key = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], table["n"].to_numpy()[order]


def prefix_keys(texts: DataFrame, percent: int, size: int = SIZE, number: int = 0) -> DataFrame:
    """(key, salt, hot, node, info): the first n-grams of every node in the global order.

    info holds the set's size, the number of its n-grams that are not frequent, and whether the n-gram is among the
    first `short_length`.
    """
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts, percent, size, number))

    def run(batch: pa.RecordBatch) -> dict | None:
        hot, rows = frequent.value
        seen, keys, salts, hots, nodes, infos = set(), [], [], [], [], []
        for s in shingle_sets(batch.column("text"), size):
            node = node_of(s, number)
            if not len(s) or node in seen:
                continue
            seen.add(node)
            count = np.zeros(len(s), np.int64)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                known = hot[place] == s
                count[known] = rows[place[known]]
            take = np.argsort(count, kind="stable")[:prefix_length(len(s), percent)]
            keys.append(s[take])
            salts.append(node % (1 + count[take] // KEY_ROWS))
            hots.append(count[take] > KEY_ROWS)
            nodes.append(np.full(len(take), node))
            own = min(int((count[:prefix_length(len(s), percent) * 5 // 4] == 0).sum()), OWN - 1)
            infos.append((len(s) * OWN + own) * 2 + (np.arange(len(take)) < short_length(len(s), percent)))
        if not keys:
            return None
        return {"key": pa.array(np.concatenate(keys).view(np.int64)), "salt": pa.array(np.concatenate(salts), pa.int64()), "hot": pa.array(np.concatenate(hots)),
                "node": pa.array(np.concatenate(nodes), pa.int64()), "info": pa.array(np.concatenate(infos), pa.int64())}

    return map_texts(texts, run, "key long, salt long, hot boolean, node long, info long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, node, n, own, short): the key rows of distinct nodes whose key another node has, written.

    Rows of a key with very many nodes are dealt out by salt as well; they stay without a look at the others.
    """
    part = Window.partitionBy("key", "salt")
    rows = keys.withColumn("least", F.min("node").over(part)).withColumn("most", F.max("node").over(part)).filter("least != most or hot")
    rest = F.shiftright("info", 1)
    return written(rows.select("key", "node", F.floor(rest / OWN).alias("n"), F.pmod(rest, F.lit(OWN)).alias("own"), (F.col("info") % 2 == 1).alias("short")).distinct())


def star_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """The `possible` pairs of one node of each key with the nodes of other groups in the key, written."""
    order = F.xxhash64("label", F.lit(turn)) if turn else F.col("own")
    first = F.min(F.struct(order.alias("order"), "node", "n", "label")).alias("first")
    firsts = written(rows.groupBy("key").agg(first))           # partial sums; the join then has a plain shuffle on both sides
    star = rows.join(firsts, "key").filter("first.label != label")
    swapped = F.col("node") < F.col("first.node")
    def pick(when_lower, when_higher, name):
        return F.when(swapped, F.col(when_lower)).otherwise(F.col(when_higher)).alias(name)
    met = star.select(pick("node", "first.node", "a"), pick("first.node", "node", "b"), pick("n", "first.n", "n"), pick("first.n", "n", "m"), F.lit(1).alias("shared"))
    out = written(possible(met, percent))
    dropped(firsts)
    return out


def possible(met: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of met(a, b, n, m, shared) whose sizes and number of shared keys allow the threshold."""
    pairs = met.groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("common"))
    small, large = F.least("n", "m"), F.greatest("n", "m")
    overlap = F.ceil((F.col("n") + F.col("m")) * F.lit(percent) / F.lit(100 + percent))
    return pairs.filter((small * 100 >= large * percent) & (F.col("common") >= F.least(F.lit(COMMON), overlap - 1))).select("a", "b")


def open_keys(rows: DataFrame) -> DataFrame:
    """(key, alone, family, blocks, node, n, label, own, short): the rows of keys with nodes of different groups, written.

    Keys whose smallest group is the same are a family and are compared together, so that a set goes to a family once and
    not once per key. A family's nodes are dealt to blocks by their number and size. A key of fewer nodes than its family
    has blocks is a family of its own (`alone`), as its nodes would go to nearly as many blocks as they have partners.
    """
    ends = written(rows.groupBy("key").agg(F.min("label").alias("family"), F.max("label").alias("hi"), F.bool_or("short").alias("any"), F.count(F.lit(1)).alias("m"))
                   .filter("family != hi and any").select("key", "family", "m"))
    found = written(rows.join(ends, "key").select("key", "family", "m", "node", "n", "label", "short"))
    sizes = written(found.select("family", "node", "n").distinct().groupBy("family")
                    .agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).alias("blocks")))
    alone = F.col("m") < F.col("blocks")
    blocks = F.when(alone, 1).otherwise(F.col("blocks"))
    out = written(found.join(sizes, "family").select(
        "key", alone.alias("alone"), F.when(alone, F.col("key")).otherwise(F.col("family")).alias("family"), blocks.alias("blocks"), "node", "n", "label",
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), "short"))
    dropped(ends, found, sizes)
    return out


def crossing_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The `possible` pairs of all nodes of different groups that share keys and whose bitmaps allow the threshold, written.

    A tile holds two blocks of a family: the bitmaps of their nodes, once, and then the rows of its keys, one key after the other.
    """
    found = open_keys(rows)
    maps = written(nodes.join(found.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max("bits").alias("bits")))
    several = found.filter("blocks > 1")
    others = several.select("alone", "family", "key", F.col("own").alias("other")).distinct()
    dealt = found.filter("blocks = 1").withColumn("other", F.col("own")).unionByName(several.join(others, ["alone", "family", "key"]).select(*found.columns, "other"))
    tile = ["alone", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    members = dealt.select(*tile, "node", "n", "label", "own").distinct().join(maps, "node")
    stream = dealt.select(*tile, "key", "node", "short").unionByName(members, allowMissingColumns=True)
    order = ["alone", "family", "i", "j"]

    def run(batches):
        tile, name = None, None
        for part in (part for batch in batches for part in slices(batch, "bits", SEGMENT)):
            names = np.stack([part.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in order])
            cuts = (np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, part.num_rows]):
                if name != names[:, a].tolist():
                    if tile is not None:
                        yield tile.matches(percent)
                    name = names[:, a].tolist()
                    tile = Tile(crossing=name[2] != name[3])
                rows = part.slice(a, b - a)
                described = rows.column("key").null_count
                if described:
                    tile.add(rows.slice(0, described))
                if described < b - a:
                    rows = rows.slice(described)
                    tile.meet(*(rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "short")))
        if tile is not None:
            yield tile.matches(percent)

    met = stream.repartition(*order).sortWithinPartitions(*order, F.col("key").asc_nulls_first()).mapInArrow(
        run, "a long, b long, n long, m long, shared long")
    out = written(possible(met, percent))
    dropped(found, maps)
    return out


class Tile:
    """Nodes of two blocks of a family and, for each two of them, the number of keys in which they met.

    `add` takes the nodes, then `meet` the rows of the keys in order of the key, both in parts of any length.
    """

    def __init__(self, crossing: bool):
        self.crossing, self.parts, self.shared = crossing, [], None
        self.key, self.at, self.short = None, [], []          # rows of the key that is not yet complete

    def add(self, nodes: pa.RecordBatch) -> None:
        self.parts.append(nodes.select(["node", "n", "label", "own", "bits"]))

    def settle(self) -> None:
        """The nodes in order of size."""
        nodes = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        order = np.lexsort((nodes.column("node").to_numpy(), nodes.column("n").to_numpy()))
        self.node, self.n, self.label, self.own = (nodes.column(c).to_numpy()[order] for c in ("node", "n", "label", "own"))
        self.bits = nodes.column("bits").take(pa.array(order))
        self.by_node = np.argsort(self.node)
        self.shared = np.zeros((len(order), len(order)), np.int32)

    def meet(self, keys: np.ndarray, nodes: np.ndarray, short: np.ndarray) -> None:
        if self.shared is None:
            self.settle()
        at = self.by_node[np.searchsorted(self.node, nodes, sorter=self.by_node)]
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if keys[a] != self.key:
                self.count()
                self.key = keys[a]
            self.at.append(at[a:b])
            self.short.append(short[a:b].astype(bool))

    def count(self) -> None:
        """Adds the complete key: a node in its short prefix meets all nodes of the key."""
        if self.at:
            at, short = np.concatenate(self.at), np.concatenate(self.short)
            self.shared[np.ix_(at[short], at)] += 1
            self.at, self.short = [], []

    def matches(self, percent: int) -> pa.RecordBatch:
        """(a, b, n, m, shared) of the pairs of different groups and, in a tile of two blocks, of different blocks, that met in a
        short key of the smaller set and whose bits that differ leave enough for the overlap."""
        self.count()
        node, n, label, own, shared = self.node, self.n, self.label, self.own, self.shared
        width = np.array([width_of(int(x)) for x in n]) // 64
        maps, folded, first = {}, {}, {}
        for w in np.unique(width).tolist():              # sets of one width follow each other, as they are sorted by size
            inside = np.flatnonzero(width == w)
            first[w] = int(inside[0])
            maps[w] = np.frombuffer(b"".join(self.bits.slice(first[w], len(inside)).to_pylist()), np.uint64).reshape(-1, MAPS, w)
            folded[w] = maps[w][:, :, :w // 2] ^ maps[w][:, :, w // 2:] if w > 1 else None
        reach = np.searchsorted(n, n * 100 // percent, "right")
        left, right = [], []
        for k in np.flatnonzero(shared.any(axis=1)).tolist():
            near = np.flatnonzero(shared[k, k + 1:reach[k]]) + k + 1
            near = near[(label[near] != label[k]) & ((own[near] != own[k]) | (not self.crossing))]
            w = int(width[k])
            for wide, table in ((w, maps), (2 * w, folded)):
                some = near[width[near] == wide]
                if len(some):
                    apart = np.bitwise_count(table[wide][some - first[wide]] ^ maps[w][k - first[w]]).sum(axis=2, dtype=np.int64).max(axis=1)
                    both = n[k] + n[some]
                    some = some[both - apart >= 2 * -(-both * percent // (100 + percent))]
                    left.append(np.full(len(some), k))
                    right.append(some)
        x, y = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
        a, b = np.where(node[x] > node[y], y, x), np.where(node[x] > node[y], x, y)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (node[a], node[b], n[a], n[b], shared[x, y])], names=["a", "b", "n", "m", "shared"])


def trie_matches(probe: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Numbers of the sets that are similar to `probe`: a walk over the trie of the ordered sets.

    The sets are sorted, so a trie node is a range of them with a common run; its run is looked up in the
    probe once. `reach` bounds what a subtree can still add by what is left of the probe and of its longest set.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
    ordered = [sets[k] for k in order]
    size = np.array([len(s) for s in ordered])
    found = []
    todo = [(0, len(ordered), 0, 0)]
    while todo:
        lo, hi, depth, overlap = todo.pop()
        first, last = ordered[lo], ordered[hi - 1]
        shortest, longest = int(size[lo:hi].min()), int(size[lo:hi].max())
        wanted = -(-percent * (len(probe) + shortest) // (100 + percent))
        if depth < shortest:
            left = len(probe) - int(np.searchsorted(probe, first[depth]))
            if overlap + min(left, longest - depth) < wanted:
                continue
        same = first[depth:shortest] != last[depth:shortest]
        run = int(same.argmax()) if same.any() else shortest - depth
        if run:
            part = first[depth:depth + run]
            place = np.searchsorted(probe, part)
            overlap += int((probe[np.minimum(place, len(probe) - 1)] == part).sum())
            depth += run
        at = lo
        while at < hi and size[at] == depth:
            if 100 * overlap >= percent * (len(probe) + depth - overlap):
                found.append(order[at])
            at += 1
        while at < hi:
            value, to = ordered[at][depth], at + 1
            while to < hi and ordered[to][depth] == value:
                to += 1
            todo.append((at, to, depth, overlap))
            at = to
    return found


def verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int = SIZE) -> DataFrame:
    """The pairs (a, b) that are similar, written. texts(node, text) has every node once.

    The texts of b go to blocks of a; a task reads the blocks one after the other and holds one at a time.
    """
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("candidates"))
    blocks = pairs.join(sizes, "a").withColumn("block", F.pmod("b", 1 + F.floor(F.col("candidates") / BLOCK)).cast("int")).select("a", "block", "b")
    blocks = written(blocks)
    probes = blocks.select("a", "block").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    partners = blocks.join(texts.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "text")
    stream = probes.unionByName(partners).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches):
        key, probe, names, sets = None, None, [], []

        def matches():
            hits = trie_matches(probe, sets, percent) if sets else []
            return {"a": pa.array([key[0]] * len(hits), pa.int64()), "b": pa.array([names[k] for k in hits], pa.int64())}

        for part in (part for batch in batches for part in slices(batch, "text", SEGMENT)):
            for a, block, b, s in zip(part.column("a").to_pylist(), part.column("block").to_pylist(), part.column("b").to_pylist(),
                                      shingle_sets(part.column("text"), size)):
                if b is None:
                    if key is not None:
                        yield pa.RecordBatch.from_pydict(matches())
                    key, probe, names, sets = (a, block), s, [], []
                else:
                    names.append(b)
                    sets.append(s)
                    if len(sets) >= BLOCK:
                        yield pa.RecordBatch.from_pydict(matches())
                        names, sets = [], []
        if key is not None:
            yield pa.RecordBatch.from_pydict(matches())

    out = written(stream.mapInArrow(run, "a long, b long"))
    dropped(blocks)
    return out


def wanted_texts(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of all nodes in the pairs, written; the ids are sent to the scan only if they are few."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = written(nodes.groupBy("node").agg(F.min("row_no").alias("row_no")).join(wanted, "node"))
    few = rows.count() <= SEND_TEXTS
    out = written(docs.join(F.broadcast(rows) if few else rows, "row_no").select("node", "text"))
    dropped(rows)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """(row_no, id, n_shingles, component_id) of every row; row_no as `with_row_no(as_table(docs))` gives it."""
    docs = as_table(docs)
    texts = numbered(docs, id_col, text_col)
    nodes, number = node_rows(texts, size)
    keys = shared_keys(prefix_keys(docs.select(F.col(text_col).alias("text")), percent, size, number))
    labelled = keys.withColumn("label", F.col("node"))
    links, groups = None, None
    for turn in range(STAR_ROUNDS + 1):
        pairs = star_pairs(labelled, turn, percent) if turn < STAR_ROUNDS else crossing_pairs(labelled, nodes, percent)
        wanted = wanted_texts(pairs, nodes, texts)
        found = verified(pairs, wanted, percent, size)
        dropped(pairs, wanted)
        links = found if links is None else links.unionByName(found)
        if groups is not None:
            dropped(groups)
        groups = components(links)
        labelled = keys.join(groups.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    dropped(keys)
    labels = nodes.filter("n > 0").groupBy("node").agg(F.min("id").alias("least")).join(groups, "node", "left").select(
        "node", "least", F.coalesce("component", "node").alias("component"))
    of_group = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = written(labels.select("node", "component").join(written(of_group), "component").select("node", "component_id", "component"))
    return nodes.join(of_node, "node", "left").select(
        "row_no", "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component")).alias("component"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """One row of each group, the one with the smallest id (of repeated ids the first row); empty texts stay."""
    docs = as_table(docs)
    rows = written(similar_groups(docs, id_col, text_col, percent, size))
    first = written(rows.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_no")).alias("first"))
                    .select("component", F.col("first.row_no").alias("kept_row")))
    return drop_rows(docs, rows.join(first, "component").filter("row_no != kept_row"))
