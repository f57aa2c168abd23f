"""Spelling variants: words that one inserted, deleted or replaced letter parts, by a dictionary of trie-node pairs.

The words lie in a trie, their reversals in another. A word without its letter at a place is the pair (node of what is
before it, node of what is after it), two integers. Words that share such a pair differ by that letter; a word that has
the same pair of nodes between two of its letters is the first one with the letter deleted. So one grouping by pairs
finds every neighbour and nothing else, and no pair holds more words than the alphabet has letters.

The nodes of a trie are numbered in the order of the sorted words: a word adds as many nodes as it has letters beyond
what it shares with the word before. Each range of the sorted words numbers its own nodes; nodes of the path to its first
word that an earlier range has too take that range's number (one row per range is carried over).

Defined cases: a null text has no words; a null id counts as the empty text in the drawn deletions; a run may be as long as
the text (its nodes are numbers, no part of it is copied); an empty table gives no rows; repeated rows count as often as
they occur; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.batches import flat
from ostinato.llm.exact_dedup import fold_ascii
from ostinato.llm.storage import dropped, written

LETTERS = "a-zÀ-ÿ"          # after lower-casing A-Z; each is one byte of Latin-1
LEAST_LETTERS, LEAST_TIMES, RATIO = 5, 3, 2
SPOIL = 97                            # one run in so many loses a letter
WORDS_PER_TASK = 200_000
PART_SHIFT = 40                       # of a node number, for the range it was numbered in


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(id, run): the maximal runs of at least `least` letters of all texts, A-Z in lower case."""
    text = fold_ascii(F.coalesce(F.col(text_col), F.lit("")))
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def spoiled(runs: DataFrame) -> DataFrame:
    """`word`: the run, or for one (id, run) in 97, by its CRC-32, the run without one letter."""
    drawn = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    place = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    return drawn.select(F.when(F.col("h") % SPOIL == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_TIMES, per_task: int = WORDS_PER_TASK) -> DataFrame:
    """(word_id, word, n), written: words of enough letters that occur often enough; ids rise in code-point order."""
    counts = written(words.filter(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times))
    ordered = counts.repartitionByRange(ranges(counts, per_task), "word").sortWithinPartitions("word")
    out = written(ordered.select(F.monotonically_increasing_id().alias("word_id"), "word", "n"))
    dropped(counts)
    return out


def ranges(table: DataFrame, per_task: int) -> int:
    return max(1, -(-table.count() // per_task))


def shared_lengths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the row before it, from the front; 0 for the first."""
    size = np.diff(offsets)
    both = np.minimum(size[1:], size[:-1]) if len(size) > 1 else np.zeros(0, np.int64)
    out = np.zeros(len(size), np.int64)
    open_rows, depth = np.flatnonzero(both > 0), 0
    while len(open_rows):
        same = data[offsets[open_rows] + depth] == data[offsets[open_rows + 1] + depth]
        depth += 1
        open_rows = open_rows[same]
        out[open_rows + 1] = depth
        open_rows = open_rows[both[open_rows] > depth]
    return out


def trie_nodes(rows: DataFrame, order: Column, per_task: int = WORDS_PER_TASK) -> DataFrame:
    """(word_id, spelled, path), written: for rows(word_id, spelled binary) the node numbers of all prefixes of `spelled`, the empty one first.

    `order` sorts as the bytes of `spelled` do. Equal prefixes have equal numbers, different ones different numbers; the root is 0.
    """
    keyed = rows.select("word_id", "spelled", order.alias("order"))
    sorted_rows = keyed.repartitionByRange(ranges(rows, per_task), "order").sortWithinPartitions("order").select("word_id", "spelled")

    def run(batches):
        task = TaskContext.get().partitionId()
        path, last, used, own, first = np.zeros(1, np.int64), b"", task << PART_SHIFT, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column("spelled"))
            # the last word of the batch before stands in front, so the first word here is compared with it
            data = np.concatenate((np.frombuffer(last, np.uint8), data))
            offsets = np.concatenate(([0], offsets + len(last)))
            shared, size = shared_lengths(data, offsets)[1:].tolist(), np.diff(offsets)[1:].tolist()
            paths, inherited = [], []
            for common, length in zip(shared, size):
                path = np.concatenate((path[:common + 1], np.arange(used + 1, used + 1 + length - common)))
                used += length - common
                own = length if first else min(own, common)
                first = False
                paths.append(path)
                inherited.append(own)
            last = data[offsets[-2]:].tobytes()
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in paths])))
            yield pa.RecordBatch.from_arrays([
                batch.column("word_id"), batch.column("spelled"), pa.array([task] * len(paths), pa.int32()), pa.array(inherited, pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(paths)))],
                names=["word_id", "spelled", "part", "own", "path"])

    local = written(sorted_rows.mapInArrow(run, "word_id long, spelled binary, part int, own long, path array<long>"))
    edges = local.groupBy("part").agg(F.min_by("spelled", F.col("spelled")).alias("first"), F.max_by(F.struct("spelled", "own", "path"), "spelled").alias("last"))
    carried, canon, before = [], None, None
    for row in edges.orderBy("part").collect():          # one row per range
        common = 0
        if before is not None:
            while common < min(len(before), len(row["first"])) and before[common] == row["first"][common]:
                common += 1
            carried.append((row["part"], canon[:common + 1]))
        kept = min(row["last"]["own"], common)
        canon = [*(canon[:kept + 1] if canon else [0]), *row["last"]["path"][kept + 1:]]
        before = row["last"]["spelled"]
    if not carried:
        return local.select("word_id", "spelled", "path")
    alias = local.sparkSession.createDataFrame(carried, "part int, alias array<long>")
    taken = F.when(F.col("alias").isNull(), 1).otherwise(F.least(F.col("own").cast("int") + 1, F.size("alias")))
    whole = F.when(taken > 1, F.concat(F.slice("alias", F.lit(1), taken), F.slice("path", taken + 1, F.size("path")))).otherwise(F.col("path"))
    return local.join(F.broadcast(alias), "part", "left").select("word_id", "spelled", whole.alias("path"))


def node_pairs(words: DataFrame, per_task: int = WORDS_PER_TASK) -> DataFrame:
    """(before, after, skips, fresh, word_id, n): the node pairs of each word.

    With `skips` the pair leaves out one letter; `fresh` is true unless the letter before is the same one, so each
    shorter word comes once. Without, it is a place between two letters.
    """
    spelled = lambda w: F.encode(w, "ISO-8859-1")
    there = trie_nodes(words.select("word_id", spelled(F.col("word")).alias("spelled")), F.col("spelled"), per_task)
    back = trie_nodes(words.select("word_id", spelled(F.reverse("word")).alias("spelled")), F.col("spelled"), per_task)
    both = there.join(back.select("word_id", F.reverse("path").alias("rest")), "word_id").join(words, "word_id")
    both = written(both.select("word_id", "n", "path", "rest", letter_starts(F.col("word")).alias("fresh")))
    n = F.size("path") - 1
    skip = F.arrays_zip(F.slice("path", F.lit(1), n).alias("before"), F.slice("rest", F.lit(2), n).alias("after"), F.col("fresh"))
    split = F.arrays_zip(F.col("path").alias("before"), F.col("rest").alias("after"))
    return both.select("word_id", "n", F.inline(skip)).withColumn("skips", F.lit(True)).unionByName(
        both.select("word_id", "n", F.inline(split)).withColumns({"fresh": F.lit(False), "skips": F.lit(False)}))


def letter_starts(word: Column) -> Column:
    """For each letter whether another one, or none, stands before it."""
    letters = F.regexp_extract_all(word, F.lit("."), F.lit(0))
    moved = F.concat(F.array(F.lit("")), F.slice(letters, F.lit(1), F.size(letters) - 1))
    return F.zip_with(letters, moved, lambda a, b: a != b)


def near_words(pairs: DataFrame) -> DataFrame:
    """(word_id, n_near, near_n, near_id): how many words are near, and the one of them with the largest n, then smallest id.

    A pair holds at most one word of each letter and one word between whose letters it lies.
    """
    entry = F.struct("n", (-F.col("word_id")).alias("rank"), "fresh")
    by_pair = pairs.groupBy("before", "after").agg(
        F.sort_array(F.collect_list(F.when(F.col("skips"), entry)), asc=False).alias("members"),
        F.max(F.when(~F.col("skips"), F.struct("n", (-F.col("word_id")).alias("rank")))).alias("base"))
    by_pair = by_pair.filter(F.size("members") + F.col("base").isNotNull().cast("int") > 1)
    plain = lambda m: F.struct(m["n"].alias("n"), m["rank"].alias("rank"))
    first, second, base = F.get("members", F.lit(0)), F.get("members", F.lit(1)), F.col("base")

    def of_member(m):
        other = F.when(m["rank"] == first["rank"], plain(second)).otherwise(plain(first))
        other = F.when(F.size("members") > 1, other)
        shorter = F.when(m["fresh"], base)
        return F.struct((-m["rank"]).alias("word_id"), (F.size("members") - 1 + shorter.isNotNull().cast("int")).cast("long").alias("k"),
                        F.greatest(other, shorter).alias("best"))
    longer = F.filter("members", lambda m: m["fresh"])
    of_base = F.when(base.isNotNull() & (F.size(longer) > 0), F.array(F.struct(
        (-base["rank"]).alias("word_id"), F.size(longer).cast("long").alias("k"), plain(F.get(longer, F.lit(0))).alias("best"))))
    found = by_pair.select(F.explode(F.transform("members", of_member)).alias("x")).unionByName(by_pair.select(F.explode(of_base).alias("x")))
    return (found.select("x.*").filter("k > 0").groupBy("word_id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
            .select("word_id", "n_near", F.col("best.n").alias("near_n"), (-F.col("best.rank")).alias("near_id")))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word_id, root_id) for forms(word_id, form_id): the end of each chain, which doubles its reach in every round.

    A form occurs at least twice as often as its word, so no chain turns back on itself and few rounds do.
    """
    here = written(forms.select("word_id", F.col("form_id").alias("root_id")))
    while True:
        ahead = here.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next_id"))
        jumped = written(here.join(ahead, "root_id", "left").select("word_id", F.coalesce("next_id", "root_id").alias("root_id"), F.col("next_id").isNotNull().alias("moved")))
        dropped(here)
        here = jumped
        if not here.filter("moved").limit(1).count():
            return here.select("word_id", "root_id")


def variants(words: DataFrame, ratio: int = RATIO, per_task: int = WORDS_PER_TASK) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words(word_id, word, n), a written table."""
    near = written(near_words(node_pairs(words, per_task)))
    known = words.join(near, "word_id", "left")
    form = F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near_id"))
    known = written(known.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form_id"),
                                 F.when(form.isNotNull(), F.col("near_n")).alias("form_n")))
    dropped(near)
    roots = last_forms(known.filter("form_id is not null"))
    named = words.select(F.col("word_id").alias("form_id"), F.col("word").alias("form"))
    ends = words.select(F.col("word_id").alias("root_id"), F.col("word").alias("root"))
    return (known.join(roots, "word_id", "left").join(named, "form_id", "left").join(ends, "root_id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: bool = False,
                      per_task: int = WORDS_PER_TASK) -> DataFrame:
    """The words of all texts with their forms; `spoil` draws the deletions of `spoiled` first."""
    runs = runs_of(docs, id_col, text_col)
    words = spoiled(runs) if spoil else runs.select(F.col("run").alias("word"))
    return variants(vocabulary(words, per_task=per_task), per_task=per_task)
