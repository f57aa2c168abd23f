"""Groups that must stay together, splits by group, and checks of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions.columns import GRADES, recording_id
from ostinato.functions.text import composer_key
from ostinato.operators.ordering import positions
from ostinato.operators.skew import ROWS, attach, row_count
from ostinato.session import forget, settled

PARTS = ("train", "val", "test")


def piece_tokens(pieces: DataFrame) -> DataFrame:
    """(item, token) edges of pieces(id, composer, youtube_link); a blank composer is an error."""
    keyed = composer_key(pieces)
    composer = keyed.select(F.col("id").alias("item"), F.concat(F.lit("composer:"), "composer_key").alias("token"))
    video = pieces.select(F.col("id").alias("item"), F.concat(F.lit("recording:"), recording_id(F.col("youtube_link"))).alias("token"))
    return composer.unionByName(video.filter("token is not null"))


def _unsettled(links: DataFrame) -> bool:
    """True while some node has two links, or is both a leaf and a root."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return not nodes.filter("leaf > 1 or leaf = 1 and root = 1").isEmpty()


def _settle_links(links: DataFrame) -> DataFrame:
    """Star links (u, root) of an edge set (u, v): alternating large-star and small-star steps.

    The edge set does not grow. A step takes the minimum neighbour per node (a combinable aggregate) and
    joins it back with `attach`, so a node with a third of all edges is neither gathered nor shuffled to
    one task. Each step is written to the shared folder, which cuts the lineage and survives lost
    executors.
    """
    current = settled(links.distinct())
    while _unsettled(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), row_count()).persist()
        large = settled(attach(both.filter("v > u"), lowest, ["u"], keep=False)
                        .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"), row_count()).persist()
        forget(current)
        small = (attach(large, lower, ["u"], keep=False).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        current = settled(small)
        forget(large)
        lowest.unpersist()
        lower.unpersist()
    return current.select("u", F.col("v").alias("root"))


def connected_groups(edges: DataFrame) -> DataFrame:
    """Group of each item: the smallest item reachable over shared tokens. edges(item, token) -> id, group.

    Only what can connect takes part in the rounds: tokens of a single item are left out, and items
    with one remaining token just follow it. The rounds run over links between tokens.
    """
    named = settled(edges.select(F.col("item").cast("string").alias("item"), F.col("token").cast("string").alias("token")).distinct())
    tokens = settled(named.groupBy("token").agg(F.min("item").alias("low"), row_count()))
    shared = settled(attach(named, tokens.withColumn("_many", F.col(ROWS) > 1), ["token"], keep=False).filter("_many").select("item", "token"))
    first = settled(shared.groupBy("item").agg(F.min("token").alias("first"), row_count()))
    core = attach(shared, first, ["item"], keep=False).filter("token != first")
    roots = _settle_links(core.select(F.col("token").alias("u"), F.col("first").alias("v")))
    # the root of each shared token, and the smallest item below a root
    rooted = settled(tokens.filter(F.col(ROWS) > 1).join(roots.withColumnRenamed("u", "token"), "token", "left")
                     .withColumn("root", F.coalesce("root", "token")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("group"), row_count())
    by_token = attach(rooted.select("token", "root", F.col(ROWS).alias("_items")), lowest, ["root"]).select(
        F.col("token").alias("first"), "group", F.col("_items").alias(ROWS))
    grouped = attach(first.select("item", "first"), by_token, ["first"]).select("item", "group")
    return named.select("item").distinct().join(grouped, "item", "left").select(
        F.col("item").alias("id"), F.coalesce("group", "item").alias("group"))


def group_split(groups: DataFrame, seed: int = 42, min_groups: int = 5) -> DataFrame:
    """Part of each group: the first fifth by hash order is test, then a quarter of the rest is val.

    groups(group); the order is the SHA-256 of seed and group, so the split does not depend on the plan.
    """
    unique = groups.select(F.col("group").cast("string").alias("group")).distinct()
    hashed = unique.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), "group"), 256))
    total = hashed.count()
    if total < min_groups:
        raise ValueError("too few independent groups")
    n_test = -(-total // 5)
    n_val = -(-(total - n_test) // 4)
    ranked = positions(hashed, [], ["_h"], "_at")
    part = F.when(F.col("_at") < n_test, "test").when(F.col("_at") < n_test + n_val, "val").otherwise("train")
    return ranked.select("group", part.alias("part"))


def assign_split(items: DataFrame, seed: int = 42) -> DataFrame:
    """items(id, group) -> id, group, part."""
    parts = group_split(items.select("group"), seed)
    sizes = items.groupBy(F.col("group").cast("string").alias("group")).agg(row_count())
    return attach(items.withColumn("group", F.col("group").cast("string")), parts.join(sizes, "group"), ["group"])


def split_keys(split: DataFrame) -> DataFrame:
    return split.select("id").distinct()


def validate_split(split: DataFrame, items: DataFrame) -> DataFrame:
    """Violations of split(id, part) against items(id, group): problem, subject, n. Empty when sound."""
    text = lambda c: F.col(c).cast("string")
    parts = split.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    wrong_part = parts.filter(~F.col("part").isin(*PARTS)).select(F.lit("unknown_part").alias("problem"), text("part").alias("subject"), "n")
    expected = split.sparkSession.createDataFrame([(p,) for p in PARTS], "part string")
    empty = expected.join(parts, "part", "left_anti").select(
        F.lit("empty_part").alias("problem"), F.col("part").alias("subject"), F.lit(0).cast("long").alias("n"))
    per_id = split.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("p"))
    repeated = per_id.filter("n > 1").select(
        F.when(F.col("p") > 1, "id_in_two_parts").otherwise("duplicate_id").alias("problem"), text("id").alias("subject"), "n")
    member = items.select("id", "group").distinct()
    known = items.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    doubled = known.filter("n > 1").select(F.lit("duplicate_item").alias("problem"), text("id").alias("subject"), "n")
    known = known.select("id")
    unknown = per_id.join(known, "id", "left_anti").select(F.lit("unknown_id").alias("problem"), text("id").alias("subject"), "n")
    uncovered = known.join(per_id, "id", "left_anti").select(
        F.lit("uncovered_id").alias("problem"), text("id").alias("subject"), F.lit(1).cast("long").alias("n"))
    leaks = (split.select("id", "part").join(member, "id").groupBy("group").agg(F.count_distinct("part").alias("n"))
             .filter("n > 1").select(F.lit("group_in_two_parts").alias("problem"), text("group").alias("subject"), "n"))
    out = wrong_part
    for more in (empty, repeated, doubled, unknown, uncovered, leaks):
        out = out.unionByName(more)
    return out


def common_subset(split: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept and missing ids per part, counts per part) of a split against the valid ids."""
    ok = valid.select("id").distinct().withColumn("_ok", F.lit(True))
    marked = split.select("id", "part").join(ok, "id", "left").select(
        "id", "part", F.when(F.col("_ok"), "kept").otherwise("missing").alias("status"))
    counts = marked.groupBy("part").agg(
        F.count(F.lit(1)).alias("source"), F.count_if(F.col("status") == "kept").alias("kept"),
        F.count_if(F.col("status") == "missing").alias("missing"))
    return marked, counts


def coverage(rows: DataFrame, parts=PARTS, require: bool = False) -> DataFrame:
    """Rows per part and grade with zeros; `require` turns a zero into an error."""
    grid = rows.sparkSession.createDataFrame([(p, g) for p in parts for g in GRADES], "part string, grade int")
    counts = rows.groupBy("part", F.col("grade").cast("int").alias("grade")).agg(F.count(F.lit(1)).alias("_c"))
    n = F.coalesce(F.col("_c"), F.lit(0)).cast("long")
    if require:
        n = F.when(n == 0, F.raise_error(F.lit("a part lacks a grade")).cast("long")).otherwise(n)
    return grid.join(counts, ["part", "grade"], "left").select("part", "grade", n.alias("n"))


def grade_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


def split_overlap(rows: DataFrame, key: str) -> DataFrame:
    """Number of keys shared by each pair of parts, zeros included. Counted per key: no pair of rows is formed."""
    in_part = [F.max(F.when(F.col("part") == p, 1).otherwise(0)).alias(p) for p in PARTS]
    per_key = rows.groupBy(key).agg(*in_part)
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    sums = per_key.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), F.col(f"{a}_{b}").cast("long").alias("n")) for a, b in pairs
    ])).alias("p")).select("p.*")
