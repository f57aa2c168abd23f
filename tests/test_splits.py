import math
import random

import pytest

from conftest import rows
from ostinato.operators import splits

PIECES = "id string, composer string, youtube_link string"


def test_shared_composer_or_recording_groups_transitively(spark):
    url = "https://youtu.be/abcdefghijk"
    df = spark.createDataFrame([("1", "A ", None), ("2", "a", url), ("3", "B", url), ("4", "C", None)], PIECES)
    got = dict(rows(splits.connected_groups(splits.piece_tokens(df))))
    assert got == {"1": "1", "2": "1", "3": "1", "4": "4"}


def test_missing_composer_is_an_error(spark):
    for name in (None, "  "):
        with pytest.raises(Exception, match="missing composer"):
            splits.piece_tokens(spark.createDataFrame([("1", name, None)], PIECES)).collect()


def components(edges):
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for item, token in edges:
        parent[find(("i", item))] = find(("t", token))
    low = {}
    for item, _ in edges:
        root = find(("i", item))
        low[root] = min(low.get(root, item), item)
    return {item: low[find(("i", item))] for item, _ in edges}


@pytest.mark.parametrize("rows_limit,keys_limit", [(20, 0), (10_000, 10_000)])
def test_groups_against_union_find(spark, small_tasks, rows_limit, keys_limit):
    rng = random.Random(11)
    edges = [(f"i{i}", "hub") for i in range(120)]                        # a token with many items
    edges += [(f"c{i}", f"k{i}") for i in range(40)] + [(f"c{i}", f"k{i + 1}") for i in range(40)]   # a long chain
    edges += [(f"r{rng.randint(0, 150)}", f"x{rng.randint(0, 130)}") for _ in range(160)]
    edges += [("lone", "only")]
    df = spark.createDataFrame(edges, "item string, token string")
    with small_tasks(rows_limit, keys_limit):
        assert dict(rows(splits.connected_groups(df))) == components(edges)


def items(spark, n=40, size=2):
    return spark.createDataFrame([(f"p{i}", f"g{i // size}") for i in range(n)], "id string, group string")


@pytest.mark.parametrize("limit", [3, 10_000])
def test_split_sizes_and_disjoint_groups(spark, small_tasks, limit):
    it = items(spark)
    with small_tasks(limit):
        split = splits.assign_split(it)
        counts = dict(rows(split.select("group", "part").distinct().groupBy("part").count()))
        n_test = math.ceil(.2 * 20)
        assert counts == {"test": n_test, "val": math.ceil(.25 * (20 - n_test)), "train": 20 - n_test - math.ceil(.25 * (20 - n_test))}
        assert splits.validate_split(split.select("id", "part"), it).count() == 0
        assert rows(split, "id") == rows(splits.assign_split(it.repartition(7)), "id")


def test_too_few_groups(spark):
    with pytest.raises(ValueError):
        splits.group_split(items(spark, 8))


def test_violations(spark):
    it = items(spark)
    split = splits.assign_split(it).select("id", "part")
    one = split.filter("part = 'train'").orderBy("id").first()["id"]
    leak = split.unionByName(spark.createDataFrame([(one, "val")], "id string, part string"))
    assert {r["problem"] for r in splits.validate_split(leak, it).collect()} == {"id_in_two_parts", "group_in_two_parts"}
    twice = split.unionByName(split.filter(f"id = '{one}'"))
    assert [r["problem"] for r in splits.validate_split(twice, it).collect()] == ["duplicate_id"]
    other = split.filter("part != 'val'").unionByName(spark.createDataFrame([("zz", "dev")], "id string, part string"))
    assert {r["problem"] for r in splits.validate_split(other, it).collect()} == {"unknown_part", "empty_part", "unknown_id", "uncovered_id"}


def test_common_subset(spark):
    split = spark.createDataFrame([(i, p) for p, ids in (("train", "abc"), ("val", "d"), ("test", "ef")) for i in ids], "id string, part string")
    valid = spark.createDataFrame([(i,) for i in "adez"], "id string")
    marked, counts = splits.common_subset(split, valid)
    assert rows(counts, "part") == [("test", 2, 1, 1), ("train", 3, 1, 2), ("val", 1, 1, 0)]
    assert sorted(r["id"] for r in marked.filter("status = 'missing'").collect()) == ["b", "c", "f"]


def test_coverage_and_overlap(spark):
    df = spark.createDataFrame([("train", 0, "x"), ("val", 1, "x"), ("train", 0, "y"), ("test", 2, "y")], "part string, grade int, composer string")
    cov = splits.coverage(df)
    assert cov.count() == 33 and cov.filter("n > 0").count() == 3
    with pytest.raises(Exception, match="lacks a grade"):
        splits.coverage(df, require=True).collect()
    assert {tuple(r) for r in splits.split_overlap(df, "composer").collect()} == {("train", "val", 1), ("train", "test", 1), ("val", "test", 0)}


def test_item_in_two_groups_is_reported(spark):
    items = spark.createDataFrame([("a", "g"), ("a", "h"), ("b", "h"), ("c", "k"), ("c", "k")], "id string, group string")
    split = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "id string, part string")
    found = {(r["problem"], r["subject"], r["n"]) for r in splits.validate_split(split, items).collect()}
    assert found == {("duplicate_item", "a", 2), ("duplicate_item", "c", 2), ("group_in_two_parts", "h", 2)}


def test_steps_are_released(spark):
    import os

    from ostinato import session
    edges = spark.createDataFrame([(f"i{k}", f"t{k // 2}") for k in range(40)] + [("i3", "t9")], "item string, token string")
    splits.connected_groups(edges).collect()
    folder = session.shared_folder(spark)
    assert session._steps
    paths = list(session._steps)
    session.release_steps(spark)
    assert not session._steps and not session._summaries and not any(os.path.exists(p.removeprefix("file:")) for p in paths) and folder


def test_no_silent_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest as _pytest

    from ostinato import session
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with _pytest.raises(ValueError):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=conf))
