"""Work and messages that have to follow the size of the input."""

import numpy as np

from ostinato.operators import trees
from ostinato.plans import queries
from test_trees import COLUMNS, data, table


def test_passes_of_trees_use_all_cores(spark, monkeypatch):
    """Bins are few bytes, so the passes over a long table are dealt out to the cores, and give the same trees."""
    x, y = data(400)
    df = table(spark, x, y)
    one = trees.fit_boosted_trees(df, COLUMNS, [3, 8], rounds=2, min_rows=5)
    asked, real = [], trees.best_splits
    monkeypatch.setattr(trees, "best_splits", lambda rows, width, tasks, *more: asked.append(tasks) or real(rows, width, tasks, *more))
    monkeypatch.setattr(trees, "BYTES_PER_CORE", 400 * len(COLUMNS) // 5)
    two = trees.fit_boosted_trees(df, COLUMNS, [3, 8], rounds=2, min_rows=5)
    assert set(asked) == {5}
    for k in one:
        assert np.allclose(one[k].predict(x), two[k].predict(x))
    monkeypatch.undo()
    # 4.3 million rows of four features on twelve cores, and a table beyond what the cores hold
    assert trees._tasks(4 * 4_300_000, 12) == 12 and trees._tasks(4 * 1200, 12) == 1 and trees._tasks(1 << 30, 12) == 128


def test_ids_of_a_part_do_not_pass_through_the_driver(spark, monkeypatch):
    plans, real = [], queries.settled
    monkeypatch.setattr(queries, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    found = queries.QUERIES["verify_predictions"](spark, "/root/testdata/sf0.001")
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert found.filter("problem = 'missing_prediction'").count() > 0
