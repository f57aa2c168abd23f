import os
import sys
from contextlib import contextmanager

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ostinato.session import BROADCAST_KEYS, ROWS_PER_TASK, local_session, release_steps  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(autouse=True)
def no_steps_left(request):
    yield
    if "spark" in request.fixturenames:
        release_steps(request.getfixturevalue("spark"))


@pytest.fixture
def small_tasks(spark):
    """Limits so low that groups are cut and summaries are not broadcast."""
    @contextmanager
    def limits(rows=25, keys=0):
        spark.conf.set(ROWS_PER_TASK, str(rows))
        spark.conf.set(BROADCAST_KEYS, str(keys))
        try:
            yield
        finally:
            spark.conf.unset(ROWS_PER_TASK)
            spark.conf.unset(BROADCAST_KEYS)
    return limits


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
