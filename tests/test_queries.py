"""Every registered query against its SQL on the smallest data folder."""

import os
import re

import pytest

from workload.check import checker, compare
from workload.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return checker(FOLDER)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


# Windows over whole keys that see one row per day or piece of a key, or one piece.
PLAIN_WINDOWS = {"asof_share": 2, "asof_last_before": 1, "case_number": 2, "numbered_cases": 2}


@pytest.fixture(scope="module")
def large_joins(spark):
    """Joins planned as for sides too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, large_joins, key):
    df = QUERIES[key](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "CollectLimit", "collect_list", "collect_set"):
        assert bad not in plan
    # A window cut to its first rows is trimmed before the shuffle.
    plain = len(re.findall(r"\bWindow \[", plan)) - len(re.findall(r"WindowGroupLimit .*Final", plan))
    assert plain <= PLAIN_WINDOWS.get(key, 0)
    problem, _ = compare(df, con, CHECKS[key])
    assert problem == ""
