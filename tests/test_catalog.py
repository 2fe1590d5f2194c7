import os

import oracle
import pytest

import __spark_entry__ as entry
from cuelake.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    oracle.compare(spark, entry, name, SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_and_repeats(spark, name):
    a, b = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_interval_joins_have_no_nested_loop(spark):
    """Fact tables meet by equal keys alone."""
    for name in ("point_in_interval_count", "best_overlap_match", "nearest_edge_snap", "asof_event_at_time"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
