"""Every named query against its SQL, values and types."""

import oracle_check
import pytest
from settings import SF_DIR

import __spark_entry__ as driver
from stockyard.plans import oracle
from stockyard.plans import queries as plans

# The queries for training data have tests of their own.
QUERIES = {k: q for k, q in driver.queries().items() if k in oracle.BODIES}
ORACLES = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle_check.duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(plans.catalog()) == set(ORACLES) == set(QUERIES)


FORBIDDEN = ["CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas", "CollectLimit"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    assert oracle_check.compare(result, duck, ORACLES[name], ordered=name in oracle.ORDERS) is None
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert [node for node in FORBIDDEN if node in plan] == []


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["inventory_risk", "observations", "risk_rank", "percentage"]
    assert result.count() == 4
