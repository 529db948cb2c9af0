import os

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from turmalina.fixtures.oracle import ORACLE
from turmalina.fixtures.queries import QUERIES, WITHOUT_SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, con, ORACLE[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups",
                 "CartesianProduct", "BroadcastNestedLoopJoin", "RDDScan"):
        assert slow not in plan, slow


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
