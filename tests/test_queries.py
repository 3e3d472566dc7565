"""Every registered query against its SQL, and the shape of every plan."""

import pytest

import __spark_entry__ as contract
from checks import oracle, queries
from checks.compare import difference, open_tables

SF = "/root/testdata/sf0.001"
SQLS = oracle.statements()
NAMES = sorted(queries.registry())


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, tables, name):
    assert difference(spark, tables, SF, name, SQLS[name]) is None


def test_every_query_has_sql():
    assert set(NAMES) == set(SQLS)


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream")])
def test_plan_pairs_no_rows(spark, name):
    plan = queries.registry()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["product", "cell_id", "valid_date", "mm", "n_issues", "n_wet"]
    assert df.count() == 9 * 61
    assert set(contract.queries()) >= set(contract.oracle_sql())
