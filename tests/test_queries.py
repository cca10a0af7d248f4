"""Every registered query of the catalogue side that has SQL against it, over the small tables; the others have tests of their own."""

import pytest

import __spark_entry__ as entry
from weirwork.plans import queries as Q

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, duck, same, name):
    same(Q.QUERIES[name](spark, SMALL).toPandas(), duck(Q.ORACLES[name]))


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["kind", "doc_id"]
    assert found.count() == 113
    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_products_and_read_few_columns(spark):
    for name in ("drift", "nested_units", "missing_files", "coverage"):
        plan = Q.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
    scan = Q.QUERIES["coverage"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in scan
