from __future__ import annotations

import pytest

from tesselite.queries import ORACLES, QUERIES

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    found = QUERIES[name](spark, small).toPandas()
    assert len(found.columns)
    if name in ORACLES:
        assert rows_of(found) == rows_of(duck.execute(ORACLES[name]).fetchdf())


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pruned_and_pushed(spark, small):
    plan = QUERIES["joi_01_multi_mapping_join"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan.split("ReadSchema")[-1]
