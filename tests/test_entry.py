"""Driver contract: entry smoke run, registry/oracle keys, plans without Python UDFs."""

import __spark_entry__ as E
from tests.conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "RecommendedOrderQty" in df.columns


def test_oracle_keys_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 60


def test_flagship_plans_have_no_python(spark):
    for name in ("v1_procurement_tasks", "v8_procurement_plan", "a7_median_imputation"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_scan_prunes_columns(spark):
    df = E.queries()["a1_demand_per_item"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # A1 only needs the item and the quantity: price and discount never leave the file
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double" in plan
    assert "l_discount" not in plan and "l_extendedprice" not in plan
