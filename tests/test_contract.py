import importlib

from conftest import SF001


def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    out = entry.entry(spark)
    rows = out.collect()
    assert len(rows) == 11 and "semantic_type" in out.columns


def test_oracles_are_registered_queries():
    entry = importlib.import_module("__spark_entry__")
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 100


def test_no_unbounded_window_or_nested_loop_in_profile_plans(spark):
    from tabsleuth.operators import profile, relations

    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    for df in (profile.column_profile(li), relations.cramers_v_matrix(li)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan
        assert "SinglePartition" not in plan or "Window" not in plan


def test_load_table_rejects_unknown_format(spark):
    import pytest

    from tabsleuth.sources import io

    with pytest.raises(ValueError):
        io.load_table(spark, "/tmp/whatever.xlsx")
