import pytest

from locusframe import catalog
from tests.compare import of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    columns, found = of_spark(catalog.QUERIES[name](spark, sf_dir))
    assert found
    if name in catalog.ORACLE_SQL:
        want_columns, want = of_duckdb(catalog.ORACLE_SQL[name], sf_dir)
        assert columns == want_columns
        assert found == want


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_plans_have_no_nested_loop(spark, sf_dir):
    for name in ("locus_mean_quality", "locus_depth", "region_fetch", "fastq_zip"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan
