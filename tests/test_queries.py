import pytest

from policygrid.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(name, compare):
    mine, theirs = compare(registry.QUERIES[name], registry.SQL[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, sf):
    df = registry.QUERIES[name](spark, sf)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
