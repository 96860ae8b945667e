"""What plans must and must not hold: no products of all rows, only the columns and rows that are needed."""

import pytest

from policygrid.plans import registry


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n not in ("paired_pvalues",)))
def test_no_cartesian_product(name, spark, sf):
    plan = _plan(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned_and_filters_pushed(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(registry.QUERIES["p3_found"](spark, sf))
    assert "ReadSchema: struct<obs_id:bigint,country:string,year:int,feature:string,value:double,loaded_at" in plan and "unit" not in plan.split("== Physical Plan ==")[1]
    plan = _plan(registry.QUERIES["location_slice"](spark, sf))
    assert "GreaterThanOrEqual(year,2000)" in plan and "LessThanOrEqual(year,2009)" in plan
    assert "embedding" not in _plan(registry.QUERIES["metadata_upsert"](spark, sf)).split("== Physical Plan ==")[1]


def test_aggregates_are_partial_before_the_shuffle(spark, sf):
    plan = _plan(registry.QUERIES["fold_train_test_counts"](spark, sf)).split("== Physical Plan ==")[1]
    assert plan.count("HashAggregate") >= 2 and "Exchange hashpartitioning(fold" in plan
