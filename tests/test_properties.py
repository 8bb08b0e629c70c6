"""What must hold on the stored tables, whatever the numbers."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tillroll.operators import series
from tillroll.plans import catalog
from tillroll.session import stage


@pytest.fixture(scope="module")
def daily(spark):
    return stage(catalog.daily(spark, SMALL), "daily")


def by_series(df, *aggregates):
    return {r["series"]: tuple(r)[1:] for r in df.groupBy("series").agg(*aggregates).collect()}


def test_padding_fills_every_day_and_keeps_the_sum(daily):
    span = F.datediff(F.max("invoice_date"), F.min("invoice_date")) + 1
    before = by_series(daily, span.cast("long"), F.sum("total_quantity"))
    after = by_series(series.pad_days(daily), F.count("*"), F.sum("total_quantity"))
    assert before == after


def test_ninety_future_days_per_series(daily):
    longer = series.extend_days(series.pad_days(daily), 90)
    assert set(by_series(series.future_rows(longer), F.count("*")).values()) == {(90,)}


def test_lag_is_the_value_ninety_days_before(daily):
    frame = series.series_features(series.extend_days(series.pad_days(daily), 90), catalog.S)
    then = series.pad_days(daily).select(
        "series", F.date_add("invoice_date", 90).alias("invoice_date"), F.col("total_quantity").alias("q")
    )
    both = frame.join(then, ["series", "invoice_date"], "left")
    assert both.filter("not (total_quantity_lag90 <=> q)").isEmpty()


def test_train_and_test_customers_are_apart(spark):
    train, test = catalog.clv_training_table(spark, SMALL), catalog.clv_testing_table(spark, SMALL)
    assert train.join(test, "customer_id").isEmpty()
    assert train.filter("recency > 0 or frequency < 1 or sales_sum <= 0").isEmpty()


def test_neighbours_are_others_in_order(spark):
    near = catalog.nearest_customers(spark, SMALL).cache()
    assert near.filter("customer_id = neighbour_id or similarity <= 0 or similarity > 1").isEmpty()
    step = near.alias("a").join(near.alias("b"), F.expr("a.customer_id = b.customer_id and a.rank + 1 = b.rank"))
    assert step.filter("a.similarity < b.similarity - 1e-12").isEmpty()


def test_recommended_items_are_new(spark):
    offers = catalog.recommendations(spark, SMALL)
    assert offers.join(catalog.user_items(spark, SMALL), ["customer_id", "stock_code"]).isEmpty()


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.recent_items(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "p_name" not in plan and "l_extendedprice" not in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name", sorted(set(catalog.RELATIONAL)))
def test_no_cross_join(spark, name):
    plan = catalog.RELATIONAL[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
