"""Lines whose country or item is unknown stay in every question, as in the SQL twins."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tillroll.checks import compare
from tillroll.operators.ordering import number_rows
from tillroll.plans import catalog, views

TABLES = ("lineitem", "orders", "part", "customer", "nation")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small star schema with null and unmatched nation keys, and items that part lacks."""
    top = tmp_path_factory.mktemp("star")
    for name in TABLES:
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if name == "customer":
            key = F.when(F.col("c_nationkey") == 3, F.lit(None)).when(
                F.col("c_nationkey") == 4, F.lit(99)).otherwise(F.col("c_nationkey"))
            df = df.withColumn("c_nationkey", key.cast(df.schema["c_nationkey"].dataType))
        if name == "part":
            df = df.filter(F.col("p_partkey") % 50 != 7)
        df.coalesce(1).write.parquet(f"{top}/{name}-parts")
        part = next((top / f"{name}-parts").glob("*.parquet"))
        shutil.copy(part, top / f"{name}.parquet")
    return str(top)


@pytest.mark.parametrize(
    "name", ["clean_sales", "sales_by_country", "daily_quantity", "numbered_series", "naive_forecast_table"]
)
def test_unknown_country_matches_sql(spark, folder, name):
    verdict, _, _ = compare.compare(spark, compare.open_tables(folder), folder, name)
    assert verdict.startswith("equal"), verdict


def test_clean_sales_has_unknown_countries(spark, folder):
    rows = catalog.RELATIONAL["clean_sales"](spark, folder)
    assert rows.filter(F.col("country").isNull()).count() > 0


def test_number_rows_keeps_the_unknown_series(spark):
    df = spark.createDataFrame(
        [(None, 1), (None, 2), (None, 3), ("A", 1), ("A", 2)], "series string, day int")
    rows = number_rows(df, "series", "day").collect()
    assert sorted(r["row_id"] for r in rows) == [1, 2, 3, 4, 5]


def test_forecast_table_counts_the_unknown_series(spark):
    view = spark.createDataFrame(
        [("Home", 10.0), ("Others", 10.0), (None, 50.0)], "series string, value double"
    ).withColumn("invoice_date", F.to_date(F.lit("2001-01-01"))).withColumn("period", F.lit("p"))
    row = views.forecast_table(view, "Home").first()
    assert (row["total_forecast"], row["others_forecast"]) == ("70", "60")
