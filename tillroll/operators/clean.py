"""From raw invoice lines to sales lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.config import Settings
from tillroll.functions.text import strip_quotes, strip_space

MONEY = "decimal(18,2)"


def clean_sales(lines: DataFrame, settings: Settings, unique: bool = False) -> DataFrame:
    """Drop lines without a customer, returns and excluded countries; add sales.

    A line whose country is unknown stays. Pass unique=True when the source has
    already dropped repeated lines, which saves the all-column shuffle. Columns
    the caller did not read are left alone.
    """
    if "description" in lines.columns:
        lines = lines.withColumn("description", strip_space(F.col("description")))
    if "country" in lines.columns:
        country = F.col("country")
        lines = lines.filter(country.isNull() | ~country.isin(*settings.excluded_countries))
    if "quantity" in lines.columns:
        lines = lines.filter(F.col("quantity") > 0)
    lines = lines.withColumn("invoice_date", F.to_date("invoice_date")).filter(
        F.col("customer_id").isNotNull()
    )
    if "price" in lines.columns:
        lines = lines.withColumn("sales", (F.col("quantity") * F.col("price")).cast(MONEY))
    return lines if unique else lines.dropDuplicates()


def as_of(sales: DataFrame, last_day: date) -> DataFrame:
    """Sales up to a day, with quotes removed from descriptions.

    Customers who came later have not had their 90 days yet.
    """
    sales = sales.filter(F.col("invoice_date") <= F.lit(last_day))
    if "description" in sales.columns:
        sales = sales.withColumn("description", strip_quotes(F.col("description")))
    return sales


def date_range(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.min("invoice_date").alias("first_day"), F.max("invoice_date").alias("last_day")
    )


def members_only(df: DataFrame, keys: DataFrame, on: str, inside: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in another table's key column."""
    return df.join(keys.select(on).distinct(), on, "left_semi" if inside else "left_anti")
