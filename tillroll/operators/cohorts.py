"""First purchases and the cohorts they make."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import cohort_label, quarter_start


def first_purchase(
    sales: DataFrame, rounding: str = "nearest", per_country: bool = False
) -> DataFrame:
    """First day and cohort of each customer, with the country of that first day.

    One row per customer, so joining sales to it never repeats a line. With
    per_country=True there is one row for each country a customer bought in,
    all with the customer's overall first day.
    """
    by_country = sales.groupBy("customer_id", "country").agg(F.min("invoice_date").alias("day"))
    first = by_country.groupBy("customer_id").agg(
        F.min("day").alias("first_purchase_date"),
        F.min_by("country", F.struct("day", "country")).alias("country"),
    )
    if per_country:
        first = first.drop("country").join(by_country.drop("day"), "customer_id")
    quarter = F.col("first_purchase_quarter")
    return (
        first.withColumn(
            "first_purchase_quarter", quarter_start(F.col("first_purchase_date"), rounding)
        )
        .withColumn("first_purchase_cohort", cohort_label(quarter))
        .select(
            "customer_id",
            "first_purchase_date",
            "first_purchase_quarter",
            "first_purchase_cohort",
            "country",
        )
    )


def cohort_sizes(purchases: DataFrame) -> DataFrame:
    """Customers per cohort, largest first."""
    sizes = (
        purchases.select("customer_id", "first_purchase_cohort")
        .distinct()
        .groupBy("first_purchase_cohort")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return sizes.orderBy(F.desc("n"), "first_purchase_cohort")


def analysis_cohort(
    sales: DataFrame,
    purchases: DataFrame,
    first_day: date,
    last_day: date,
    cohorts: Sequence[str] | None = None,
    countries: Sequence[str] | None = None,
) -> DataFrame:
    """Sales between two days (both included) of the given cohorts and countries.

    None means all. Both filters do filter: the original compares each column
    with itself and so keeps every row.
    """
    sales = sales.filter(F.col("invoice_date").between(F.lit(first_day), F.lit(last_day)))
    if countries is not None:
        sales = sales.filter(F.col("country").isin(*countries))
    members = purchases.select("customer_id", "first_purchase_cohort").distinct()
    if cohorts is not None:
        members = members.filter(F.col("first_purchase_cohort").isin(*cohorts))
        return sales.join(members, "customer_id")
    return sales.join(members, "customer_id", "left")


def attach_customer(df: DataFrame, purchases: DataFrame) -> DataFrame:
    """Add country and cohort of each customer. Join side is left to the optimizer's size check."""
    wanted = purchases.select("customer_id", "country", "first_purchase_cohort")
    return df.join(wanted, "customer_id", "left")
