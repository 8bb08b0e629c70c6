"""Recency, frequency and spend of each customer, with the outcome of the next 90 days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.config import Settings
from tillroll.operators.split import TimeBounds, is_train_customer

FEATURES = ["recency", "frequency", "sales_sum", "sales_mean"]


def rfm(sales: DataFrame, reference_day: date) -> DataFrame:
    """Recency (days from the reference day, so 0 or less), line count, and sales per customer."""
    return (
        sales.groupBy("customer_id")
        .agg(
            F.max("invoice_date").alias("last_day"),
            F.count(F.lit(1)).alias("frequency"),
            F.sum("sales").alias("sales_sum"),
        )
        .select(
            "customer_id",
            F.datediff("last_day", F.lit(reference_day)).alias("recency"),
            "frequency",
            "sales_sum",
            (F.col("sales_sum").cast("double") / F.col("frequency")).alias("sales_mean"),
        )
    )


def customer_features(sales: DataFrame, bounds: TimeBounds, settings: Settings) -> DataFrame:
    """Features up to the cut and spend after it, for every customer with a line up to the cut.

    Both sides of the cut come out of one aggregation, so no join of features
    to outcomes is needed; a customer without later lines gets 0 and flag 0.
    """
    before = F.col("invoice_date") <= F.lit(bounds.cut_day)
    after = ~before
    folded = sales.groupBy("customer_id").agg(
        F.max(F.when(before, F.col("invoice_date"))).alias("last_day"),
        F.count(F.when(before, True)).alias("frequency"),
        F.sum(F.when(before, F.col("sales"))).alias("sales_sum"),
        F.sum(F.when(after, F.col("sales"))).alias("spend_90_total"),
        F.count(F.when(after, True)).alias("later_lines"),
    )
    return (
        folded.filter(F.col("frequency") > 0)
        .select(
            "customer_id",
            F.datediff("last_day", F.lit(bounds.reference_day)).alias("recency"),
            "frequency",
            "sales_sum",
            (F.col("sales_sum").cast("double") / F.col("frequency")).alias("sales_mean"),
            "spend_90_total",
            F.when(F.col("later_lines") > 0, 1).alias("spend_90_flag"),
            F.when(is_train_customer(settings), "train").otherwise("test").alias("split"),
        )
        .fillna({"spend_90_total": 0, "spend_90_flag": 0})
    )
