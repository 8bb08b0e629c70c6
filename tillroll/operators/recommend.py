"""Products to offer a customer, from what the nearest customers buy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.config import Settings
from tillroll.operators.similarity import (
    class_neighbours,
    group_baskets,
    slot_neighbours,
)
from tillroll.session import stage


def opportunities(sales: DataFrame, settings: Settings, new_only: bool = False) -> DataFrame:
    """Top items by mean sales among the n nearest of every customer.

    new_only leaves out items the customer already has: the recommendation.
    Customers with equal baskets and equal neighbours get one list, made once.
    """
    bought = sales.groupBy("customer_id", "stock_code", "description").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(F.col("quantity") > 0, True)).alias("bought_lines"),
        F.sum("quantity").alias("quantity"),
        F.sum("sales").alias("sales"),
    )
    bought = stage(bought, "bought")  # the lines are read once, here
    pairs = bought.filter(F.col("bought_lines") > 0).select("customer_id", "stock_code").distinct()
    baskets = group_baskets(pairs, settings.n_closest)
    lists = slot_neighbours(baskets, class_neighbours(baskets, settings))

    offered = lists.select(
        "class_id", "slot", F.col("neighbour_id").alias("customer_id")
    ).join(bought, "customer_id")
    if new_only:
        offered = offered.join(
            baskets.items.select("class_id", "stock_code"), ["class_id", "stock_code"], "left_anti"
        )
    lines = F.sum("lines")
    means = offered.groupBy("class_id", "slot", "stock_code", "description").agg(
        (F.sum("quantity") / lines).alias("mean_quantity"),
        (F.sum("sales").cast("double") / lines).alias("mean_sales"),
    )
    order = Window.partitionBy("class_id", "slot").orderBy(
        F.desc("mean_sales"), "stock_code", "description"
    )
    top = means.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= settings.n_return
    )
    return baskets.members.join(top, ["class_id", "slot"]).select(
        "customer_id", "stock_code", "description", "mean_quantity", "mean_sales", "rank"
    )


def recommendations(sales: DataFrame, settings: Settings) -> DataFrame:
    """Top items the nearest customers buy and the customer does not have yet."""
    return opportunities(sales, settings, new_only=True)


def offer_text(offers: DataFrame) -> DataFrame:
    """One row per customer: the offered descriptions as comma text, best first."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "description")))  # n_return at most
    names = F.transform(ordered, lambda offer: offer["description"])
    return offers.groupBy("customer_id").agg(F.concat_ws(", ", names).alias("products"))
