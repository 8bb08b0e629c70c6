"""Invoice lines drawn from the star schema lineitem, orders, part, customer, nation."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_COLUMNS = (
    "invoice",
    "stock_code",
    "description",
    "quantity",
    "invoice_date",
    "price",
    "customer_id",
    "country",
)
MONEY = "decimal(18,2)"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _midnight(day: date) -> Column:
    """Literal of the stored column's own type, so that the filter reaches the parquet scan."""
    return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")


def _signed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Order, item and quantity of each line; a return counts negative."""
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(
        F.col("l_quantity")
    )
    return table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("invoice"),
        F.col("l_partkey").alias("stock_code"),
        quantity.cast("int").alias("quantity"),
    )


def _orders(
    spark: SparkSession, path: str, first_day: date | None, last_day: date | None, country: bool
) -> DataFrame:
    """invoice, customer_id, invoice_date, and country when asked for."""
    orders = table(spark, path, "orders")
    if first_day is not None:
        orders = orders.filter(F.col("o_orderdate") >= _midnight(first_day))
    if last_day is not None:
        orders = orders.filter(F.col("o_orderdate") < _midnight(last_day + timedelta(days=1)))
    orders = orders.select(
        F.col("o_orderkey").alias("invoice"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("invoice_date"),
    )
    if not country:
        return orders
    nation = table(spark, path, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
    )
    customer = table(spark, path, "customer").select(
        F.col("c_custkey").alias("customer_id"), "c_nationkey"
    )
    # Left joins: an order of an unknown customer or country stays, with a null country.
    return orders.join(customer.join(nation, "c_nationkey", "left"), "customer_id", "left")


def star_lines(
    spark: SparkSession,
    path: str,
    columns: Iterable[str] = LINE_COLUMNS,
    first_day: date | None = None,
    last_day: date | None = None,
    unique: bool = True,
) -> DataFrame:
    """Invoice lines with the given columns.

    Order, item and signed quantity decide every other column, so repeated
    lines are dropped on those three before any join: the widest shuffle of the
    pipeline carries three numbers. With a first_day the few orders of that
    window thin out the lines instead, and repeats go after that join.
    Dimensions whose columns are not asked for are not read. With unique=False
    lines may repeat, for questions that drop repeats themselves.
    """
    columns = list(columns)
    unknown = set(columns) - set(LINE_COLUMNS)
    if unknown:
        raise ValueError(f"unknown line columns: {sorted(unknown)}")

    lines = _signed_lines(spark, path)
    if unique and first_day is None:
        lines = lines.distinct()
    joined = lines.join(_orders(spark, path, first_day, last_day, "country" in columns), "invoice")
    if unique and first_day is not None:
        joined = joined.distinct()
    if "description" in columns or "price" in columns:
        part = table(spark, path, "part").select(
            F.col("p_partkey").alias("stock_code"),
            F.col("p_name").alias("description"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
        )
        joined = joined.join(part, "stock_code", "left")
    return joined.select(*columns)


def sold_orders(
    spark: SparkSession, path: str, first_day: date | None = None, last_day: date | None = None
) -> DataFrame:
    """Orders with at least one line sold: invoice, customer_id, invoice_date, country.

    Enough for questions about who bought when. Lines fold to order numbers
    before the shuffle that the join needs anyway.
    """
    sold = _signed_lines(spark, path).filter(F.col("quantity") > 0).select("invoice").distinct()
    return sold.join(_orders(spark, path, first_day, last_day, country=True), "invoice")
