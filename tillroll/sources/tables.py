"""Readers of stored invoice lines, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.text import snake_columns

RAW_COLUMNS = {
    "Invoice": "string",
    "StockCode": "string",
    "Description": "string",
    "Quantity": "int",
    "InvoiceDate": "string",
    "Price": "decimal(18,2)",
    "Customer ID": "long",
    "Country": "string",
}


def _parsed(name: str, kind: str) -> tuple[Column, Column]:
    """The field as its type, and whether its text says something that the type can't hold."""
    text = F.trim(F.col(f"`{name}`"))
    if kind == "string":
        return F.col(f"`{name}`"), F.lit(False)
    # Numbers come as decimals first, so that 17850.0 is a whole number and 2.555 is noticed.
    wide = text.try_cast("decimal(38,10)")
    value = wide.try_cast(kind)
    given = text.isNotNull() & (text != "")
    return value, given & ~F.coalesce(value.cast("decimal(38,10)") == wide, F.lit(False))


def _text_lines(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The file's fields as text, by the names of its header row."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    return raw


def read_csv_lines(
    spark: SparkSession, path: str, columns: dict[str, str] = RAW_COLUMNS
) -> DataFrame:
    """Raw invoice lines of a CSV with a header row, columns by name, types declared.

    Reading a field that its type can't hold as it is fails with the field's
    text; bad_csv_lines lists such lines. Empty fields are null.
    """
    raw = _text_lines(spark, path, columns)
    fields = []
    for name, kind in columns.items():
        value, bad = _parsed(name, kind)
        why = F.concat(F.lit(f"{name} is not {kind}: "), F.col(f"`{name}`"))
        fields.append(F.when(bad, F.raise_error(why).cast(kind)).otherwise(value).alias(name))
    return snake_columns(raw.select(*fields))


def bad_csv_lines(
    spark: SparkSession, path: str, columns: dict[str, str] = RAW_COLUMNS
) -> DataFrame:
    """The lines that read_csv_lines refuses, as text."""
    raw = _text_lines(spark, path, columns)
    bad = F.lit(False)
    for name, kind in columns.items():
        bad = bad | _parsed(name, kind)[1]
    return raw.filter(bad)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or parquet when a path is given."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def write_table(df: DataFrame, path: str, month_of: str | None = None) -> None:
    """Overwrite a parquet table.

    With month_of the table is laid out by month of that date column, so a
    90-day question opens four folders. Rows are gathered by month first, and a
    month too large for one task is split, so there are neither many small files
    nor one huge one.
    """
    if month_of is None:
        df.write.mode("overwrite").parquet(path)
        return
    by_month = df.withColumn("sales_month", F.date_format(month_of, "yyyy-MM"))
    by_month = by_month.hint("rebalance", F.col("sales_month"))
    by_month.write.mode("overwrite").partitionBy("sales_month").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Export with every column as text."""
    text = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.write.mode("overwrite").option("header", True).csv(path)
