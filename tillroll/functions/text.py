"""Text clean-up and display text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_space(text: Column) -> Column:
    """Remove blanks, tabs and line ends at both ends."""
    return F.btrim(text, F.lit(" \t\r\n"))


def strip_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit(""))


def snake_name(name: str) -> str:
    """'Invoice Date', 'InvoiceDate' and 'Invoice.Date' all become invoice_date."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


def snake_columns(df: DataFrame) -> DataFrame:
    """Snake-case every column; a repeated name gets _2, _3 and so on."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = snake_name(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def title_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("_", " ").title() for c in df.columns])


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("_", " ").upper() for c in df.columns])


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def comma(value: Column, digits: int = 0) -> Column:
    return F.format_number(value.cast("double"), digits)


def dollars(value: Column, digits: int = 2) -> Column:
    amount = value.cast("double")
    sign = F.when(F.round(amount, digits) < 0, "-").otherwise("")
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(amount), digits))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(value.cast("double") * 100, digits), F.lit("%"))


def thousands(value: Column) -> Column:
    """1234.5 becomes $1.2K."""
    return F.concat(F.lit("$"), F.round(value.cast("double") / 1000, 1).cast("string"), F.lit("K"))


def share(part: Column, total: Column) -> Column:
    """part / total, and 0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def floor_small(value: Column, least: float = 5.0) -> Column:
    """Forecasts under `least` count as none."""
    return F.when(value < least, F.lit(0.0)).otherwise(value)


def residual_bucket(residual: Column) -> Column:
    """Bucket of actual minus predicted spend, first match wins, ends included.

    Values between two ranges (say 250.5) fall in color7.
    """
    # The ranges of the eight buckets.
    ranges = [
        (-500, -250, "color0"),
        (-249, 0, "color1"),
        (0, 250, "color2"),
        (251, 500, "color3"),
        (501, 1000, "color4"),
        (1001, 1250, "color5"),
        (1251, 1500, "color6"),
    ]
    low, high, name = ranges[0]
    bucket = F.when(residual.between(low, high), name)
    for low, high, name in ranges[1:]:
        bucket = bucket.when(residual.between(low, high), name)
    return bucket.otherwise("color7")
