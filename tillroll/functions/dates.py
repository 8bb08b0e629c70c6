"""Calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_start(day: Column, rounding: str = "nearest") -> Column:
    """First day of the nearest quarter (a tie goes up), or of the quarter holding the day."""
    this = F.trunc(day, "quarter").cast("date")
    if rounding == "floor":
        return this
    if rounding != "nearest":
        raise ValueError(f"rounding must be nearest or floor, not {rounding}")
    following = F.add_months(this, 3)
    return F.when(F.datediff(following, day) <= F.datediff(day, this), following).otherwise(this)


def cohort_label(quarter: Column) -> Column:
    return F.concat(
        F.lit("Q"), F.quarter(quarter).cast("string"), F.lit("-"), F.year(quarter).cast("string")
    )


def weekday_label(day: Column) -> Column:
    return F.date_format(day, "E")


def fourier(day: Column, period: int, order: int = 1) -> tuple[Column, Column]:
    """Sine and cosine of the day number over a period in days."""
    angle = F.unix_date(day) * F.lit(2 * math.pi * order / period)
    return F.sin(angle), F.cos(angle)


def calendar_signature(day: Column) -> dict[str, Column]:
    """Name to expression of every calendar field of a day.

    Weeks of the month start on Sunday; `week` counts blocks of seven days from
    1 January; `mday7` is the block of seven days within the month.
    """
    week = F.floor((F.dayofyear(day) - 1) / 7) + 1
    month_first_weekday = F.dayofweek(F.trunc(day, "month"))
    fields = {
        "index_num": F.unix_date(day).cast("long") * 86400,
        "year": F.year(day),
        "half": F.when(F.quarter(day) <= 2, 1).otherwise(2),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "month_lbl": F.date_format(day, "MMMM"),
        "day": F.dayofmonth(day),
        "minute": F.lit(0),
        "second": F.lit(0),
        "am_pm": F.lit(1),
        "wday": F.dayofweek(day),
        "wday_lbl": F.date_format(day, "EEEE"),
        "mday": F.dayofmonth(day),
        "qday": F.datediff(day, F.trunc(day, "quarter")) + 1,
        "yday": F.dayofyear(day),
        "mweek": F.floor((F.dayofmonth(day) + month_first_weekday + 5) / 7).cast("int"),
        "week": week.cast("int"),
        "week2": F.pmod(week, F.lit(2)).cast("int"),
        "week3": F.pmod(week, F.lit(3)).cast("int"),
        "week4": F.pmod(week, F.lit(4)).cast("int"),
        "mday7": (F.floor(F.dayofmonth(day) / 7) + 1).cast("int"),
    }
    return fields
