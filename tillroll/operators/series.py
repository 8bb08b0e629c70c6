"""Daily series: totals, padding, future days, lag and rolling features, autocorrelation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tillroll.config import Settings
from tillroll.functions.dates import calendar_signature, fourier, weekday_label

SERIES, DAY, VALUE = "series", "invoice_date", "total_quantity"


def in_order() -> WindowSpec:
    return Window.partitionBy(SERIES).orderBy(DAY)


def sales_by_country(sales: DataFrame) -> DataFrame:
    """Quantity and sales per country with their shares, largest sales first."""
    totals = sales.groupBy("country").agg(
        F.sum("quantity").alias("total_quantity"), F.sum("sales").alias("total_sales")
    )
    grand = totals.agg(
        F.struct(F.sum("total_quantity").alias("quantity"), F.sum("total_sales").alias("sales"))
    ).scalar()
    return (
        totals.withColumn("_grand", grand)
        .select(
            "country",
            "total_quantity",
            F.col("total_sales").cast("double").alias("total_sales"),
            F.try_divide(F.col("total_quantity"), F.col("_grand.quantity")).alias("pct_total_qty"),
            F.try_divide(
                F.col("total_sales").cast("double"), F.col("_grand.sales").cast("double")
            ).alias("pct_total_sales"),
        )
        .orderBy(F.desc("total_sales"), "country")
    )


def daily_quantity(sales: DataFrame, settings: Settings) -> DataFrame:
    """Quantity per day of the home market and of all others. An unknown country stays unknown."""
    bucket = (
        F.when(F.col("country").isNull(), F.lit(None))
        .when(F.col("country") == settings.home_country, settings.home_country)
        .otherwise(settings.other_label)
    )
    return sales.groupBy(bucket.alias(SERIES), DAY).agg(F.sum("quantity").alias(VALUE))


def weekday_profile(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy(SERIES, weekday_label(F.col(DAY)).alias("wday"))
        .agg(F.sum(VALUE).alias(VALUE))
        .orderBy(SERIES, F.desc(VALUE), "wday")
    )


def log_scale(daily: DataFrame) -> DataFrame:
    return daily.withColumn(VALUE, F.log1p(F.col(VALUE).cast("double")))


def pad_days(daily: DataFrame) -> DataFrame:
    """Missing days between a series' own first and last day, with 0.

    Each row fills the gap up to the next row, so the calendar is made in place
    and nothing is joined.
    """
    days = daily.withColumn("_next", F.lead(DAY).over(in_order()))
    last = F.coalesce(F.date_sub("_next", 1), F.col(DAY))
    days = days.withColumn("_day", F.explode(F.sequence(F.col(DAY), last)))
    value = F.when(F.col("_day") == F.col(DAY), F.col(VALUE)).otherwise(F.lit(0))
    return days.select(SERIES, F.col("_day").alias(DAY), value.alias(VALUE))


def extend_days(daily: DataFrame, days: int) -> DataFrame:
    """History plus `days` future days after each series' own last day, value null."""
    longer = daily.withColumn("_next", F.lead(DAY).over(in_order()))
    end = F.when(F.col("_next").isNull(), F.date_add(DAY, days)).otherwise(F.col(DAY))
    longer = longer.withColumn("_day", F.explode(F.sequence(F.col(DAY), end)))
    value = F.when(F.col("_day") == F.col(DAY), F.col(VALUE))
    return longer.select(SERIES, F.col("_day").alias(DAY), value.alias(VALUE))


def future_rows(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col(VALUE).isNull())


def history_rows(frame: DataFrame) -> DataFrame:
    """Rows with a value and with every feature present; the series itself may be unknown."""
    return frame.filter(F.col(VALUE).isNotNull()).dropna(
        subset=[c for c in frame.columns if c != SERIES]
    )


def rolling(
    value: Column, period: int, how: Callable[[Column], Column] = F.avg
) -> Column:
    """Any aggregate over a centred window of rows that shrinks at both ends."""
    return how(value).over(in_order().rowsBetween(-((period - 1) // 2), period // 2))


def series_features(frame: DataFrame, settings: Settings) -> DataFrame:
    """Fourier terms, the value one horizon ago, and its centred rolling means.

    Expects padded days, so that a lag in rows is a lag in days.
    """
    lag = f"{VALUE}_lag{settings.horizon}"
    for period in settings.roll_periods:
        sine, cosine = fourier(F.col(DAY), period)
        frame = frame.withColumn(f"sin{period}_k1", sine).withColumn(f"cos{period}_k1", cosine)
    frame = frame.withColumn(lag, F.lag(VALUE, settings.horizon).over(in_order()))
    rolls = {f"{lag}_roll_{p}": rolling(F.col(lag), p) for p in settings.roll_periods}
    return frame.withColumns(rolls)


def with_calendar(frame: DataFrame, day: str = DAY) -> DataFrame:
    return frame.withColumns(calendar_signature(F.col(day)))


def autocorrelation(daily: DataFrame, max_lag: int, value: str = VALUE) -> DataFrame:
    """series, lag 1..max_lag, acf. One sort per series serves every lag."""
    x = F.col(value).cast("double")
    whole = Window.partitionBy(SERIES)
    centred = daily.select(SERIES, DAY, (x - F.avg(x).over(whole)).alias("x"))
    lags = range(1, max_lag + 1)
    shifted = centred.select(
        SERIES, "x", *[F.lag("x", k).over(in_order()).alias(f"x{k}") for k in lags]
    )
    sums = shifted.groupBy(SERIES).agg(
        F.sum(F.col("x") * F.col("x")).alias("power"),
        *[F.sum(F.col("x") * F.col(f"x{k}")).alias(f"{k}") for k in lags],
    )
    long = sums.unpivot([SERIES, "power"], [f"{k}" for k in lags], "lag", "product")
    return long.select(
        SERIES,
        F.col("lag").cast("int").alias("lag"),
        F.when(F.col("power") > 0, F.col("product") / F.col("power")).alias("acf"),
    )


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """Add pacf. A group is one series' lags, max_lag rows."""

    def recursion(rows: pd.DataFrame) -> pd.DataFrame:
        """Durbin-Levinson over the lags of one series."""
        rows = rows.sort_values("lag")
        r = rows["acf"].to_numpy()
        phi, out = [], []
        for k in range(len(r)):
            below = 1.0 - sum(p * r[j] for j, p in enumerate(phi))
            last = (r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))) / below
            phi = [p - last * q for p, q in zip(phi, reversed(phi))] + [last]
            out.append(last)
        return rows.assign(pacf=out)

    return acf.groupBy(SERIES).applyInPandas(
        recursion, "series string, lag int, acf double, pacf double"
    )


def display_tail(
    rows: DataFrame, horizon: int, days: int, months: int, first_day, keys: Sequence[str]
) -> DataFrame:
    """Drop the last horizon-days rows, then keep the last months*30 + days.

    days is held within 30..90 and months within 3..11.
    """
    days, months = clamp_view(days, months)
    cut = horizon - days
    newest = Window.partitionBy(*keys).orderBy(F.desc(DAY))
    return (
        rows.filter(F.col(DAY) >= F.lit(first_day))
        .withColumn("_at", F.row_number().over(newest))
        .filter((F.col("_at") > cut) & (F.col("_at") <= cut + months * 30 + days))
        .drop("_at")
    )


def clamp_view(days: int, months: int) -> tuple[int, int]:
    return min(max(days, 30), 90), min(max(months, 3), 11)
