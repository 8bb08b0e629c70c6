"""Replacing outliers of a weekly-seasonal series inside given windows of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.config import RepairWindow, Settings
from tillroll.operators.intervals import mark_days
from tillroll.operators.series import DAY, SERIES, VALUE, in_order, rolling


def clean_series(frame: DataFrame, value: str = VALUE, spread: float = 3.0) -> DataFrame:
    """Add `<value>_cleaned` and is_outlier.

    Trend is the centred 7-row mean, season the mean gap to the trend by weekday
    (made to sum to 0), and an outlier lies more than `spread` quartile ranges
    outside the quartiles of what remains. It is replaced by a straight line
    between its nearest good neighbours, season taken out and put back. Every
    window shares one partitioning, so a series is shuffled once.
    """
    whole = Window.partitionBy(SERIES)
    weekday = F.dayofweek(DAY)
    gap = F.col(value) - F.col("_trend")
    step = frame.withColumn("_trend", rolling(F.col(value), 7))
    step = step.withColumns(
        {f"_s{d}": F.avg(F.when(weekday == d, gap)).over(whole) for d in range(1, 8)}
    )
    present = F.filter(F.array(*[f"_s{d}" for d in range(1, 8)]), lambda s: s.isNotNull())
    centre = F.aggregate(present, F.lit(0.0), lambda a, s: a + s) / F.size(present)
    of_day = F.element_at(F.array(*[f"_s{d}" for d in range(1, 8)]), weekday)
    step = step.withColumn("_season", of_day - centre)
    step = step.withColumn("_rest", F.col(value) - F.col("_trend") - F.col("_season"))
    step = step.withColumn(
        "_q", F.percentile("_rest", F.array(F.lit(0.25), F.lit(0.75))).over(whole)
    )
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    reach = (q3 - q1) * spread
    step = step.withColumn("is_outlier", ~F.col("_rest").between(q1 - reach, q3 + reach))

    good = F.when(
        ~F.col("is_outlier"),
        F.struct(F.unix_date(DAY).alias("at"), (F.col(value) - F.col("_season")).alias("x")),
    )
    back = in_order().rowsBetween(Window.unboundedPreceding, -1)
    ahead = in_order().rowsBetween(1, Window.unboundedFollowing)
    step = step.withColumn("_good", good)
    step = step.withColumns(
        {
            "_before": F.last("_good", ignorenulls=True).over(back),
            "_after": F.first("_good", ignorenulls=True).over(ahead),
        }
    )
    before, after = F.col("_before"), F.col("_after")
    slope = (after["x"] - before["x"]) / (after["at"] - before["at"])
    line = F.coalesce(
        before["x"] + slope * (F.unix_date(DAY) - before["at"]), before["x"], after["x"]
    )
    cleaned = F.when(F.col("is_outlier"), F.coalesce(line + F.col("_season"), F.col(value)))
    return step.withColumn(f"{value}_cleaned", cleaned.otherwise(F.col(value))).select(
        *frame.columns, "is_outlier", f"{value}_cleaned"
    )


def mark_windows(frame: DataFrame, windows: tuple[RepairWindow, ...] | DataFrame) -> DataFrame:
    """Add in_window: the day lies in one of its series' windows, both ends included.

    Windows of the settings are broadcast, one row per series, so that side is
    as small as that list. Windows in a table (series, first_day, last_day) may be
    many and are joined by bucket of days. Overlapping windows repeat no row.
    """
    if isinstance(windows, DataFrame):
        return mark_days(frame, windows, [SERIES], DAY)
    if not windows:
        return frame.withColumn("in_window", F.lit(False))
    by_series: dict[str, list] = {}
    for w in windows:
        by_series.setdefault(w.series, []).append((w.first_day, w.last_day))
    table = frame.sparkSession.createDataFrame(
        list(by_series.items()),
        f"{SERIES} string, _windows array<struct<first_day: date, last_day: date>>",
    )
    marked = frame.join(F.broadcast(table), SERIES, "left")
    inside = F.exists("_windows", lambda w: F.col(DAY).between(w["first_day"], w["last_day"]))
    return marked.withColumn("in_window", F.coalesce(inside, F.lit(False))).drop("_windows")


def peak_windows(frame: DataFrame, reach: int = 3, value: str = VALUE) -> DataFrame:
    """The days around each series' highest day of every quarter (ties: the earliest day)."""
    quarter = F.trunc(DAY, "quarter").alias("_quarter")
    rank = F.struct(F.col(value).alias("value"), (-F.unix_date(DAY)).alias("order"))
    top = frame.where(F.col(value).isNotNull()).groupBy(SERIES, quarter).agg(F.max(rank).alias("_top"))
    peak = F.date_from_unix_date(-F.col("_top")["order"])
    return top.select(
        SERIES, F.date_sub(peak, reach).alias("first_day"), F.date_add(peak, reach).alias("last_day")
    )


def repair_series(
    frame: DataFrame, settings: Settings, value: str = VALUE, windows: DataFrame | None = None
) -> DataFrame:
    """Cleaned values inside the windows (those of the settings, if none are given), else as they are."""
    given = settings.repair_windows if windows is None else windows
    marked = mark_windows(clean_series(frame, value), given)
    repaired = F.when(F.col("in_window"), F.col(f"{value}_cleaned")).otherwise(F.col(value))
    return marked.withColumn(value, repaired).select(*frame.columns)
