"""Train and test parts, by customer and by time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.config import Settings


def percent_bucket(key: Column) -> Column:
    """0 to 99 from a digest of the key: the same customer always lands in the same place."""
    digest = F.substring(F.md5(key.cast("string")), 1, 8)
    return (F.conv(digest, 16, 10).cast("long") % 100).cast("int")


def is_train_customer(settings: Settings, key: str = "customer_id") -> Column:
    return percent_bucket(F.col(key)) < settings.train_percent


def customer_split(sales: DataFrame, settings: Settings) -> DataFrame:
    """Each customer once, marked train or test."""
    side = F.when(is_train_customer(settings), "train").otherwise("test")
    return sales.select("customer_id").distinct().withColumn("split", side)


def fold_of(settings: Settings, *keys: str) -> Column:
    """Fold number 0..folds-1 of a row, from a digest of the seed and its keys."""
    named = F.concat_ws("|", F.lit(str(settings.seed)), *[F.col(k).cast("string") for k in keys])
    digest = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")
    return (digest % settings.tune_folds).cast("int")


@dataclass(frozen=True)
class TimeBounds:
    cut_day: date
    reference_day: date


def time_bounds(sales: DataFrame, settings: Settings) -> TimeBounds:
    """The two days that split history from outcome, read from the data.

    cut_day is the last day less the horizon: later lines are the outcome.
    reference_day is the last day up to the cut on which a train customer
    bought; recency counts from it for both sides of the split.

    Lines fold to one row per calendar day first, and only the two days come
    back, so that later plans hold them as literals.
    """
    days = sales.groupBy("invoice_date").agg(
        F.max(is_train_customer(settings).cast("int")).alias("has_train")
    )
    last_day = days.agg(F.max("invoice_date")).scalar()
    cut = F.date_sub(last_day, settings.horizon)
    train_day = F.when((F.col("has_train") == 1) & (F.col("invoice_date") <= cut), F.col("invoice_date"))
    row = days.agg(F.max(cut).alias("cut_day"), F.max(train_day).alias("reference_day")).first()
    return TimeBounds(row["cut_day"], row["reference_day"])


def horizon_slices(last_day: Column, settings: Settings) -> Column:
    """Array of rolling-origin slices, newest first: each assesses one horizon of days.

    Train days are all days before the assessed ones (cumulative).
    """
    h = settings.horizon
    return F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("slice_id"),
                F.date_sub(last_day, h * (k + 1)).alias("train_end"),
                F.date_sub(last_day, h * k).alias("assess_end"),
            )
            for k in range(settings.cv_slices)
        ]
    )


def cv_plan(rows: DataFrame, settings: Settings, day: str = "invoice_date") -> DataFrame:
    """Every row once per slice that can see it, labelled train or test.

    A slice needs a train day, so slices that reach before the first day are
    left out. The slices are an array on each row: no join.
    """
    ends = rows.agg(
        F.struct(F.min(day).alias("first_day"), F.max(day).alias("last_day")).alias("ends")
    ).scalar()
    slices = F.filter(
        horizon_slices(F.col("_ends.last_day"), settings),
        lambda s: s["train_end"] >= F.col("_ends.first_day"),
    )
    each = rows.withColumn("_ends", ends).withColumn("_slice", F.explode(slices))
    return (
        each.filter(F.col(day) <= F.col("_slice.assess_end"))
        .withColumn("slice_id", F.col("_slice.slice_id"))
        .withColumn(
            "part", F.when(F.col(day) <= F.col("_slice.train_end"), "train").otherwise("test")
        )
        .drop("_ends", "_slice")
    )
