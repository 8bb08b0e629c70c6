"""Tables as shown: filters, their bounds and choices, buckets, display text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import (
    columns_like,
    comma,
    dollars,
    floor_small,
    percent,
    residual_bucket,
    share,
    title_columns,
    upper_columns,
)
from tillroll.operators.series import DAY, SERIES, clamp_view, display_tail

# Digits each numeric filter is rounded to.
FACET_DIGITS = {
    "pred_total": 0,
    "pred_prob": 2,
    "spend_90_total": 0,
    "recency": 0,
    "frequency": 0,
}
FACET_CHOICES = ["country", "first_purchase_cohort", "spend_90_flag"]
RESIDUAL_RANGE = (-500, 2500)
CHART_RANGE = (-100, 1500)


def facet_filter(df: DataFrame, facets: dict) -> DataFrame:
    """A tuple is a closed range, a list a set of choices; columns left out are not filtered."""
    for column, wanted in facets.items():
        if isinstance(wanted, tuple):
            df = df.filter(F.col(column).between(*wanted))
        else:
            df = df.filter(F.col(column).isin(*wanted))
    return df


def residual_filter(df: DataFrame, ends: tuple[float, float] = RESIDUAL_RANGE) -> DataFrame:
    return df.filter(F.col("spend_actual_vs_pred").between(*ends))


def facet_bounds(df: DataFrame) -> DataFrame:
    """facet, low, high: one pass over the table."""
    ends = df.agg(
        *[
            F.struct(
                F.lit(c).alias("facet"),
                F.bround(F.min(F.col(c).cast("double")), d).alias("low"),
                F.bround(F.max(F.col(c).cast("double")), d).alias("high"),
            ).alias(c)
            for c, d in FACET_DIGITS.items()
        ]
    )
    return ends.select(F.inline(F.array(*FACET_DIGITS)))


def facet_choices(df: DataFrame) -> DataFrame:
    """facet, choice: the distinct values of each picker. Rows, so no list grows with the data."""
    picks = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("choice"))
                for c in FACET_CHOICES
            ]
        )
    )
    return df.select(picks.alias("pick")).select("pick.*").distinct().orderBy("facet", "choice")


def customer_choices(predictions: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Customers of the countries who did buy in the 90 days."""
    picked = predictions if countries is None else facet_filter(predictions, {"country": countries})
    buyers = picked.filter(F.col("spend_90_flag") == 1)
    return buyers.select("country", "customer_id").distinct()


def default_choices(choices: DataFrame) -> DataFrame:
    """The customer preselected for each country: the smallest id."""
    return choices.groupBy("country").agg(F.min("customer_id").alias("customer_id"))


def customer_label(predictions: DataFrame) -> DataFrame:
    """Add text: several lines about the customer."""
    lines = [
        F.concat(F.lit("Customer ID: "), F.col("customer_id").cast("string")),
        F.concat(F.lit("90-Day Spend Prob: "), percent(F.col("pred_prob"), 1)),
        F.concat(F.lit("90-Day Spend Pred: "), dollars(F.col("pred_total"))),
        F.concat(F.lit("Actual 90-Day Spend: "), dollars(F.col("spend_90_total"))),
        F.concat(F.lit("Actual vs Pred: "), dollars(F.col("spend_actual_vs_pred"))),
        F.lit("---"),
        F.concat(F.lit("Recency: "), F.col("recency").cast("string")),
        F.concat(F.lit("Frequency: "), F.col("frequency").cast("string")),
    ]
    return predictions.withColumn("text", F.concat_ws("\n", *lines))


def scaled_features(
    predictions: DataFrame, features: tuple[str, ...] = ("recency", "frequency", "sales_sum")
) -> DataFrame:
    """One row per customer and feature, the value scaled to 0..10 over all customers.

    A z-score before the rescale changes nothing, so only the ends are needed.
    A feature with one value has no scale: null.
    """
    doubles = predictions.withColumns({c: F.col(c).cast("double") for c in features})
    ends = doubles.agg(
        F.struct(
            *[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in features]
        ).alias("ends")
    ).scalar()
    keep = [c for c in predictions.columns if c not in features]
    rows = doubles.withColumn("_ends", ends).select(
        *keep,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(c).alias("value"),
                        F.try_divide(
                            (F.col(c) - F.col(f"_ends.{c}.low")) * 10,
                            F.col(f"_ends.{c}.high") - F.col(f"_ends.{c}.low"),
                        ).alias("value_scaled"),
                    )
                    for c in features
                ]
            )
        ),
    )
    return rows


def clv_table(predictions: DataFrame, digits: int = 1, titles: bool = False) -> DataFrame:
    """Every row as display text."""
    money = ["pred_total", "spend_90_total", "sales_sum", "sales_mean", "spend_actual_vs_pred"]
    first = ["customer_id", *[c for c in predictions.columns if c != "customer_id"]]
    table = predictions.select(*first).withColumn("pred_prob", percent(F.col("pred_prob"), digits))
    table = table.withColumns({c: dollars(F.col(c), digits) for c in money})
    return title_columns(table) if titles else table


def clv_bucket_table(predictions: DataFrame, digits: int = 2, titles: bool = False) -> DataFrame:
    """Rows with a residual within [-500, 2500], its bucket, and display text."""
    kept = residual_filter(predictions)
    columns = [
        "customer_id",
        "pred_prob",
        "pred_total",
        *columns_like(kept, prefix="spend"),
        "recency",
        "frequency",
        *columns_like(kept, prefix="sales"),
        "first_purchase_cohort",
        "country",
    ]
    kept = kept.select(*columns).withColumn("color", residual_bucket(F.col("spend_actual_vs_pred")))
    money = [
        *columns_like(kept, suffix="total"),
        *columns_like(kept, prefix="sales"),
        "spend_actual_vs_pred",
    ]
    table = kept.withColumns({c: dollars(F.col(c), digits) for c in money})
    table = table.withColumn("pred_prob", percent(F.col("pred_prob"), digits))
    return title_columns(table) if titles else table


def offer_table(offers: DataFrame, titles: bool = False) -> DataFrame:
    """Mean quantity without decimals, mean sales in dollars with one."""
    table = offers.withColumn("mean_quantity", comma(F.col("mean_quantity"))).withColumn(
        "mean_sales", dollars(F.col("mean_sales"), 1)
    )
    return title_columns(table) if titles else table


def forecast_view(
    forecast: DataFrame,
    chosen: Column,
    first_day: date,
    horizon: int = 90,
    days: int = 90,
    months: int = 11,
) -> DataFrame:
    """Recent history and forecast of every series, each with the model chosen for it.

    forecast: series, model_desc, key, invoice_date, value. chosen: the
    model_desc to show, as an expression over the series.
    """
    days, months = clamp_view(days, months)
    picked = forecast.filter((F.col("key") == "actual") | (F.col("model_desc") == chosen))
    daily = picked.groupBy(SERIES, "model_desc", "key", DAY).agg(F.sum("value").alias("value"))
    kept = display_tail(daily, horizon, days, months, first_day, [SERIES])
    period = F.when(F.col("key") == "actual", F.lit(f"Trailing {months} Months")).otherwise(
        F.lit(f"{days} Day Future Forecast")
    )
    lines = [
        F.concat(F.lit("Date: "), F.col(DAY).cast("string")),
        F.concat(F.lit("Country: "), F.col(SERIES)),
        F.concat(F.lit("Key: "), F.col("period")),
        F.concat(F.lit("Quantity Sold: "), comma(F.col("value"))),
    ]
    return kept.withColumn("period", period).select(
        SERIES, DAY, "key", "period", "value", F.concat_ws("\n", *lines).alias("text")
    )


def forecast_table(view: DataFrame, home: str, titles: bool = False) -> DataFrame:
    """Home and other quantity side by side per day, with shares of their sum.

    Sides meet on day and period, and a day only one side has counts 0 for the other.
    """
    value = floor_small(F.col("value"))
    at_home = F.col(SERIES).eqNullSafe(home)  # an unknown series is one of the others
    sides = view.groupBy(DAY, "period").agg(
        F.coalesce(F.sum(F.when(at_home, value)), F.lit(0.0)).alias("home_forecast"),
        F.coalesce(F.sum(F.when(~at_home, value)), F.lit(0.0)).alias(
            "others_forecast"
        ),
    )
    total = F.col("home_forecast") + F.col("others_forecast")
    table = sides.select(
        DAY,
        "period",
        comma(total).alias("total_forecast"),
        comma(F.col("home_forecast")).alias("home_forecast"),
        comma(F.col("others_forecast")).alias("others_forecast"),
        percent(share(F.col("home_forecast"), total), 1).alias("home_forecast_pct"),
        percent(share(F.col("others_forecast"), total), 1).alias("others_forecast_pct"),
    )
    return upper_columns(table) if titles else table
