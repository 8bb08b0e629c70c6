"""The registered questions over the star-schema tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.config import STAR, Settings
from tillroll.operators import clean, cohorts, customers, metrics, outliers, recommend, series
from tillroll.operators import similarity, split
from tillroll.operators.ordering import number_rows
from tillroll.plans import customer_value, demand, views
from tillroll.session import configure
from tillroll.sources.star import LINE_COLUMNS, sold_orders, star_lines

S: Settings = STAR
WINDOW_START = S.as_of - timedelta(days=S.horizon)
# The cohort, country and days of the cohort question.
COHORT = {"cohorts": ["Q2-1995"], "countries": [S.home_country]}
NAIVE = "SEASONAL NAIVE"

CUSTOMER_COLUMNS = ("customer_id", "invoice_date", "quantity", "price", "country", "stock_code")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for readers without a decimal type."""
    return df.withColumns(
        {c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")}
    )


def sales(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = LINE_COLUMNS,
    first_day: date | None = None,
    unique: bool = True,
) -> DataFrame:
    """Clean sales up to the cut-off day. Day limits also go down to the orders scan."""
    configure(spark)
    lines = star_lines(spark, path, columns, first_day, S.as_of, unique)
    cleaned = clean.clean_sales(lines, S, unique=True)
    return clean.as_of(cleaned, S.as_of)


def buying_days(spark: SparkSession, path: str) -> DataFrame:
    """Who bought when and in which country; a row per order, no line is needed."""
    configure(spark)
    orders = sold_orders(spark, path, last_day=S.as_of)
    return clean.as_of(clean.clean_sales(orders, S, unique=True), S.as_of)


def bounds(spark: SparkSession, path: str) -> split.TimeBounds:
    return split.time_bounds(buying_days(spark, path), S)


def purchases(spark: SparkSession, path: str) -> DataFrame:
    return cohorts.first_purchase(buying_days(spark, path))


def recent_sales(spark: SparkSession, path: str) -> DataFrame:
    """The last 90 days, both ends included."""
    return sales(spark, path, first_day=WINDOW_START)


def recent_items(spark: SparkSession, path: str) -> DataFrame:
    columns = ("customer_id", "stock_code", "quantity", "invoice_date", "country")
    return similarity.user_items(sales(spark, path, columns, WINDOW_START, unique=False))


def features(spark: SparkSession, path: str) -> DataFrame:
    return customers.customer_features(
        sales(spark, path, CUSTOMER_COLUMNS + ("invoice",)), bounds(spark, path), S
    )


def daily(spark: SparkSession, path: str) -> DataFrame:
    columns = ("invoice", "stock_code", "customer_id", "quantity", "invoice_date", "country")
    return series.daily_quantity(sales(spark, path, columns), S)


def daily_log(spark: SparkSession, path: str) -> DataFrame:
    return series.pad_days(series.log_scale(daily(spark, path)))


def feature_frame(spark: SparkSession, path: str) -> DataFrame:
    longer = series.extend_days(daily_log(spark, path), S.horizon)
    return series.series_features(longer, S)


# --- customers -------------------------------------------------------------


def clean_sales(spark, path):
    return plain(sales(spark, path))


def date_range(spark, path):
    return clean.date_range(buying_days(spark, path))


def first_purchase(spark, path):
    return purchases(spark, path)


def first_purchase_per_country(spark, path):
    return cohorts.first_purchase(buying_days(spark, path), per_country=True)


def cohort_sizes(spark, path):
    return cohorts.cohort_sizes(purchases(spark, path))


def analysis_cohort(spark, path):
    return plain(
        cohorts.analysis_cohort(
            recent_sales(spark, path), purchases(spark, path), WINDOW_START, S.as_of, **COHORT
        )
    )


def analysis_cohort_all(spark, path):
    """The window's sales of every cohort and country."""
    rows = recent_sales(spark, path)
    return plain(cohorts.analysis_cohort(rows, purchases(spark, path), WINDOW_START, S.as_of))


def customer_split(spark, path):
    return split.customer_split(buying_days(spark, path), S)


def rfm_features(spark, path):
    """Features up to the cut, both sides of the split."""
    return plain(features(spark, path).select("customer_id", "split", *customers.FEATURES))


def clv_training_table(spark, path):
    return plain(customer_value.training_table(features(spark, path)))


def clv_testing_table(spark, path):
    return plain(customer_value.testing_table(features(spark, path)))


def clv_testing_history(spark, path):
    """Features of the test customers over all their lines, outcome days included."""
    lines = sales(spark, path, CUSTOMER_COLUMNS + ("invoice",))
    test = lines.filter(~split.is_train_customer(S))
    return plain(customers.rfm(test, bounds(spark, path).reference_day))


def rule_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions by plain rule instead of a model: spend as so far, probability by recency.

    They feed the same views and metrics as the models, where another engine can check them.
    """
    test = customer_value.testing_table(features(spark, path))
    ruled = test.withColumn("pred_total", F.col("sales_mean") * F.col("frequency") / 4000).withColumn(
        "pred_prob", 1 / (1 + F.abs("recency") / 30)
    )
    return cohorts.attach_customer(
        customer_value.with_residual(ruled), purchases(spark, path)
    )


def rule_facets(spark, path):
    wanted = {
        "country": [f"NATION_{k}" for k in range(0, 12)],
        "pred_total": (25, 225),
        "pred_prob": (0.05, 0.9),
        "spend_90_total": (0, 60000),
        "spend_90_flag": [0, 1],
        "recency": (0, 400),
        "frequency": (1, 60),
    }
    return plain(views.facet_filter(rule_predictions(spark, path), wanted))


def rule_facet_bounds(spark, path):
    return views.facet_bounds(rule_predictions(spark, path))


def rule_facet_choices(spark, path):
    return views.facet_choices(rule_predictions(spark, path))


def rule_customer_choices(spark, path):
    return views.customer_choices(rule_predictions(spark, path))


def rule_country_choices(spark, path):
    """Customers to choose from once countries are picked."""
    return views.customer_choices(rule_predictions(spark, path), ["NATION_1", "NATION_2"])


def rule_chart_rows(spark, path):
    return plain(views.residual_filter(rule_predictions(spark, path), views.CHART_RANGE))


def rule_table(spark, path):
    return views.clv_table(rule_predictions(spark, path))


def rule_bucket_table(spark, path):
    return views.clv_bucket_table(rule_predictions(spark, path))


def rule_labels(spark, path):
    return views.customer_label(rule_predictions(spark, path)).select("customer_id", "text")


def rule_segment_likely(spark, path):
    return plain(customer_value.likely_buyers(rule_predictions(spark, path)))


def rule_segment_unlikely(spark, path):
    return plain(customer_value.recent_but_unlikely(rule_predictions(spark, path), probability=0.6))


def rule_segment_missed(spark, path):
    return plain(customer_value.missed_opportunities(rule_predictions(spark, path)))


def rule_metrics(spark, path):
    scored = customer_value.metrics(rule_predictions(spark, path))
    return scored.select(*[F.round(c, 6).alias(c) for c in scored.columns])


def rule_roc_curve(spark, path):
    return metrics.roc_curve(rule_predictions(spark, path), "spend_90_flag", "pred_prob")


def scaled_features(spark, path):
    table = features(spark, path).select("customer_id", *customers.FEATURES)
    return views.scaled_features(table.drop("sales_mean"))


def customer_sample(spark, path):
    """A tenth of the customers, the same ones on every run."""
    table = features(spark, path).select("customer_id", *customers.FEATURES)
    return plain(customer_value.sample_customers(table, 0.1))


# --- similar customers and offers ------------------------------------------


def user_items(spark, path):
    return recent_items(spark, path)


def user_similarity(spark, path):
    """All similarities of the customers preselected for each country, to all customers."""
    pairs = recent_items(spark, path)
    buyers = pairs.select("customer_id").distinct().join(purchases(spark, path), "customer_id")
    return similarity.similarity_to(pairs, views.default_choices(buyers))


def nearest_customers(spark, path):
    return similarity.nearest_customers(recent_items(spark, path), S)


def nearest_items(spark, path):
    return similarity.nearest_items(recent_items(spark, path), S)


def opportunities(spark, path):
    return recommend.opportunities(recent_sales(spark, path), S)


def recommendations(spark, path):
    return recommend.recommendations(recent_sales(spark, path), S)


def scored_recommendations(spark, path):
    """Offers among the scored (test) customers only, from the 3 nearest: the dashboard's set-up."""
    test = customer_value.testing_table(features(spark, path))
    lines = clean.members_only(recent_sales(spark, path), test, "customer_id")
    return recommend.recommendations(lines, replace(S, n_closest=3))


def recommendation_text(spark, path):
    return recommend.offer_text(recommend.recommendations(recent_sales(spark, path), S))


def opportunity_table(spark, path):
    return views.offer_table(recommend.opportunities(recent_sales(spark, path), S))


# --- daily series ----------------------------------------------------------


def sales_by_country(spark, path):
    columns = ("invoice", "stock_code", "customer_id", "quantity", "invoice_date", "price", "country")
    return series.sales_by_country(sales(spark, path, columns))


def daily_quantity(spark, path):
    return daily(spark, path)


def weekday_profile(spark, path):
    return series.weekday_profile(daily(spark, path))


def padded_series(spark, path):
    return series.pad_days(daily(spark, path))


def future_frame(spark, path):
    longer = series.extend_days(series.pad_days(daily(spark, path)), S.horizon)
    return series.future_rows(longer).select("series", "invoice_date")


def numbered_series(spark, path):
    longer = series.extend_days(series.pad_days(daily(spark, path)), S.horizon)
    return number_rows(longer, "series", "invoice_date")


def ts_features(spark, path):
    frame = feature_frame(spark, path)
    return frame.select(
        "series", "invoice_date", *[F.round(c, 6).alias(c) for c in frame.columns[2:]]
    )


def calendar_signature(spark, path):
    return series.with_calendar(series.pad_days(daily(spark, path)))


def autocorrelation(spark, path):
    acf = series.autocorrelation(daily(spark, path), S.max_acf_lag)
    return acf.withColumn("acf", F.round("acf", 6))


def partial_autocorrelation(spark, path):
    acf = series.autocorrelation(daily(spark, path), S.max_acf_lag)
    both = series.partial_autocorrelation(acf)
    return both.withColumns({c: F.round(c, 6) for c in ("acf", "pacf")})


def cv_folds(spark, path):
    """The fold of every day of every series."""
    rows = series.pad_days(daily(spark, path))
    return rows.select("series", "invoice_date", split.fold_of(S, "series", "invoice_date").alias("fold"))


def cv_plan(spark, path):
    return split.cv_plan(series.pad_days(daily(spark, path)), S)


def cleaned_series(spark, path):
    """Series on log scale, every outlier marked and its replacement next to it."""
    cleaned = outliers.clean_series(daily_log(spark, path))
    marked = outliers.mark_windows(cleaned, S.repair_windows)
    return marked.select(
        "series",
        "invoice_date",
        F.round("total_quantity", 6).alias("total_quantity"),
        "is_outlier",
        F.round("total_quantity_cleaned", 6).alias("total_quantity_cleaned"),
        "in_window",
    )


def repaired_series(spark, path):
    repaired = outliers.repair_series(daily_log(spark, path), S)
    return repaired.withColumn("total_quantity", F.round("total_quantity", 6))


def peak_repaired_series(spark, path):
    """Series repaired in the week around each quarter's highest day."""
    rows = daily_log(spark, path)
    repaired = outliers.repair_series(rows, S, windows=outliers.peak_windows(rows))
    return repaired.withColumn("total_quantity", F.round("total_quantity", 6))


def naive_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Actual quantity next to the quantity one horizon ago."""
    padded = series.pad_days(daily(spark, path))
    before = F.lag("total_quantity", S.horizon).over(series.in_order())
    return (
        padded.withColumn("predicted", before.cast("double"))
        .withColumn("actual", F.col("total_quantity").cast("double"))
        .filter(F.col("predicted").isNotNull())
    )


def naive_accuracy(spark, path):
    scored = metrics.forecast_metrics(naive_pairs(spark, path), ["series"])
    return scored.select("series", *[F.round(c, 6).alias(c) for c in scored.columns[1:]])


def naive_forecast(spark: SparkSession, path: str) -> DataFrame:
    """History, and for the next 90 days the quantity one horizon ago, in forecast form."""
    longer = series.extend_days(series.pad_days(daily(spark, path)), S.horizon)
    before = F.lag("total_quantity", S.horizon).over(series.in_order())
    is_future = F.col("total_quantity").isNull()
    return longer.withColumn("_before", before).select(
        "series",
        F.when(is_future, NAIVE).otherwise("ACTUAL").alias("model_desc"),
        F.when(is_future, "prediction").otherwise("actual").alias("key"),
        "invoice_date",
        F.coalesce("total_quantity", "_before").cast("double").alias("value"),
    )


def naive_view(spark: SparkSession, path: str, days: int = 60, months: int = 6) -> DataFrame:
    return views.forecast_view(
        naive_forecast(spark, path), F.lit(NAIVE), S.view_start, S.horizon, days, months
    )


def naive_forecast_view(spark, path):
    return naive_view(spark, path)


def naive_forecast_table(spark, path):
    return views.forecast_table(naive_view(spark, path), S.home_country)


def naive_predictions(rows: DataFrame) -> DataFrame:
    """Three plain forecasts in the form of model predictions: one horizon ago, and its means."""
    lag = f"total_quantity_lag{S.horizon}"
    models = [(1, "LAG", lag), (2, "MEAN 7", f"{lag}_roll_7"), (3, "MEAN 28", f"{lag}_roll_28")]
    each = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("model_id"),
                    F.lit(name).alias("model_desc"),
                    F.col(column).alias("predicted"),
                )
                for k, name, column in models
            ]
        )
    )
    return rows.select(each, "series", "invoice_date", F.col("total_quantity").alias("label"))


def naive_test(spark: SparkSession, path: str) -> DataFrame:
    """Their predictions of the last 90 days, with the mean of the three."""
    history = series.history_rows(feature_frame(spark, path))
    last_day = history.agg(F.max("invoice_date")).scalar()
    test = history.filter(F.col("invoice_date") > F.date_sub(last_day, S.horizon))
    return demand.with_ensemble(naive_predictions(test), members=(1, 2, 3))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def naive_model_accuracy(spark, path):
    return rounded(demand.accuracy(naive_test(spark, path), per_series=True))


def naive_resample_accuracy(spark, path):
    history = series.history_rows(feature_frame(spark, path))
    assessed = split.cv_plan(naive_predictions(history), S).filter(F.col("part") == "test")
    return rounded(demand.resample_accuracy(assessed))


def naive_forecast_rows(spark, path):
    """History and the next 90 days by the plain forecasts, with intervals from the last 90."""
    frame = feature_frame(spark, path)
    future = demand.with_ensemble(naive_predictions(series.future_rows(frame)), members=(1, 2, 3))
    history = series.history_rows(frame).withColumn("label", F.col("total_quantity"))
    return rounded(demand.forecast_rows(future, history, naive_test(spark, path)))


RELATIONAL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_sales,
        date_range,
        first_purchase,
        first_purchase_per_country,
        cohort_sizes,
        analysis_cohort,
        customer_split,
        rfm_features,
        clv_training_table,
        clv_testing_table,
        clv_testing_history,
        rule_facets,
        rule_facet_bounds,
        rule_facet_choices,
        rule_customer_choices,
        rule_chart_rows,
        rule_table,
        rule_bucket_table,
        rule_labels,
        rule_segment_likely,
        rule_segment_unlikely,
        rule_segment_missed,
        rule_metrics,
        rule_roc_curve,
        scaled_features,
        customer_sample,
        user_items,
        user_similarity,
        nearest_customers,
        nearest_items,
        opportunities,
        recommendations,
        scored_recommendations,
        recommendation_text,
        opportunity_table,
        sales_by_country,
        daily_quantity,
        weekday_profile,
        padded_series,
        future_frame,
        numbered_series,
        ts_features,
        calendar_signature,
        autocorrelation,
        partial_autocorrelation,
        cv_plan,
        cv_folds,
        analysis_cohort_all,
        rule_country_choices,
        cleaned_series,
        repaired_series,
        peak_repaired_series,
        naive_accuracy,
        naive_model_accuracy,
        naive_resample_accuracy,
        naive_forecast_rows,
        naive_forecast_view,
        naive_forecast_table,
    )
}
