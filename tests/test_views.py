import math
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.functions import text
from tillroll.operators import metrics
from tillroll.plans import customer_value, views


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def shown(spark, make, values, kind="double"):
    return [r[0] for r in column(spark, values, kind).select(make(F.col("x"))).collect()]


def test_residual_buckets(spark):
    got = shown(spark, text.residual_bucket, [-500.0, -249.5, -249.0, 0.0, 0.5, 250.5, 500.5, 1500.0, 1501.0])
    assert [int(c[-1]) for c in got] == [0, 7, 1, 1, 2, 7, 7, 6, 7]


def test_display_text(spark):
    assert shown(spark, text.dollars, [1234.5, -0.25, -0.001]) == ["$1,234.50", "-$0.25", "$0.00"]
    assert shown(spark, lambda c: text.dollars(c, 1), [Decimal("1000.07")], "decimal(18,2)") == ["$1,000.1"]
    assert shown(spark, text.percent, [0.92, 1.0]) == ["92.0%", "100.0%"]
    assert shown(spark, text.comma, [1234567.4]) == ["1,234,567"]
    assert shown(spark, text.thousands, [1234.5]) == ["$1.2K"]
    assert shown(spark, text.floor_small, [4.9, 5.0, 0.0]) == [0.0, 5.0, 0.0]


PREDICTIONS = (
    "customer_id long, pred_total double, pred_prob double, spend_90_total decimal(18,2), "
    "spend_90_flag int, recency int, frequency long, sales_sum decimal(18,2), sales_mean double, "
    "spend_actual_vs_pred double, country string, first_purchase_cohort string"
)


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [
        (1, 100.0, 0.95, Decimal("350.00"), 1, 3, 5, Decimal("900.00"), 180.0, 250.0, "France", "Q1-2010"),
        (2, 40.6, 0.10, Decimal("0.00"), 0, 20, 5, Decimal("90.00"), 18.0, -40.6, "Spain", "Q1-2010"),
        (3, 900.0, 0.15, Decimal("0.00"), 0, 200, 5, Decimal("50.00"), 10.0, -900.0, "Spain", "Q2-2010"),
        (4, 10.0, 0.55, Decimal("5000.00"), 1, 9, 5, Decimal("70.00"), 14.0, 4990.0, "France", "Q2-2010"),
    ]
    return spark.createDataFrame(rows, PREDICTIONS)


def ids(df):
    return [r["customer_id"] for r in df.collect()]


def test_segments(predictions):
    assert ids(customer_value.likely_buyers(predictions)) == [1, 4, 3, 2]
    assert ids(customer_value.recent_but_unlikely(predictions)) == [2]
    assert ids(customer_value.missed_opportunities(predictions)) == [3, 2]


def test_facets(predictions):
    pick = {"country": ["Spain"], "pred_prob": (0.1, 0.15), "recency": (0, 200)}
    assert sorted(ids(views.facet_filter(predictions, pick))) == [2, 3]
    assert sorted(ids(views.residual_filter(predictions))) == [1, 2]
    assert ids(views.residual_filter(predictions, views.CHART_RANGE).orderBy("customer_id")) == [1, 2]
    bounds = {r["facet"]: (r["low"], r["high"]) for r in views.facet_bounds(predictions).collect()}
    assert bounds["pred_total"] == (10.0, 900.0) and bounds["pred_prob"] == (0.1, 0.95)
    choices = {(r["facet"], r["choice"]) for r in views.facet_choices(predictions).collect()}
    assert ("country", "France") in choices and ("spend_90_flag", "0") in choices and len(choices) == 6
    assert ids(views.customer_choices(predictions, ["France"]).orderBy("customer_id")) == [1, 4]
    assert ids(views.default_choices(views.customer_choices(predictions))) == [1]


def test_scaled_features(predictions):
    rows = views.scaled_features(predictions).collect()
    got = {(r["customer_id"], r["feature"]): r["value_scaled"] for r in rows}
    assert len(rows) == 12
    assert all(got[(c, "frequency")] is None for c in (1, 2, 3, 4)), "one value has no scale"
    assert got[(1, "recency")] == 0 and got[(3, "recency")] == 10
    assert got[(4, "sales_sum")] == pytest.approx((70 - 50) / 850 * 10)


def test_tables(predictions):
    plain = views.clv_table(predictions, titles=True)
    assert "Spend 90 Total" in plain.columns
    row = plain.filter("`Customer Id` = 2").first()
    assert (row["Pred Prob"], row["Pred Total"], row["Spend Actual Vs Pred"]) == ("10.0%", "$40.6", "-$40.6")
    bucketed = views.clv_bucket_table(predictions).orderBy("customer_id").collect()
    assert [(r["customer_id"], r["color"], r["sales_sum"]) for r in bucketed] == [
        (1, "color2", "$900.00"), (2, "color1", "$90.00"),
    ]
    label = views.customer_label(predictions).filter("customer_id = 1").first()["text"]
    assert label.splitlines()[:2] == ["Customer ID: 1", "90-Day Spend Prob: 95.0%"]
    assert len(label.splitlines()) == 8


def forecast(spark):
    rows = []
    for series, end, level in (("United Kingdom", 400, 80.0), ("All Others", 400, 20.0)):
        for n in range(end):
            rows.append((series, "ACTUAL", "actual", date(2011, 1, 1) + timedelta(days=n), level))
        for n in range(end, end + 90):
            value = {("United Kingdom", end): 4.9, ("All Others", end): 0.0}.get((series, n), level)
            for model in ("A", "B"):
                rows.append((series, model, "prediction", date(2011, 1, 1) + timedelta(days=n), value))
    return spark.createDataFrame(
        rows, "series string, model_desc string, key string, invoice_date date, value double"
    )


def test_forecast_view_and_table(spark):
    chosen = F.when(F.col("series") == "United Kingdom", "A").otherwise("B")
    view = views.forecast_view(forecast(spark), chosen, date(2011, 1, 1), 90, days=40, months=5)
    counts = {(r["series"], r["period"]): r["n"] for r in view.groupBy("series", "period").agg(F.count("*").alias("n")).collect()}
    assert counts == {
        (s, p): n
        for s in ("United Kingdom", "All Others")
        for p, n in (("Trailing 5 Months", 150), ("40 Day Future Forecast", 40))
    }
    table = views.forecast_table(view, "United Kingdom")
    rows = {r["invoice_date"]: r for r in table.collect()}
    assert len(rows) == 190
    empty = rows[date(2011, 1, 1) + timedelta(days=400)]
    assert (empty["total_forecast"], empty["home_forecast_pct"]) == ("0", "0.0%")
    usual = rows[date(2011, 1, 1) + timedelta(days=410)]
    assert (usual["total_forecast"], usual["home_forecast_pct"], usual["others_forecast_pct"]) == (
        "100", "80.0%", "20.0%",
    )
    assert views.forecast_table(view, "United Kingdom", titles=True).columns[2] == "TOTAL FORECAST"


SCORES = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.5), (0, 0.5), (0, 0.5), (1, 0.2), (0, 0.1)]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame(SCORES, "flag int, score double").withColumn("y", F.lit(3.0))
    won = sum((p > n) + (p == n) / 2 for f, p in SCORES if f for g, n in SCORES if not g)
    got = metrics.spend_and_flag_metrics(df, F.col("y"), F.col("score"), "flag", "score").first()
    assert got["roc_auc"] == pytest.approx(won / 16)
    assert got["mae"] == pytest.approx(sum(3 - s for _, s in SCORES) / 8)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="flag", numBins=0)
    assert got["roc_auc"] == pytest.approx(judge.evaluate(df))


def test_rsq_of_a_constant_is_nan(spark):
    rows = [("a", date(2010, 1, d), 0.0, float(d)) for d in (1, 2, 3)]
    rows += [("b", date(2010, 1, d), float(d), 2.0 * d) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "series string, invoice_date date, actual double, predicted double")
    got = {r["series"]: r["rsq"] for r in metrics.forecast_metrics(df, ["series"]).collect()}
    assert math.isnan(got["a"]) and got["b"] == pytest.approx(1.0)


def test_roc_curve(spark):
    df = spark.createDataFrame(SCORES, "flag int, score double")
    points = {r["threshold"]: (r["specificity"], r["sensitivity"]) for r in metrics.roc_curve(df, "flag", "score").collect()}
    assert points[0.5] == (0.25, 0.75)
    assert points[0.9] == (1.0, 0.25)
    assert points[float("-inf")] == (0.0, 1.0) and points[float("inf")] == (1.0, 0.0)
    assert len(points) == 7


def test_forecast_metrics_step_within_a_series(spark):
    rows = [("a", date(2010, 1, d), float(y), float(p)) for d, y, p in ((1, 1, 2), (2, 3, 3), (3, 6, 5))]
    rows += [("b", date(2010, 1, d), float(y), float(p)) for d, y, p in ((1, 100, 100), (2, 0, 4), (3, 104, 100))]
    df = spark.createDataFrame(rows, "series string, invoice_date date, actual double, predicted double")
    df = df.withColumn("model_id", F.lit(1))
    got = metrics.forecast_metrics(df, ["model_id"]).first()
    errors = [1, 0, 1, 0, 4, 4]
    assert got["mae"] == pytest.approx(sum(errors) / 6)
    assert got["mase"] == pytest.approx((sum(errors) / 6) / ((2 + 3 + 100 + 104) / 4))
    assert got["rmse"] == pytest.approx((sum(e * e for e in errors) / 6) ** 0.5)
    assert got["mape"] == pytest.approx((1 + 0 + 1 / 6 + 0 + 4 / 104) / 5 * 100)
