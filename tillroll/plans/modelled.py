"""Registered questions that need fitted models.

Models are fitted once per application and table folder, as an analyst would fit,
save, and then look at the result from several sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import cohorts, metrics
from tillroll.operators.regressors import SERIES
from tillroll.plans import customer_value, demand, views
from tillroll.plans import artifacts
from tillroll.plans.catalog import (
    S,
    clv_testing_table,
    clv_training_table,
    feature_frame,
    features,
    plain,
    purchases,
)
from tillroll.session import stage

def once(spark: SparkSession, path: str, name: str, make):
    return artifacts.once(spark, path, name, make, S)


# --- customer value --------------------------------------------------------


def clv_models(spark: SparkSession, path: str):
    def make():
        table = stage(features(spark, path), "clv")
        spend, probability = customer_value.fit_models(customer_value.training_table(table), S)
        test = customer_value.testing_table(table)
        scored = stage(plain(customer_value.score(test, spend, probability)), "clv-scored")
        return spend, probability, scored

    return once(spark, path, "clv", make)


def scored_customers(spark: SparkSession, path: str) -> DataFrame:
    return cohorts.attach_customer(clv_models(spark, path)[2], purchases(spark, path))


def clv_predictions(spark, path):
    return clv_models(spark, path)[2]


def clv_metrics(spark, path):
    return customer_value.metrics(clv_models(spark, path)[2])


def clv_roc_curve(spark, path):
    return metrics.roc_curve(clv_models(spark, path)[2], "spend_90_flag", "pred_prob")


def clv_importance(spark, path):
    spend, probability, _ = clv_models(spark, path)
    return customer_value.importance(spend, probability, spark)


def clv_segment_likely(spark, path):
    return customer_value.likely_buyers(clv_models(spark, path)[2])


def clv_segment_unlikely(spark, path):
    return customer_value.recent_but_unlikely(clv_models(spark, path)[2])


def clv_segment_missed(spark, path):
    return customer_value.missed_opportunities(clv_models(spark, path)[2])


def clv_facets(spark, path):
    """Home-market customers with a fair chance of buying."""
    wanted = {"country": [S.home_country], "pred_prob": (0.2, 1.0)}
    return views.facet_filter(scored_customers(spark, path), wanted)


def clv_facet_bounds(spark, path):
    return views.facet_bounds(clv_models(spark, path)[2])


def clv_table(spark, path):
    return views.clv_table(scored_customers(spark, path))


def clv_bucket_table(spark, path):
    return views.clv_bucket_table(scored_customers(spark, path))


def clv_scaled_features(spark, path):
    scored = clv_models(spark, path)[2]
    return views.scaled_features(scored.drop("sales_mean"))


# --- demand ----------------------------------------------------------------


def panel(spark: SparkSession, path: str) -> demand.Panel:
    return once(spark, path, "panel", lambda: demand.prepare(feature_frame(spark, path), S))


def base_models(spark: SparkSession, path: str) -> dict:
    return once(spark, path, "base", lambda: demand.fit_base(panel(spark, path), S))


def base_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Test-part predictions of the six base models."""

    def make():
        found = demand.predict(base_models(spark, path), panel(spark, path).test)
        return stage(found, "base-test")

    return once(spark, path, "base-test", make)


def tuned(spark: SparkSession, path: str) -> demand.Tuned:
    return once(spark, path, "tuned", lambda: demand.tune(panel(spark, path), S))


def test_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Test-part predictions of all ten models."""

    def make():
        found = demand.predict(tuned(spark, path).models, panel(spark, path).test)
        return stage(found.unionByName(base_predictions(spark, path)), "test-predictions")

    return once(spark, path, "test", make)


def forecast_fit_accuracy(spark, path):
    return demand.accuracy(base_predictions(spark, path))


def forecast_test_base(spark, path):
    """History, and the test part as the six base models saw it."""
    found = base_predictions(spark, path)
    return demand.forecast_rows(found, panel(spark, path).history, found)


def forecast_future_base(spark, path):
    """History, and the next 90 days by the six base models as first fitted."""
    p = panel(spark, path)
    predictions = demand.predict(base_models(spark, path), p.future)
    return demand.forecast_rows(predictions, p.history, base_predictions(spark, path))


def tuning_results(spark, path):
    return tuned(spark, path).results


def forecast_tuned_accuracy(spark, path):
    return demand.accuracy(test_predictions(spark, path))


def forecast_ensemble_accuracy(spark, path):
    members = F.col("model_id").isin(*demand.ENSEMBLE_OF)
    return demand.accuracy(demand.with_ensemble(test_predictions(spark, path).filter(members)))


def forecast_accuracy(spark, path):
    """Ensemble and its members, per series."""
    members = F.col("model_id").isin(*demand.ENSEMBLE_OF)
    both = demand.with_ensemble(test_predictions(spark, path).filter(members))
    return demand.accuracy(both, per_series=True)


def forecast_test(spark, path):
    """History, and the test part as each model saw it."""
    found = demand.with_ensemble(test_predictions(spark, path))
    return demand.forecast_rows(found, panel(spark, path).history, found)


def refitted_models(spark: SparkSession, path: str) -> dict:
    return once(
        spark, path, "refit", lambda: demand.refit(panel(spark, path), tuned(spark, path), S)
    )


def forecast_future(spark, path):
    """History, and the next 90 days by the ensemble and the tuned models in it."""

    def make():
        forecast = demand.future_forecast(
            panel(spark, path), refitted_models(spark, path), test_predictions(spark, path)
        )
        return stage(forecast, "future-forecast")

    return once(spark, path, "future", make)


def forecast_view(spark, path):
    chosen = F.when(F.col(SERIES) == S.home_country, S.home_model).otherwise(S.other_model)
    return views.forecast_view(forecast_future(spark, path), chosen, S.view_start, S.horizon)


def forecast_table(spark, path):
    return views.forecast_table(forecast_view(spark, path), S.home_country)


def resample_accuracy(spark, path):
    def make():
        return demand.resample_predictions(panel(spark, path), tuned(spark, path), S)

    return demand.resample_accuracy(once(spark, path, "resamples", make))


# --- saving ----------------------------------------------------------------


def _customer_value_set(spark: SparkSession, path: str) -> tuple[dict, dict]:
    spend, probability, _ = clv_models(spark, path)
    questions = (clv_training_table, clv_testing_table, clv_predictions, clv_metrics, clv_importance)
    return {"spend": spend, "probability": probability}, {q.__name__: q(spark, path) for q in questions}


def _demand_set(spark: SparkSession, path: str) -> tuple[dict, dict]:
    p = panel(spark, path)
    questions = (
        forecast_fit_accuracy, forecast_tuned_accuracy, forecast_ensemble_accuracy,
        forecast_accuracy, forecast_test, forecast_future, resample_accuracy, tuning_results,
    )
    tables = {q.__name__: q(spark, path) for q in questions} | {"rows": p.rows}
    models = {f"refitted_{k}": m for k, m in refitted_models(spark, path).items()}
    return {"spec": p.spec, **models}, tables


def save_customer_value(spark: SparkSession, path: str, folder: str) -> None:
    """Both models with the tables they were fitted on and the predictions."""
    artifacts.save(folder, *_customer_value_set(spark, path), artifacts.fingerprint(spark, path, S))


def save_demand(spark: SparkSession, path: str, folder: str) -> None:
    """The refitted models, all accuracy tables, both forecasts and the prepared rows."""
    artifacts.save(folder, *_demand_set(spark, path), artifacts.fingerprint(spark, path, S))


def saved_customer_value(spark: SparkSession, path: str, folder: str) -> tuple[dict, dict]:
    """Models and tables of save_customer_value: read if an earlier session saved them for these tables."""
    made_from = artifacts.fingerprint(spark, path, S)
    return artifacts.saved(spark, folder, made_from, lambda: _customer_value_set(spark, path))


def saved_demand(spark: SparkSession, path: str, folder: str) -> tuple[dict, dict]:
    """Models and tables of save_demand: read if an earlier session saved them for these tables."""
    made_from = artifacts.fingerprint(spark, path, S)
    return artifacts.saved(spark, folder, made_from, lambda: _demand_set(spark, path))


MODELLED = {
    f.__name__: f
    for f in (
        clv_predictions,
        clv_metrics,
        clv_roc_curve,
        clv_importance,
        clv_segment_likely,
        clv_segment_unlikely,
        clv_segment_missed,
        clv_facets,
        clv_facet_bounds,
        clv_table,
        clv_bucket_table,
        clv_scaled_features,
        forecast_fit_accuracy,
        forecast_test_base,
        forecast_future_base,
        tuning_results,
        forecast_tuned_accuracy,
        forecast_ensemble_accuracy,
        forecast_accuracy,
        forecast_test,
        forecast_future,
        forecast_view,
        forecast_table,
        resample_accuracy,
    )
}
