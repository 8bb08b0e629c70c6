"""Daily demand: fit, tune, combine, score and forecast.

Models are Spark ML pipelines over all series together, so more series mean more
rows, not more models. Forecasts are rows, which makes the ensemble, intervals
and metrics plain aggregations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.config import Settings
from tillroll.operators import committees, regressors, splines
from tillroll.operators.metrics import forecast_metrics, shown
from tillroll.operators.ordering import grouped_percentile
from tillroll.operators.outliers import repair_series
from tillroll.operators.series import (
    DAY,
    SERIES,
    VALUE,
    future_rows,
    history_rows,
    with_calendar,
)
from tillroll.operators.split import cv_plan, fold_of
from tillroll.plans.fitting import Fit, fit_all, side_by_side
from tillroll.session import stage

# Model ids are fixed values, tuned models first, then the base models; the names are ours.
NAMES = {
    1: "FOREST - Tuned",
    2: "BOOST - Tuned",
    3: "SPLINES - Tuned",
    4: "RULES - Tuned",
    5: "TREND",
    6: "BOOST",
    7: "TREND BOOST",
    8: "FOREST",
    9: "RULES",
    10: "SPLINES",
}
ENSEMBLE_OF = (8, 9, 1, 2)
ENSEMBLE = "ENSEMBLE (MEAN): 4 MODELS"
REFITTED = (1, 2)


@dataclass(frozen=True)
class Panel:
    """Prepared rows: series, invoice_date, label (log scale), features, plain features.

    Repair changes labels only, so all parts are filters of one written table.
    """

    rows: DataFrame
    spec: PipelineModel

    def _part(self, *parts: str) -> DataFrame:
        return self.rows.filter(F.col("part").isin(*parts))

    @property
    def train(self) -> DataFrame:
        return self._part("train")

    @property
    def train_cleaned(self) -> DataFrame:
        return self.train.withColumn("label", F.col("label_train_cleaned"))

    @property
    def test(self) -> DataFrame:
        return self._part("test")

    @property
    def history(self) -> DataFrame:
        return self._part("train", "test")

    @property
    def history_cleaned(self) -> DataFrame:
        return self.history.withColumn("label", F.col("label_history_cleaned"))

    @property
    def future(self) -> DataFrame:
        return self._part("future")


def prepare(frame: DataFrame, settings: Settings) -> Panel:
    """Split at one horizon before the last day, repair, and apply the feature spec.

    frame: padded history plus future days, with lag features. A series shorter
    than the horizon has no lag, hence no training row and no forecast.
    """
    frame = stage(with_calendar(frame), "panel")
    history = history_rows(frame)
    last_day = history.agg(F.max(DAY)).scalar()
    train = history.filter(F.col(DAY) <= F.date_sub(last_day, settings.horizon))
    spec = regressors.feature_spec(settings).fit(train)

    def repaired(rows: DataFrame, name: str) -> DataFrame:
        return repair_series(rows.select(SERIES, DAY, VALUE), settings).toDF(SERIES, DAY, name)

    future = future_rows(frame).dropna(subset=regressors.lag_columns(settings))
    part = (
        F.when(F.col(VALUE).isNull(), "future")
        .when(F.col("label_train_cleaned").isNull(), "test")
        .otherwise("train")
    )
    def with_repaired(rows: DataFrame, part: DataFrame, name: str) -> DataFrame:
        """Left join that also finds the unknown series."""
        clean = repaired(part, name).toDF("_series", "_day", name)
        same = F.col(SERIES).eqNullSafe(F.col("_series")) & (F.col(DAY) == F.col("_day"))
        return rows.join(clean, same, "left").drop("_series", "_day")

    rows = with_repaired(history.unionByName(future), train, "label_train_cleaned")
    rows = (
        with_repaired(rows, history, "label_history_cleaned")
        .withColumn("part", part)
        .withColumn("label", F.col(VALUE))
        .withColumn("fold", fold_of(settings, SERIES, DAY))
    )
    return Panel(stage(spec.transform(rows), "prepared"), spec)


def base_fits(settings: Settings) -> dict[int, Fit]:
    """The six untuned models, by id."""
    return {
        5: lambda train: regressors.trend_model(train, settings).fit(train),
        6: lambda train: regressors.boost(settings).fit(train),
        7: lambda train: regressors.trend_boost_model(train, settings).fit(train),
        8: lambda train: regressors.forest(settings).fit(train),
        9: lambda train: regressors.fit_rules(train, settings),
        10: lambda train: regressors.fit_splines(train, settings),
    }


def fit_base(panel: Panel, settings: Settings) -> dict[int, Transformer]:
    """Fitted on the training part as it is, without repair."""
    return fit_all(base_fits(settings), panel.train)


@dataclass(frozen=True)
class Tuned:
    models: dict[int, Transformer]
    chosen: dict[int, Fit]  # id -> a fit with the best parameters
    results: DataFrame  # model_id, model_desc, rank, rmse, parameters


def candidates(settings: Settings) -> dict[int, list[regressors.Candidate]]:
    return {
        1: regressors.forest_candidates(settings),
        2: regressors.boost_candidates(settings),
        3: regressors.spline_candidates(settings),
        4: regressors.rules_candidates(settings),
    }


def fit_of(model: int, candidate: regressors.Candidate, settings: Settings) -> Fit:
    if model == 1:
        return regressors.with_params(regressors.forest(settings), candidate).fit
    if model == 2:
        return regressors.with_params(regressors.boost(settings), candidate).fit
    make = regressors.fit_splines if model == 3 else regressors.fit_rules
    return lambda train: make(train, settings, **candidate)


def forest_errors(train: DataFrame, held: DataFrame, group: list, settings: Settings) -> list[float]:
    """Held-out errors of candidates that differ in trees.

    The larger forest is the smaller one and more trees of another seed, so all
    of them together cost the trees of the largest.
    """
    sizes = sorted({candidate["numTrees"] for candidate in group})
    rows, total, done = held.select("label", "features"), F.lit(0.0), 0
    means = {}
    for k, size in enumerate(sizes):
        more = {**group[0], "numTrees": size - done, "seed": settings.seed + k}
        rows = fit_of(1, more, settings)(train).transform(rows).withColumnRenamed("prediction", f"_more{k}")
        total = total + F.col(f"_more{k}") * (size - done)
        means[size], done = total / size, size
    errors = [F.col("label") - means[candidate["numTrees"]] for candidate in group]
    return list(rows.agg(*[F.sqrt(F.avg(e * e)) for e in errors]).first())


def boost_errors(train: DataFrame, held: DataFrame, group: list, settings: Settings) -> list[float]:
    """Held-out errors of candidates that differ in rounds: those of the longest fit after so many rounds."""
    longest = max(group, key=lambda candidate: candidate["maxIter"])
    after = fit_of(2, longest, settings)(train).evaluateEachIteration(held, "squared")
    return [math.sqrt(after[candidate["maxIter"] - 1]) for candidate in group]


def rules_errors(train: DataFrame, held: DataFrame, grid: list, settings: Settings) -> list[float]:
    """Held-out errors of all committees and neighbours, from the longest committee."""
    make = lambda: regressors.rules_model(settings)
    members = committees.fit_members(make, train, max(c["committees"] for c in grid))
    pairs = [(c["committees"], c["neighbors"]) for c in grid]
    known, asked = (committees.with_means(rows, members) for rows in (train, held))
    found = committees.corrected(asked, known, pairs, committees.spans(train)).toDF("_series", "_day", "predicted")
    same = F.col(SERIES).eqNullSafe(F.col("_series")) & (F.col(DAY) == F.col("_day"))
    joined = held.select(SERIES, DAY, "label").join(found, same)
    error = [F.col("label") - F.col("predicted")[k] for k in range(len(pairs))]
    return list(joined.agg(*[F.sqrt(F.avg(e * e)) for e in error]).first())


def cross_validate(train: DataFrame, grids: dict[int, list], settings: Settings) -> dict[int, list[float]]:
    """Mean error over the folds of every candidate of every model.

    All fits of all models and folds are one list of jobs. Candidates that are
    the start of a longer fit are scored by it, and splines need one pass for
    all folds and candidates. Folds without rows are left out.
    """
    spark = train.sparkSession
    train = train.persist()
    folds = sorted(r["fold"] for r in train.select("fold").distinct().collect())
    parts = {f: (train.filter(F.col("fold") != f).persist(), train.filter(F.col("fold") == f).persist()) for f in folds}
    jobs: dict = {}

    def splines_job() -> list[list[float]]:
        degree = max(c["prod_degree"] for c in grids[3])
        words = regressors.spline_dictionary(train, settings, degree)
        pairs = [(c["prod_degree"], c["num_terms"]) for c in grids[3]]
        return splines.fold_errors(splines.sums(train, words, fold="fold"), words, pairs)

    try:
        # The longest first, so that they don't end alone.
        for f, (rest, held) in parts.items():
            jobs[4, f, tuple(range(len(grids[4])))] = lambda r=rest, h=held: rules_errors(r, h, grids[4], settings)
        for model, size, score in ((2, "maxIter", boost_errors), (1, "numTrees", forest_errors)):
            for group in regressors.same_but(grids[model], size):
                asked = [grids[model][k] for k in group]
                for f, (rest, held) in parts.items():
                    jobs[model, f, tuple(group)] = (
                        lambda r=rest, h=held, a=asked, score=score: score(r, h, a, settings))
        jobs["splines"] = splines_job
        done = side_by_side(spark, jobs)
    finally:
        for frame in (train, *[p for pair in parts.values() for p in pair]):
            frame.unpersist()
    errors: dict[int, list[list[float]]] = {m: [[] for _ in grid] for m, grid in grids.items()}
    errors[3] = done.pop("splines")
    for (model, _, places), found in done.items():
        for place, error in zip(places, found, strict=True):
            errors[model][place].append(error)
    return {m: [sum(e) / len(e) for e in found] for m, found in errors.items()}


def tune(panel: Panel, settings: Settings) -> Tuned:
    """Cross-validate candidates of four models on the repaired training part, keep the best."""
    train = panel.train_cleaned
    grids = candidates(settings)
    errors = cross_validate(train, grids, settings)
    chosen, rows = {}, []
    for k, grid in grids.items():
        order = sorted(range(len(grid)), key=lambda i: errors[k][i])
        chosen[k] = fit_of(k, grid[order[0]], settings)
        rows += [
            (k, NAMES[k], place + 1, float(errors[k][i]), regressors.describe(grid[i]))
            for place, i in enumerate(order)
        ]
    results = train.sparkSession.createDataFrame(
        rows, "model_id int, model_desc string, rank int, rmse double, parameters string"
    )
    return Tuned(fit_all(chosen, train), chosen, results)


def predict(models: dict[int, Transformer], rows: DataFrame, names=NAMES) -> DataFrame:
    """model_id, model_desc, series, invoice_date, predicted (log scale), label."""
    parts = [
        model.transform(rows).select(
            F.lit(k).alias("model_id"),
            F.lit(names[k]).alias("model_desc"),
            SERIES,
            DAY,
            F.col("prediction").alias("predicted"),
            "label",
        )
        for k, model in models.items()
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def with_ensemble(predictions: DataFrame, members=ENSEMBLE_OF) -> DataFrame:
    """Add the mean of the member models as model 0."""
    mean = (
        predictions.filter(F.col("model_id").isin(*members))
        .groupBy(SERIES, DAY)
        .agg(F.avg("predicted").alias("predicted"), F.max("label").alias("label"))
        .withColumn("model_id", F.lit(0))
        .withColumn("model_desc", F.lit(ENSEMBLE))
    )
    return predictions.unionByName(mean)


def accuracy(predictions: DataFrame, per_series: bool = False) -> DataFrame:
    """Metrics per model, or per series and model on the quantity scale."""
    if per_series:
        pairs = predictions.withColumns(
            {"actual": F.expm1("label"), "predicted": F.expm1("predicted")}
        )
        keys = [SERIES, "model_id", "model_desc"]
        return shown(forecast_metrics(pairs, keys), keys)
    keys = ["model_id", "model_desc"]
    return shown(forecast_metrics(predictions.withColumnRenamed("label", "actual"), keys), keys)


def interval_widths(test_predictions: DataFrame) -> DataFrame:
    """Per model the 95 % reach of its errors on the test part, exact."""
    error = F.abs(F.col("label") - F.col("predicted"))
    return grouped_percentile(test_predictions.withColumn("error", error), "model_id", "error", 0.95, "reach")


def forecast_rows(
    predictions: DataFrame, history: DataFrame, test_predictions: DataFrame
) -> DataFrame:
    """Actuals and forecasts in one long table on the quantity scale, with intervals."""
    reach = F.broadcast(interval_widths(test_predictions))  # one row per model
    forecast = predictions.join(reach, "model_id", "left").select(
        SERIES,
        "model_id",
        "model_desc",
        F.lit("prediction").alias("key"),
        DAY,
        F.expm1("predicted").alias("value"),
        F.expm1(F.col("predicted") - F.col("reach")).alias("conf_lo"),
        F.expm1(F.col("predicted") + F.col("reach")).alias("conf_hi"),
    )
    none = F.lit(None).cast("double")
    actual = history.select(
        SERIES,
        F.lit(None).cast("int").alias("model_id"),
        F.lit("ACTUAL").alias("model_desc"),
        F.lit("actual").alias("key"),
        DAY,
        F.expm1("label").alias("value"),
        none.alias("conf_lo"),
        none.alias("conf_hi"),
    )
    return actual.unionByName(forecast)


def refit(panel: Panel, tuned: Tuned, settings: Settings) -> dict[int, Transformer]:
    """The ensemble's members on the whole repaired history, tuned ones with their best parameters."""
    fits = {**base_fits(settings), **tuned.chosen}
    return fit_all({k: fits[k] for k in ENSEMBLE_OF}, panel.history_cleaned)


def future_forecast(
    panel: Panel, refitted: dict[int, Transformer], test_predictions: DataFrame
) -> DataFrame:
    """Next 90 days by the ensemble and the two tuned models in it."""
    predictions = with_ensemble(predict(refitted, panel.future))
    shown_ids = F.col("model_id").isin(0, *REFITTED)
    return forecast_rows(
        predictions.filter(shown_ids), panel.history, with_ensemble(test_predictions)
    )


def resample_predictions(panel: Panel, tuned: Tuned, settings: Settings) -> DataFrame:
    """Every model fitted on every rolling-origin slice: slice_id, model, actual, predicted.

    The fits of all slices are one list of jobs, each a distributed job over its slice.
    """
    history = panel.train_cleaned
    # One aggregate names the slices that have both parts; a slice is a filter on days.
    parts = cv_plan(history.select(DAY), settings).groupBy("slice_id").agg(
        F.max(F.when(F.col("part") == "train", F.col(DAY))).alias("train_end"),
        F.min(F.when(F.col("part") == "test", F.col(DAY))).alias("test_start"),
        F.max(F.when(F.col("part") == "test", F.col(DAY))).alias("test_end"),
    )
    slices = parts.dropna().orderBy("slice_id").collect()  # cv_slices rows at most
    fits = {**base_fits(settings), **tuned.chosen}
    trains = {r["slice_id"]: history.filter(F.col(DAY) <= F.lit(r["train_end"])).persist() for r in slices}
    try:
        jobs = {(s, k): lambda t=t, fit=fit: fit(t) for k, fit in fits.items() for s, t in trains.items()}
        models = side_by_side(history.sparkSession, jobs)
        total = None
        for row in slices:
            test = history.filter(F.col(DAY).between(row["test_start"], row["test_end"]))
            own = {k: m for (s, k), m in models.items() if s == row["slice_id"]}
            rows = predict(own, test).withColumn("slice_id", F.lit(row["slice_id"]))
            total = rows if total is None else total.unionByName(rows)
        if total is None:
            return history.sparkSession.createDataFrame(
                [], "model_id int, model_desc string, series string, invoice_date date, "
                    "predicted double, label double, slice_id int")
        return stage(total, "resamples")
    finally:
        for frame in trains.values():
            frame.unpersist()


def resample_accuracy(predictions: DataFrame) -> DataFrame:
    """Mean and spread over the slices of each model's rmse."""
    error = F.col("label") - F.col("predicted")
    per_slice = predictions.groupBy("model_id", "model_desc", "slice_id").agg(
        F.sqrt(F.avg(error * error)).alias("rmse")
    )
    return (
        per_slice.groupBy("model_id", "model_desc")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("rmse").alias("rmse_mean"),
            F.stddev_samp("rmse").alias("rmse_sd"),
        )
        .orderBy("rmse_mean", "model_id")
    )
