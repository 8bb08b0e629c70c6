"""Models have no exact answer: check what must hold for any of them."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import regressors, series
from tillroll.plans import artifacts, customer_value, demand


@pytest.fixture(scope="module")
def people(spark):
    draw = random.Random(1)
    rows = []
    for c in range(300):
        recency, frequency = -draw.randrange(200), draw.randint(1, 40)
        buys = draw.random() < (0.9 if recency > -60 else 0.15)
        spend = Decimal(frequency * 10 + draw.randrange(20)) if buys else Decimal(0)
        total = Decimal(frequency * 12)
        rows.append((c, recency, frequency, total, float(total) / frequency, spend, int(buys)))
    schema = (
        "customer_id long, recency int, frequency long, sales_sum decimal(18,2), "
        "sales_mean double, spend_90_total decimal(18,2), spend_90_flag int"
    )
    return spark.createDataFrame(rows, schema)


def test_customer_value(spark, people, retail, tmp_path):
    train, test = people.filter("customer_id < 240"), people.filter("customer_id >= 240")
    spend, probability = customer_value.fit_models(train, retail)
    scored = customer_value.score(test, spend, probability).cache()
    assert scored.count() == 60
    assert scored.filter("pred_prob < 0 or pred_prob > 1 or recency < 0").isEmpty()
    assert scored.filter("abs(spend_90_total - pred_total - spend_actual_vs_pred) > 1e-9").isEmpty()
    got = customer_value.metrics(scored).first()
    assert got["roc_auc"] > 0.7 and got["mae"] > 0
    weights = customer_value.importance(spend, probability, spark)
    sums = {r["model"]: r["s"] for r in weights.groupBy("model").agg(F.sum("importance").alias("s")).collect()}
    assert sums == pytest.approx({"spend": 1.0, "probability": 1.0})

    again = customer_value.score(test, *customer_value.fit_models(train, retail))
    assert again.select("customer_id", "pred_total").exceptAll(scored.select("customer_id", "pred_total")).isEmpty()

    folder = str(tmp_path / "clv")
    artifacts.save(folder, {"spend": spend, "probability": probability}, {"predictions": scored})
    saved = customer_value.score(
        test, artifacts.load_model(folder, "spend"), artifacts.load_model(folder, "probability")
    )
    assert saved.exceptAll(artifacts.load_table(spark, folder, "predictions")).isEmpty()


@pytest.fixture(scope="module")
def frame(spark):
    draw = random.Random(4)
    rows = []
    for name, level in (("United Kingdom", 800), ("All Others", 150)):
        for n in range(520):
            day = date(2010, 1, 1) + timedelta(days=n)
            rows.append((name, day, int(level * (1 + 0.5 * (day.weekday() < 5)) + draw.randrange(60))))
    return spark.createDataFrame(rows, "series string, invoice_date date, total_quantity long")


@pytest.fixture(scope="module")
def panel(frame):
    from dataclasses import replace

    from tillroll.config import ONLINE_RETAIL

    settings = replace(ONLINE_RETAIL, tune_candidates=2, tune_folds=2, forest_trees=5, cv_slices=2)
    longer = series.extend_days(series.pad_days(series.log_scale(frame)), 90)
    return demand.prepare(series.series_features(longer, settings), settings)


def test_parts_do_not_overlap(panel):
    ends = panel.rows.groupBy("part").agg(
        F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi"), F.count("*").alias("n")
    )
    got = {r["part"]: r for r in ends.collect()}
    assert got["train"]["hi"] < got["test"]["lo"] and got["test"]["hi"] < got["future"]["lo"]
    assert got["train"]["n"] == 2 * (520 - 90 - 90)
    assert got["test"]["n"] == got["future"]["n"] == 180


def test_feature_spec_holds_on_any_part(panel):
    from pyspark.ml.functions import vector_to_array

    widths = panel.rows.select(F.size(vector_to_array("features")).alias("w")).distinct().collect()
    assert len(widths) == 1
    ends = panel.train.select(vector_to_array("features")[0].alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert ends[0] == pytest.approx(0, abs=1e-9) and ends[1] == pytest.approx(1)


def test_tune_combine_refit_forecast(panel, quick):
    base = demand.fit_base(panel, quick)
    tuned = demand.tune(panel, quick)
    assert sorted({**base, **tuned.models}) == sorted(demand.NAMES)
    assert tuned.results.count() == 4 * quick.tune_candidates
    first = tuned.results.groupBy("model_id").agg(
        F.min("rmse").alias("least"), F.min_by("rmse", "rank").alias("first")).collect()
    assert all(r["first"] == r["least"] for r in first)

    found = demand.predict({**base, **tuned.models}, panel.test).cache()
    assert found.count() == 10 * 180 and found.filter("predicted is null").isEmpty()
    both = demand.with_ensemble(found).cache()
    ends = (
        found.filter(F.col("model_id").isin(*demand.ENSEMBLE_OF))
        .groupBy("series", "invoice_date")
        .agg(F.min("predicted").alias("lo"), F.max("predicted").alias("hi"))
    )
    outside = both.filter("model_id = 0").join(ends, ["series", "invoice_date"])
    assert outside.filter("predicted < lo - 1e-9 or predicted > hi + 1e-9").isEmpty()

    table = demand.accuracy(both).collect()
    assert len(table) == 11 and [r["rmse"] for r in table] == sorted(r["rmse"] for r in table)
    best = {r["model_desc"]: r["rsq"] for r in table}
    assert best["FOREST"] > 0.5, "a weekly pattern is easy to see"
    assert demand.accuracy(both, per_series=True).count() == 22

    future = demand.future_forecast(panel, demand.refit(panel, tuned, quick), found).cache()
    predicted = future.filter("key = 'prediction'")
    names = {r["model_desc"] for r in predicted.select("model_desc").distinct().collect()}
    assert names == {demand.ENSEMBLE, "FOREST - Tuned", "BOOST - Tuned"}
    assert predicted.count() == 3 * 180
    assert predicted.filter("not (conf_lo <= value and value <= conf_hi)").isEmpty()
    assert future.filter("key = 'actual'").count() == panel.history.count()

    scores = demand.resample_accuracy(demand.resample_predictions(panel, tuned, quick))
    rows = scores.collect()
    assert len(rows) == 10 and all(r["n"] == 2 and r["rmse_sd"] is not None for r in rows)


def test_candidates_are_seeded(quick, retail):
    makers = (
        regressors.forest_candidates, regressors.boost_candidates, regressors.spline_candidates, regressors.rules_candidates
    )
    for make in makers:
        assert make(quick) == make(quick) and len(make(quick)) == quick.tune_candidates
        texts = {regressors.describe(c) for c in make(retail)}
        assert len(texts) == retail.tune_candidates == 10
    groups = regressors.same_but(regressors.boost_candidates(retail), "maxIter")
    assert sorted(map(len, groups)) == [5, 5] and sorted(sum(groups, [])) == list(range(10))


def test_scores_after_fewer_rounds_equal_separate_fits(panel, quick):
    train, held = panel.train_cleaned.filter("fold = 0"), panel.train_cleaned.filter("fold != 0")
    group = [{"maxDepth": 3, "stepSize": 0.2, "featureSubsetStrategy": "0.5", "maxIter": n} for n in (2, 5, 3)]
    found = demand.boost_errors(train, held, group, quick)
    for candidate, error in zip(group, found, strict=True):
        alone = demand.fit_of(2, candidate, quick)(train).transform(held)
        want = alone.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
        assert error == pytest.approx(want, rel=1e-9)


def test_a_larger_forest_holds_the_smaller_one(panel, quick):
    train, held = panel.train_cleaned.filter("fold = 0"), panel.train_cleaned.filter("fold != 0")
    shape = {"featureSubsetStrategy": "0.5", "minInstancesPerNode": 5}
    small, large = demand.forest_errors(train, held, [{**shape, "numTrees": n} for n in (3, 8)], quick)
    first = demand.fit_of(1, {**shape, "numTrees": 3}, quick)(train).transform(held)
    more = demand.fit_of(1, {**shape, "numTrees": 5, "seed": quick.seed + 1}, quick)(train).transform(
        first.withColumnRenamed("prediction", "p"))
    got = more.agg(
        F.sqrt(F.avg((F.col("label") - F.col("p")) ** 2)),
        F.sqrt(F.avg((F.col("label") - (3 * F.col("p") + 5 * F.col("prediction")) / 8) ** 2))).first()
    assert [small, large] == pytest.approx(list(got))


def test_cross_validation_scores_every_fold(panel, quick):
    grids = demand.candidates(quick)
    found = demand.cross_validate(panel.train_cleaned, grids, quick)
    assert {k: len(v) for k, v in found.items()} == {k: len(g) for k, g in grids.items()}
    parts = [(panel.train_cleaned.filter(f"fold != {f}"), panel.train_cleaned.filter(f"fold = {f}")) for f in (0, 1)]
    by_fold = [demand.rules_errors(a, b, grids[4], quick) for a, b in parts]
    assert found[4] == pytest.approx([(x + y) / 2 for x, y in zip(*by_fold, strict=True)])
