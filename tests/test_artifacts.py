"""Saved sets: whole or not there, tied to what they were made from, equal when read again."""

import shutil

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import SMALL
from tillroll.plans import artifacts, modelled


@pytest.fixture
def line(spark):
    rows = spark.range(30).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("label"))
    gathered = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    return LinearRegression().fit(gathered), gathered


def test_a_set_that_is_not_whole_is_not_there(spark, line, tmp_path, monkeypatch):
    model, rows = line
    folder = str(tmp_path / "set")
    assert artifacts.manifest(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        artifacts.load_table(spark, folder, "rows")

    def fails(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as patch:
        patch.setattr(artifacts, "_write_text", fails)
        with pytest.raises(OSError):
            artifacts.save(folder, {"line": model}, {"rows": rows.select("x")}, "one")
    assert artifacts.manifest(spark, folder) is None

    artifacts.save(folder, {"line": model}, {"rows": rows.select("x")}, "one")
    with monkeypatch.context() as patch:
        patch.setattr(artifacts, "_write_text", fails)
        with pytest.raises(OSError):
            artifacts.save(folder, {"line": model}, {"rows": rows.select("x").limit(1)}, "two")
    assert artifacts.manifest(spark, folder)["made_from"] == "one"
    assert artifacts.load_table(spark, folder, "rows").count() == 30


def test_a_set_is_made_once_for_what_it_depends_on(spark, line, tmp_path):
    model, rows = line
    folder, made = str(tmp_path / "set"), []

    def make():
        made.append(1)
        return {"line": model}, {"rows": rows.select("x", "label")}

    for made_from in ("a", "a", "b", "b"):
        models, tables = artifacts.saved(spark, folder, made_from, make)
        assert models["line"].transform(rows).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0] < 1e-6
        assert tables["rows"].count() == 30
    assert len(made) == 2
    sets = [p.name for p in (tmp_path / "set").iterdir() if p.name.startswith("set-")]
    assert sets == [artifacts.manifest(spark, folder)["set"]]


def test_customer_value_is_reused_by_a_later_session(spark, tmp_path, monkeypatch):
    source, folder = str(tmp_path / "tables"), str(tmp_path / "saved")
    shutil.copytree(SMALL, source)
    modelled.save_customer_value(spark, source, folder)
    before = modelled.clv_predictions(spark, source).collect()
    artifacts.forget()  # as in another session
    monkeypatch.setattr(modelled.customer_value, "fit_models", None)  # fitting again would fail
    models, tables = modelled.saved_customer_value(spark, source, folder)
    assert sorted(tables) == [
        "clv_importance", "clv_metrics", "clv_predictions", "clv_testing_table", "clv_training_table"]
    assert all(t.count() for t in tables.values())
    assert sorted(map(repr, tables["clv_predictions"].collect())) == sorted(map(repr, before))
    test = modelled.customer_value.testing_table(modelled.features(spark, source))
    again = modelled.plain(modelled.customer_value.score(test, models["spend"], models["probability"]))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, before))

    changed = spark.read.parquet(f"{source}/orders.parquet").limit(100)
    changed.coalesce(1).write.parquet(str(tmp_path / "orders"))
    (tmp_path / "tables" / "orders.parquet").chmod(0o644)
    (tmp_path / "tables" / "orders.parquet").write_bytes(
        next((tmp_path / "orders").glob("part-*.parquet")).read_bytes())
    held = artifacts.manifest(spark, folder)["made_from"]
    assert artifacts.fingerprint(spark, source, modelled.S) != held
