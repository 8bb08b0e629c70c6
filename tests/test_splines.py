"""Splines and committees against plain loops on small tables."""

import itertools
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tillroll.operators import committees, regressors, splines


@pytest.fixture(scope="module")
def points(spark):
    draw = random.Random(5)
    rows = []
    for k in range(240):
        a, b, c = draw.uniform(0, 10), draw.uniform(-3, 3), draw.choice(["x", "y", None])
        y = 2 * max(a - 4, 0) + 1.5 * max(b, 0) * max(a - 4, 0) + (c == "x") + draw.gauss(0, 0.05)
        rows.append((k, a, b, 7.0, c, y, k % 3))
    schema = "k int, a double, b double, same double, c string, label double, fold int"
    return spark.createDataFrame(rows, schema).repartition(4)


def words_of(points, degree=2):
    return splines.dictionary(points, ["same"], ["a", "b"], {"c": ["x", "y"]}, degree, knots=5, product_knots=3)


def plain_matrix(points, words):
    rows = points.orderBy("k").toPandas()
    out = []
    for _, row in rows.iterrows():
        values = [
            float(row[i.name] == i.value) if i.value is not None else (row[i.name] - i.low) / i.size for i in words.inputs
        ]
        line = []
        for term in words.terms:
            product = 1.0
            for f in term:
                product *= values[f.place] if f.side == 0 else max(f.side * (values[f.place] - f.knot), 0.0)
            line.append(product)
        out.append(line)
    return np.array(out), rows["label"].to_numpy(), rows["fold"].to_numpy()


def test_sums_equal_the_products_of_a_plain_matrix(points):
    words = words_of(points)
    x, y, fold = plain_matrix(points, words)
    whole = np.column_stack([x, y])
    found = splines.sums(points, words, fold="fold")
    assert sorted(found) == [0, 1, 2]
    for f, total in found.items():
        assert np.allclose(total.products, whole[fold == f].T @ whole[fold == f])
    assert splines.sums(points.limit(0), words) == {}


def test_forward_takes_what_lowers_the_error_most(points):
    words = words_of(points)
    x, y, _ = plain_matrix(points, words)
    (total,) = splines.sums(points, words).values()
    chosen = splines.forward(total, words, 2, most=6)

    def error(columns):
        return ((y - x[:, columns] @ np.linalg.lstsq(x[:, columns], y, rcond=None)[0]) ** 2).sum()

    now = [0]
    for k in chosen[1:]:
        used = {f for j in now for f in words.terms[j]}
        allowed = [
            j for j, term in enumerate(words.terms)
            if j not in now and (len(term) <= 1 or any(f in used for f in term))
        ]
        assert error([*now, k]) == pytest.approx(min(error([*now, j]) for j in allowed), rel=1e-6, abs=1e-6)
        now.append(k)
    assert any(len(words.terms[k]) == 2 for k in chosen)


def test_pruning_drops_the_least_useful_term(points):
    words = words_of(points, 1)
    x, y, _ = plain_matrix(points, words)
    (total,) = splines.sums(points, words).values()
    models = splines.pruned(total, splines.forward(total, words, 1, most=5), 1)
    assert [len(m) for _, m in models] == list(range(len(models[0][1]), 0, -1))
    for (_, large), (score, small) in itertools.pairwise(models):
        left = {}
        for k in large[1:]:
            rest = [j for j in large if j != k]
            left[k] = ((y - x[:, rest] @ np.linalg.lstsq(x[:, rest], y, rcond=None)[0]) ** 2).sum()
        (gone,) = set(large) - set(small)
        assert left[gone] == pytest.approx(min(left.values()))
        cost = len(small) + 2 * (len(small) - 1) / 2
        assert score == pytest.approx(left[gone] / len(y) / (1 - cost / len(y)) ** 2)
    assert len(splines.best_of(models, 3)) <= 3


def test_fold_errors_equal_fits_without_the_fold(points):
    words = words_of(points)
    x, y, fold = plain_matrix(points, words)
    pairs = [(1, 4), (2, 6), (1, 4)]
    found = splines.fold_errors(splines.sums(points, words, fold="fold"), words, pairs)
    for (degree, size), errors in zip(pairs, found, strict=True):
        for f, error in enumerate(errors):
            model = splines.fit(points.filter(f"fold != {f}"), words, degree, size)
            held = model.transform(points.filter(f"fold = {f}"))
            want = held.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
            assert error == pytest.approx(want, rel=1e-5)
    assert found[0] == found[2] and max(found[1]) < min(found[0])


def test_spline_models_are_saved_and_loaded(spark, points, tmp_path):
    model = PipelineModel([splines.fit(points, words_of(points), 2, 8)])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    one, two = (m.transform(points).orderBy("k").select("prediction").toPandas() for m in (model, again))
    assert (one == two).all().all()
    assert one["prediction"].std() > 1


# --- committees


@pytest.fixture(scope="module")
def days(spark):
    draw = random.Random(7)
    rows = []
    for name in ("north", "south", None):
        for k in range(60 if name else 25):
            x = [float(draw.randrange(12)), draw.uniform(0, 50), 1.0]
            y = (x[0] > 5) * 3 + x[1] / 25 + draw.gauss(0, 0.3)
            rows.append((name, date(2020, 1, 1) + timedelta(days=k), *x, y, int(k % 4 == 0)))
    rows.append(("new", date(2020, 2, 2), 1.0, 2.0, 1.0, 1.0, 1))
    plain = spark.createDataFrame(rows, "series string, invoice_date date, a double, b double, c double, label double, held int")
    gather = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    return gather.transform(plain).select("series", "invoice_date", "features", "label", "held")


def test_one_member_without_neighbours_is_the_plain_model(days, quick):
    train, held = days.filter("held = 0"), days.filter("held = 1")
    plain = regressors.rules_model(quick).fit(train).transform(held)
    for model in (regressors.fit_rules(train, quick), committees.CommitteeModel(
            committees.fit_members(lambda: regressors.rules_model(quick), train, 1), 0, train)):
        found = model.transform(held)
        assert sorted(r["prediction"] for r in found.collect()) == pytest.approx(
            sorted(r["prediction"] for r in plain.collect()))


def test_members_learn_the_reflected_label(days, quick):
    train = days.filter("held = 0").cache()
    members = committees.fit_members(lambda: regressors.rules_model(quick), train, 3)
    rows = train
    for member in members:
        alone = regressors.rules_model(quick).fit(rows)
        one, two = (m.transform(train).orderBy("series", "invoice_date").select("prediction").toPandas()
                    for m in (member, alone))
        assert np.allclose(one, two)
        seen = member.transform(train).withColumn("label", 2 * F.col("label") - F.col("prediction"))
        rows = seen.select(*train.columns)
    means = committees.with_means(train, members).orderBy("series", "invoice_date").toPandas()["means"]
    each = [m.transform(train).orderBy("series", "invoice_date").toPandas()["prediction"] for m in members]
    for k, got in enumerate(means):
        values = [e[k] for e in each]
        assert got == pytest.approx([np.mean(values[: j + 1]) for j in range(3)])


def test_neighbours_correct_by_what_they_were_missed_by(days, quick):
    train, held = days.filter("held = 0"), days.filter("held = 1")
    members = committees.fit_members(lambda: regressors.rules_model(quick), train, 2)
    pairs = [(1, 0), (2, 0), (1, 1), (2, 4), (2, 100)]
    known, asked = (committees.with_means(d, members) for d in (train, held))
    reach = committees.spans(train)
    found = {(r["series"], r["invoice_date"]): r["predicted"]
             for r in committees.corrected(asked, known, pairs, reach).collect()}
    own: dict = {}
    for r in known.orderBy("invoice_date").collect():
        own.setdefault(r["series"], []).append(r)
    rows = asked.collect()
    assert len(found) == len(rows)
    for r in rows:
        near = sorted(
            (sum(abs(a - b) / s for a, b, s in zip(r["features"], t["features"], reach, strict=True)), k)
            for k, t in enumerate(own.get(r["series"], [])))
        for (c, n), got in zip(pairs, found[r["series"], r["invoice_date"]], strict=True):
            want = r["means"][c - 1]
            if n and near:
                weights = [1 / (d + 0.5) for d, _ in near[:n]]
                missed = [own[r["series"]][k]["label"] - own[r["series"]][k]["means"][c - 1] for _, k in near[:n]]
                want += sum(w * m for w, m in zip(weights, missed, strict=True)) / sum(weights)
            assert got == pytest.approx(want)
    model = committees.CommitteeModel(members, 4, train).transform(held)
    got = {(r["series"], r["invoice_date"]): r["prediction"] for r in model.collect()}
    assert got == pytest.approx({k: v[3] for k, v in found.items()})
