"""Pipelines for the daily demand models. Each predicts `label` into `prediction`.

All of them expect rows prepared by `feature_spec`: a `features` vector next to
the plain feature columns.
"""

from __future__ import annotations

import math
import random

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    Interaction,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.config import Settings
from tillroll.operators import splines
from tillroll.operators.committees import CommitteeModel, fit_members
from tillroll.operators.series import DAY, SERIES, VALUE

NOMINAL = [SERIES, "month_lbl", "wday_lbl"]
NORMALISED = ["index_num", "year"]
# Fields without information on daily rows (minute, second, am_pm) and a repeat
# of day (mday) are not model inputs.
CALENDAR = [
    "half", "quarter", "month", "day", "wday", "qday", "yday",
    "mweek", "week", "week2", "week3", "week4", "mday7",
]


def lag_columns(settings: Settings) -> list[str]:
    lag = f"{VALUE}_lag{settings.horizon}"
    return [lag, *[f"{lag}_roll_{p}" for p in settings.roll_periods]]


def feature_spec(settings: Settings) -> Pipeline:
    """One-hot of every nominal column, two normalised columns, and the rest as they are."""
    waves = [f"{w}{p}_k1" for p in settings.roll_periods for w in ("sin", "cos")]
    numbers = [f"{c}_no" for c in NOMINAL]
    hot = [f"{c}_hot" for c in NOMINAL]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=NOMINAL,
                outputCols=numbers,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=numbers, outputCols=hot, dropLast=False),
            VectorAssembler(inputCols=NORMALISED, outputCol="to_normalise"),
            StandardScaler(
                inputCol="to_normalise", outputCol="normalised", withMean=True, withStd=True
            ),
            VectorAssembler(
                inputCols=["normalised", *CALENDAR, *waves, *lag_columns(settings), *hot],
                outputCol="features",
            ),
        ]
    )


def boost(settings: Settings, **params) -> GBTRegressor:
    size = {"maxIter": 15, "maxDepth": 6, "stepSize": 0.3, **params}
    return GBTRegressor(seed=settings.seed, **size)


def forest(settings: Settings, **params) -> RandomForestRegressor:
    size = {
        "numTrees": settings.forest_trees,
        "maxDepth": settings.forest_depth,
        "minInstancesPerNode": 5,
        "featureSubsetStrategy": "sqrt",
        # Rows remember their nodes, so deep levels don't walk every tree again.
        "cacheNodeIds": True,
        "seed": settings.seed,
        **params,
    }
    return RandomForestRegressor(**size)


# --- trend and seasons -----------------------------------------------------


def _day_ends(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.min(F.unix_date(DAY)).alias("a"), F.max(F.unix_date(DAY)).alias("b")).first()
    return row["a"], row["b"]


def trend_columns(
    train: DataFrame, changes: int = 25, seasons: bool = True
) -> tuple[SQLTransformer, list[str]]:
    """Straight line that may bend at evenly spaced days of the first 80 % of history.

    With seasons, waves over the week (3 orders) and the year (10 orders).
    """
    first, last = _day_ends(train)
    t = f"((unix_date({DAY}) - {first}) / {max(last - first, 1)}D)"
    columns = {"trend_t": t}
    for j in range(1, changes + 1):
        at = 0.8 * j / (changes + 1)
        columns[f"trend_{j}"] = f"greatest({t} - {at:.10f}D, 0D)"
    if seasons:
        for name, days, orders in (("weekly", 7.0, 3), ("yearly", 365.25, 10)):
            for k in range(1, orders + 1):
                angle = f"(unix_date({DAY}) * {2 * math.pi * k / days!r}D)"
                columns[f"{name}_sin{k}"] = f"sin({angle})"
                columns[f"{name}_cos{k}"] = f"cos({angle})"
    return _add_columns(columns), list(columns)


def _add_columns(columns: dict[str, str]) -> SQLTransformer:
    exprs = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def trend_model(train: DataFrame, settings: Settings) -> Pipeline:
    """Trend, seasons and the regressors in one ridge regression."""
    add, names = trend_columns(train)
    gather = VectorAssembler(inputCols=[*names, "features"], outputCol="trend_features")
    line = LinearRegression(featuresCol="trend_features", regParam=0.01, maxIter=50)
    return Pipeline(stages=[add, gather, line])


def trend_boost_model(train: DataFrame, settings: Settings) -> Pipeline:
    """Trend without seasons, then boosted trees on what it leaves."""
    add, names = trend_columns(train, seasons=False)
    gather = VectorAssembler(inputCols=names, outputCol="trend_features")
    line = LinearRegression(
        featuresCol="trend_features", predictionCol="trend", regParam=0.01, maxIter=50
    )
    left = SQLTransformer(statement="SELECT *, label - trend AS residual FROM __THIS__")
    trees = boost(settings).setLabelCol("residual").setPredictionCol("boosted")
    both = SQLTransformer(statement="SELECT *, trend + boosted AS prediction FROM __THIS__")
    return Pipeline(stages=[add, gather, line, left, trees, both])


# --- rules -----------------------------------------------------------------


def rules_model(settings: Settings, depth: int = 3) -> Pipeline:
    """A small tree whose every leaf holds its own ridge regression."""
    tree = DecisionTreeRegressor(
        maxDepth=depth,
        minInstancesPerNode=20,
        leafCol="leaf",
        predictionCol="tree_prediction",
        seed=settings.seed,
    )
    leaf = OneHotEncoder(inputCol="leaf", outputCol="leaf_hot", dropLast=False)
    cross = Interaction(inputCols=["leaf_hot", "features"], outputCol="leaf_features")
    gather = VectorAssembler(inputCols=["features", "leaf_features"], outputCol="rule_features")
    line = LinearRegression(featuresCol="rule_features", regParam=0.1, maxIter=50)
    return Pipeline(stages=[tree, leaf, cross, gather, line])


# --- splines ---------------------------------------------------------------


def spline_dictionary(train: DataFrame, settings: Settings, degree: int) -> splines.Dictionary:
    """Hinges of the time and of the lags, products of them, calendar fields and waves."""
    curved = ["index_num", "yday", *lag_columns(settings)]
    waves = [f"{w}{p}_k1" for p in settings.roll_periods for w in ("sin", "cos")]
    labels = ("month_lbl", "wday_lbl")
    found = train.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in labels]).first()  # 12 and 7 values
    plain = [c for c in ["year", *CALENDAR, *waves] if c not in curved]
    return splines.dictionary(train, plain, curved, {c: found[c] for c in labels}, degree)


def fit_splines(train: DataFrame, settings: Settings, num_terms: int = 21, prod_degree: int = 1) -> splines.SplineModel:
    return splines.fit(train, spline_dictionary(train, settings, prod_degree), prod_degree, num_terms)


# --- candidates for tuning -------------------------------------------------


Candidate = dict[str, float | int | str]


def with_params(model, candidate: Candidate):
    """The estimator with these parameters."""
    return model.copy({model.getParam(name): value for name, value in candidate.items()})


def _distinct(draw, count: int, most: int) -> list:
    """count different draws, or as many as there are."""
    found: dict = {}
    while len(found) < min(count, most):
        found[draw()] = None
    return list(found)


def _sized(settings: Settings, shape, name: str, ends: tuple[int, int], at_a_time: int) -> list[Candidate]:
    """tune_candidates candidates; some at a time differ only in the parameter name."""
    draw = random.Random(settings.seed)
    out: list[Candidate] = []
    low, high = ends
    while len(out) < settings.tune_candidates:
        same = shape(draw)
        sizes = _distinct(lambda: draw.randint(low, high), at_a_time, high - low + 1)
        out += [{**same, name: n} for n in sorted(sizes)]
    return out[: settings.tune_candidates]


def forest_candidates(settings: Settings) -> list[Candidate]:
    def shape(draw: random.Random) -> Candidate:
        return {
            "featureSubsetStrategy": str(round(draw.uniform(0.1, 1.0), 2)),
            "minInstancesPerNode": draw.randint(2, 40),
        }

    return _sized(settings, shape, "numTrees", settings.forest_tree_range, settings.forest_sizes)


def boost_candidates(settings: Settings) -> list[Candidate]:
    def shape(draw: random.Random) -> Candidate:
        return {
            "featureSubsetStrategy": str(round(draw.uniform(0.1, 1.0), 2)),
            "minInstancesPerNode": draw.randint(2, 40),
            "maxDepth": draw.randint(2, 7),
            "stepSize": round(10 ** draw.uniform(-1.5, -0.5), 4),
            "minInfoGain": 10 ** draw.uniform(-10, -2),
        }

    return _sized(settings, shape, "maxIter", settings.boost_round_range, settings.boost_sizes)


def same_but(candidates: list[Candidate], name: str) -> list[list[int]]:
    """Places of the candidates in groups that differ in one parameter only."""
    groups: dict[tuple, list[int]] = {}
    for k, candidate in enumerate(candidates):
        key = tuple(sorted((n, str(v)) for n, v in candidate.items() if n != name))
        groups.setdefault(key, []).append(k)
    return list(groups.values())


def spline_candidates(settings: Settings) -> list[Candidate]:
    draw = random.Random(settings.seed)
    (low, high), (least, most) = settings.spline_term_range, settings.spline_degree_range
    pairs = _distinct(
        lambda: (draw.randint(low, high), draw.randint(least, most)), settings.tune_candidates,
        (high - low + 1) * (most - least + 1))
    return [{"num_terms": n, "prod_degree": d} for n, d in pairs]


def rules_candidates(settings: Settings) -> list[Candidate]:
    draw = random.Random(settings.seed)
    (low, high), (least, most) = settings.committee_range, settings.neighbor_range
    pairs = _distinct(
        lambda: (draw.randint(low, high), draw.randint(least, most)), settings.tune_candidates,
        (high - low + 1) * (most - least + 1))
    return [{"committees": c, "neighbors": n} for c, n in pairs]


def fit_rules(train: DataFrame, settings: Settings, committees: int = 1, neighbors: int = 0):
    if committees == 1 and neighbors == 0:
        return rules_model(settings).fit(train)
    members = fit_members(lambda: rules_model(settings), train, committees)
    return CommitteeModel(members, neighbors, train)


def describe(candidate: Candidate) -> str:
    """Short text of a candidate's parameters."""

    def brief(value) -> str:
        return f"{value:.6g}" if isinstance(value, float) else str(value)

    return ", ".join(sorted(f"{name}={brief(v)}" for name, v in candidate.items()))
