"""Adaptive splines: hinges and their products, chosen forward and pruned backward.

A dictionary of columns is fixed first: every plain input, hinges of the
continuous ones at quantiles, and products of two hinges. One pass sums the
products of all columns and the label, per fold. Every choice of terms, every
coefficient and every held-out error follows from these sums, so a search over
any number of candidates reads the rows once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Knots of an input's own hinges, and of those that are multiplied.
KNOTS = 10
PRODUCT_KNOTS = 3
#: Terms that the forward choice may take, the constant not counted.
FORWARD = 30
#: A column that the chosen ones explain up to this share of its own size is left alone.
TOLERANCE = 1e-7
#: Errors that differ by less than this share count as equal.
NEAR = 1e-8


@dataclass(frozen=True)
class Input:
    """A plain column, or whether a text column has one value; scaled to about 0..1."""

    name: str
    value: str | None = None
    low: float = 0.0
    size: float = 1.0

    def column(self) -> Column:
        if self.value is not None:
            return F.coalesce((F.col(self.name) == self.value).cast("double"), F.lit(0.0))
        return (F.col(self.name).cast("double") - self.low) / self.size


@dataclass(frozen=True)
class Factor:
    """An input as it is (side 0), above a knot (1) or below it (-1)."""

    place: int
    knot: float = 0.0
    side: int = 0

    def of(self, values):
        if self.side == 0:
            return values
        return np.maximum(self.side * (values - self.knot), 0.0)

    def column(self, values: Column) -> Column:
        if self.side == 0:
            return values
        return F.greatest(self.side * (values - self.knot), F.lit(0.0))


Term = tuple[Factor, ...]


@dataclass(frozen=True)
class Dictionary:
    """Inputs and the terms made of them; the constant is the term without factors."""

    inputs: tuple[Input, ...]
    terms: tuple[Term, ...]

    def matrix(self, values: np.ndarray) -> np.ndarray:
        hinges: dict[Factor, np.ndarray] = {}
        out = np.ones((len(values), len(self.terms)))
        for k, term in enumerate(self.terms):
            for factor in term:
                if factor not in hinges:
                    hinges[factor] = factor.of(values[:, factor.place])
                out[:, k] *= hinges[factor]
        return out


def dictionary(
    rows: DataFrame, plain: Sequence[str], curved: Sequence[str], nominal: dict[str, Sequence[str]],
    degree: int, knots: int = KNOTS, product_knots: int = PRODUCT_KNOTS,
) -> Dictionary:
    """Terms for these columns; curved ones get hinges at quantiles of rows, nominal ones a term per value.

    The number of terms depends on the columns and the settings, not on the rows.
    """
    names = [*curved, *plain]
    ends = rows.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(c) for c in names]).first()
    inputs = []
    for name in names:
        low, high = ends[name]
        low, high = (0.0, 1.0) if low is None else (low, high)
        inputs.append(Input(name, None, low, high - low or 1.0))
    inputs += [Input(name, value) for name, values in nominal.items() for value in values]
    every = sorted({k / (n + 1) for n in (knots, product_knots) for k in range(1, n + 1)})
    scaled = rows.select(*[i.column().alias(f"_{k}") for k, i in enumerate(inputs[: len(curved)])])
    found = scaled.approxQuantile(scaled.columns, every, 0.001) if curved else []

    def hinges(place: int, count: int) -> list[Factor]:
        at = dict(zip(every, found[place] or [0.0] * len(every), strict=True))
        distinct = dict.fromkeys(at[k / (count + 1)] for k in range(1, count + 1))
        return [Factor(place, knot, side) for knot in distinct for side in (1, -1)]

    terms: list[Term] = [()]
    terms += [(Factor(k),) for k in range(len(curved), len(inputs))]
    own = [h for place in range(len(curved)) for h in hinges(place, knots)]
    coarse = [h for place in range(len(curved)) for h in hinges(place, product_knots)]
    terms += [(h,) for h in dict.fromkeys(own + (coarse if degree > 1 else []))]
    if degree > 1:
        terms += [(a, b) for i, a in enumerate(coarse) for b in coarse[i + 1 :] if a.place != b.place]
    return Dictionary(tuple(inputs), tuple(terms))


@dataclass(frozen=True)
class Sums:
    """Products of all terms with each other and with the label, summed over rows."""

    products: np.ndarray  # the label is the last row and column

    @property
    def count(self) -> float:
        return self.products[0, 0]

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.products - other.products)

    def fit(self, chosen: Sequence[int]) -> tuple[np.ndarray, float]:
        """Coefficients of least squares, and the squared error left."""
        gram = self.products[np.ix_(chosen, chosen)]
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        solved, *_ = np.linalg.lstsq(gram / np.outer(scale, scale), self.products[chosen, -1] / scale, rcond=1e-12)
        weights = solved / scale
        return weights, self.error(chosen, weights)

    def error(self, chosen: Sequence[int], weights: np.ndarray) -> float:
        """Squared error of these coefficients, summed over the rows."""
        right = self.products[chosen, -1]
        inside = weights @ self.products[np.ix_(chosen, chosen)] @ weights
        return max(0.0, self.products[-1, -1] - 2 * weights @ right + inside)


def sums(rows: DataFrame, words: Dictionary, label: str = "label", fold: str | None = None) -> dict[int, Sums]:
    """Sums per fold (one, named 0, without folds). A partition adds its rows up before the exchange."""
    width = len(words.terms) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            values = np.stack(columns[2:], axis=1).astype(float)
            whole = np.concatenate([words.matrix(values), columns[1][:, None].astype(float)], axis=1)
            for number in np.unique(columns[0]):
                own = whole[columns[0] == number]
                totals[int(number)] = totals.get(int(number), 0.0) + own.T @ own
        for number, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * width, pa.int32()), pa.array(range(width), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(range(0, width * width + 1, width), pa.int32()), pa.array(total.ravel()))],
                ["fold", "term", "sums"])

    given = rows.select(
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold"), F.col(label).cast("double").alias("_label"),
        *[i.column().alias(f"_{k}") for k, i in enumerate(words.inputs)])
    parts = given.mapInArrow(run, "fold int, term int, sums array<double>")
    total = parts.groupBy("fold", "term").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    found: dict[int, np.ndarray] = {}
    table = total.toArrow().combine_chunks()  # a row per term and fold, however long the input is
    if table.num_rows:
        arrays = table["sums"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        for number, term, array in zip(table["fold"].to_pylist(), table["term"].to_pylist(), arrays, strict=True):
            found.setdefault(number, np.zeros((width, width)))[term] = array
    return {k: Sums(v) for k, v in found.items()}


def forward(train: Sums, words: Dictionary, degree: int, most: int = FORWARD) -> list[int]:
    """Terms in the order of their choice, the constant first: each lowers the error most.

    A product can be chosen once one of its hinges has been.
    """
    left = train.products.copy()
    size = np.diag(left).copy()
    chosen: list[int] = []
    factors: set[Factor] = set()

    def take(k: int) -> None:
        nonlocal left
        left = left - np.outer(left[:, k], left[k, :]) / left[k, k]
        chosen.append(k)
        factors.update(words.terms[k])

    if train.count <= 0:
        return chosen
    take(0)
    single = np.array([len(term) <= 1 for term in words.terms])
    for _ in range(min(most, len(words.terms) - 1)):
        allowed = single.copy()
        if degree > 1:
            allowed |= np.array([any(f in factors for f in term) for term in words.terms])
        allowed[chosen] = False
        rest = np.diag(left)[:-1]
        allowed &= rest > TOLERANCE * size[:-1]
        if not allowed.any() or left[-1, -1] <= 1e-12 * size[-1]:
            break
        gain = np.full(len(words.terms), -1.0)
        gain[allowed] = left[:-1, -1][allowed] ** 2 / rest[allowed]
        # Terms that say the same are told apart by rounding alone: the first of them counts.
        take(int(np.flatnonzero(gain >= gain.max() * (1 - NEAR))[0]))
    return chosen


def pruned(train: Sums, chosen: list[int], degree: int) -> list[tuple[float, list[int]]]:
    """Models of every size, largest first, with their generalised cross-validation score.

    Each drops the term whose loss hurts least.
    """
    penalty = 3.0 if degree > 1 else 2.0
    out, now = [], list(chosen)
    while now:
        _, error = train.fit(now)
        cost = len(now) + penalty * (len(now) - 1) / 2
        room = 1 - cost / train.count
        out.append((error / train.count / room**2 if room > 0 else np.inf, list(now)))
        if len(now) == 1:
            break
        left = [train.fit(now[:k] + now[k + 1 :])[1] for k in range(1, len(now))]
        close = min(left) + NEAR * train.products[-1, -1]
        now.pop(1 + max(k for k, e in enumerate(left) if e <= close))
    return out


def best_of(models: list[tuple[float, list[int]]], num_terms: int) -> list[int]:
    """The best score among models of at most num_terms terms, the constant counted; ties to the smaller."""
    fitting = [m for m in models if len(m[1]) <= max(1, num_terms)]
    least = min(score for score, _ in fitting)
    return min((chosen for score, chosen in fitting if score <= least * (1 + NEAR)), key=len)


class SplineModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """prediction as a sum of weighted terms, all of it column expressions."""

    terms = Param(Params._dummy(), "terms", "inputs, terms and weights as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, terms: str = "[[], [], []]") -> None:
        super().__init__()
        self._set(terms=terms)

    @staticmethod
    def of(words: Dictionary, chosen: Sequence[int], weights: np.ndarray) -> SplineModel:
        used = [words.terms[k] for k in chosen]
        inputs = [[i.name, i.value, i.low, i.size] for i in words.inputs]
        terms = [[[f.place, f.knot, f.side] for f in term] for term in used]
        return SplineModel(terms=json.dumps([inputs, terms, [float(w) for w in weights]]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        inputs, terms, weights = json.loads(self.getOrDefault(self.terms))
        total = F.lit(0.0)
        for term, weight in zip(terms, weights, strict=True):
            value = F.lit(weight)
            for place, knot, side in term:
                value = value * Factor(place, knot, side).column(Input(*inputs[place]).column())
            total = total + value
        return dataset.withColumn("prediction", total)


def fit(rows: DataFrame, words: Dictionary, degree: int, num_terms: int) -> SplineModel:
    """Terms chosen forward, pruned to num_terms at most, weights by least squares over all rows."""
    found = sums(rows, words)
    if not found:
        return SplineModel.of(words, [], np.empty(0))
    (train,) = found.values()
    chosen = best_of(pruned(train, forward(train, words, degree), degree), num_terms)
    return SplineModel.of(words, chosen, train.fit(chosen)[0])


def fold_errors(
    by_fold: dict[int, Sums], words: Dictionary, candidates: Sequence[tuple[int, int]]
) -> list[list[float]]:
    """Root mean squared error on every fold of each (degree, num_terms), fitted on the other folds."""
    whole = Sums(sum(s.products for s in by_fold.values()))
    out: list[list[float]] = [[] for _ in candidates]
    for held in by_fold.values():
        train = whole - held
        models = {d: pruned(train, forward(train, words, d), d) for d in {d for d, _ in candidates}}
        for k, (degree, num_terms) in enumerate(candidates):
            chosen = best_of(models[degree], num_terms)
            out[k].append(float(np.sqrt(held.error(chosen, train.fit(chosen)[0]) / held.count)))
    return out
