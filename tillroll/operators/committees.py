"""Committees of rules, each fitted where the one before went wrong, and a correction from near rows.

A committee's second member learns the label reflected at the first one's
prediction, the third at the second one's, and so on; the prediction is the
mean of the members. The correction moves it by how far the nearest training
rows of the same series were missed. A committee of few members is the start
of a longer one, and few neighbours are the first of many, so one fit scores
every smaller setting.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.series import DAY, SERIES

#: Rows of a series compared at once with all its training rows.
BLOCK = 512


def fit_members(make, train: DataFrame, members: int) -> list[PipelineModel]:
    """The members in turn; make() gives an unfitted pipeline from features and label to prediction."""
    fitted: list[PipelineModel] = []
    rows = train
    for _ in range(members):
        fitted.append(make().fit(rows))
        seen = fitted[-1].transform(train)
        reflected = 2 * F.col("label") - F.col("prediction")
        rows = seen.withColumn("label", reflected).select(*train.columns)
    return fitted


def with_means(rows: DataFrame, members: Sequence[PipelineModel]) -> DataFrame:
    """rows with means: the prediction of the first member, of the first two, and so on."""
    names = rows.columns
    out = rows
    for k, member in enumerate(members):
        out = member.transform(out).withColumn(f"_member{k}", F.col("prediction"))
        out = out.select(*names, *[f"_member{j}" for j in range(k + 1)])
    means, total = [], F.lit(0.0)
    for k in range(len(members)):
        total = total + F.col(f"_member{k}")
        means.append(total / (k + 1))
    return out.select(*names, F.array(*means).alias("means"))


def spans(train: DataFrame) -> list[float]:
    """How far each feature reaches in the training rows; 1 where it is constant."""
    row = train.agg(
        Summarizer.min(F.col("features")).alias("a"), Summarizer.max(F.col("features")).alias("b")).first()
    if row["a"] is None:
        return []
    return [b - a or 1.0 for a, b in zip(row["a"].toArray(), row["b"].toArray(), strict=True)]


def corrected(
    rows: DataFrame, train: DataFrame, settings: Sequence[tuple[int, int]], reach: Sequence[float]
) -> DataFrame:
    """series, invoice_date, predicted: an array with the prediction under each (members, neighbours).

    rows and train hold means. Neighbours are the training rows of the same
    series at the least sum of absolute differences of features, as shares of
    reach; ties go to the earlier day. Each says the prediction plus what it
    was itself missed by, and counts the less the farther it is. A series is
    compared in blocks; it has at most as many rows as its history has days.
    A series without training rows keeps the plain mean.
    """
    far = max((n for _, n in settings), default=0)
    size = np.array(reach)

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        return np.stack(frame["_x"].to_list()) / size

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({SERIES: [], DAY: [], "predicted": []})
        means = np.stack(left["means"].to_list())
        out = np.stack([means[:, c - 1] for c, _ in settings], axis=1)
        if len(right) and far:
            right = right.sort_values("_day", kind="stable")
            known = matrix(right)
            missed = right["_label"].to_numpy()[:, None] - np.stack(right["_means"].to_list())
            asked = matrix(left)
            for at in range(0, len(left), BLOCK):
                block = asked[at : at + BLOCK]
                apart = np.zeros((len(block), len(known)))
                for j in range(known.shape[1]):
                    apart += np.abs(block[:, j, None] - known[None, :, j])
                near = np.argsort(apart, axis=1, kind="stable")[:, :far]
                weight = 1 / (np.take_along_axis(apart, near, axis=1) + 0.5)
                for k, (c, n) in enumerate(settings):
                    if n:
                        w = weight[:, :n]
                        out[at : at + BLOCK, k] += (w * missed[near[:, :n], c - 1]).sum(axis=1) / w.sum(axis=1)
        return pd.DataFrame({SERIES: left[SERIES], DAY: left[DAY], "predicted": list(out)})

    kind = dict(rows.dtypes)
    asked = rows.select(SERIES, DAY, "means", vector_to_array("features").alias("_x"))
    seen = train.select(  # names of its own: both sides may come from one table
        F.col(SERIES).alias("_series"), F.col(DAY).alias("_day"), F.col("means").alias("_means"),
        F.col("label").alias("_label"), vector_to_array("features").alias("_x"))
    return (
        asked.groupBy(SERIES).cogroup(seen.groupBy("_series"))
        .applyInPandas(run, f"{SERIES} {kind[SERIES]}, {DAY} {kind[DAY]}, predicted array<double>")
    )


class CommitteeModel(Transformer):
    """The mean of the members, corrected by neighbours among the rows they were fitted on."""

    def __init__(self, members: list[PipelineModel], neighbours: int = 0, train: DataFrame | None = None) -> None:
        super().__init__()
        self.members, self.neighbours = members, neighbours
        self.known = with_means(train, members) if neighbours and train is not None else None
        self.reach = spans(train) if self.known is not None else []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = with_means(dataset, self.members)
        plain = out.withColumn("prediction", F.col("means")[len(self.members) - 1]).drop("means")
        if not self.neighbours or not self.reach:
            return plain
        found = corrected(out, self.known, [(len(self.members), self.neighbours)], self.reach)
        found = found.toDF("_series", "_day", "_found")
        same = F.col(SERIES).eqNullSafe(F.col("_series")) & (F.col(DAY) == F.col("_day"))
        return plain.join(found, same, "left").withColumn(
            "prediction", F.coalesce(F.col("_found")[0], F.col("prediction"))).drop("_series", "_day", "_found")
