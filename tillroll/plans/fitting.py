"""Work on models submitted side by side."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession

PER_CORE = 3
MOST = 32

Fit = Callable[[DataFrame], Transformer]


def side_by_side(spark: SparkSession, jobs: dict[Hashable, Callable[[], Any]]) -> dict[Hashable, Any]:
    """The results of jobs, PER_CORE at once for each core of the session, MOST at most.

    Each one submits distributed jobs of its own; on few rows most of their time is
    scheduling, which only other jobs can fill.
    """
    at_once = min(max(4, PER_CORE * spark.sparkContext.defaultParallelism), MOST, max(1, len(jobs)))
    with ThreadPoolExecutor(at_once) as pool:
        started = {k: pool.submit(inheritable_thread_target(spark)(job)) for k, job in jobs.items()}
        return {k: f.result() for k, f in started.items()}


def fit_all(jobs: dict[Hashable, Fit], train: DataFrame) -> dict[Hashable, Transformer]:
    """Each fit on train, which is cached meanwhile."""
    train = train.persist()
    try:
        return side_by_side(train.sparkSession, {k: lambda fit=fit: fit(train) for k, fit in jobs.items()})
    finally:
        train.unpersist()
