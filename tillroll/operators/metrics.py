"""How good predictions are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.ordering import running_totals


def forecast_metrics(
    pairs: DataFrame, keys: Sequence[str], series: str = "series", day: str = "invoice_date"
) -> DataFrame:
    """mae, mape, mase, smape, rmse and rsq of `predicted` against `actual` per key.

    mase divides by the mean step between neighbouring actual days; steps are
    taken within a series, never across two. mape and smape skip days where
    they would divide by 0; rsq of a constant is NaN.
    """
    actual, predicted = F.col("actual"), F.col("predicted")
    within = [*dict.fromkeys([*keys, series])]
    step = F.abs(actual - F.lag("actual").over(Window.partitionBy(*within).orderBy(day)))
    error = F.abs(actual - predicted)
    spread = F.var_pop(actual) * F.var_pop(predicted)
    level = (F.abs(actual) + F.abs(predicted)) / 2
    return (
        pairs.withColumn("_step", step)
        .groupBy(*keys)
        .agg(
            F.avg(error).alias("mae"),
            (F.avg(F.when(actual != 0, error / F.abs(actual))) * 100).alias("mape"),
            F.try_divide(F.avg(error), F.avg("_step")).alias("mase"),
            (F.avg(F.when(level != 0, error / level)) * 100).alias("smape"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.when(spread == 0, F.lit(float("nan")))
            .otherwise(F.pow(F.covar_pop(actual, predicted), 2) / spread)
            .alias("rsq"),
        )
    )


def shown(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The four metrics on show, best rmse first."""
    return metrics.select(*keys, "mae", "mase", "rmse", "rsq").orderBy("rmse", *keys)


def _by_score(scored: DataFrame, label: str, score: str, *more: Column) -> DataFrame:
    """One row per distinct score: positives, negatives."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(1 - F.col(label).cast("long")).alias("neg"),
        *more,
    )


def spend_and_flag_metrics(
    scored: DataFrame, actual: Column, predicted: Column, label: str, score: str
) -> DataFrame:
    """mae of an amount and roc_auc of a flag, in one pass over the scored rows.

    The area is the rank sum; equal scores count half.
    """
    errors = F.sum(F.abs(actual - predicted)).alias("errors")
    ranked = running_totals(_by_score(scored, label, score, errors), ["score"], ["neg"])
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return ranked.agg(
        (F.sum("errors") / F.sum(F.col("pos") + F.col("neg"))).alias("mae"),
        F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"),
    )


def roc_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Specificity and sensitivity when every score at or above the threshold counts as yes."""
    ranked = running_totals(_by_score(scored, label, score), ["score"], ["pos", "neg"])
    totals = ranked.agg(
        F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("n")
    ).scalar()
    points = ranked.withColumn("_n", totals).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("before_neg"), F.col("_n.neg")).alias("specificity"),
        F.try_divide(F.col("_n.pos") - F.col("before_pos"), F.col("_n.pos")).alias("sensitivity"),
    )
    ends = scored.sparkSession.createDataFrame(
        [(float("-inf"), 0.0, 1.0), (float("inf"), 1.0, 0.0)], points.schema
    )
    return points.unionByName(ends)
