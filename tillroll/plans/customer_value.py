"""Customer lifetime value: features, the two models, segments and the tables shown."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.config import Settings
from tillroll.operators.customers import FEATURES
from tillroll.operators.metrics import spend_and_flag_metrics
from tillroll.operators.split import percent_bucket
from tillroll.plans.fitting import fit_all

# Default size of a boosted model.
BOOST = {"maxIter": 15, "maxDepth": 6, "stepSize": 0.3}

TABLE = [*["customer_id"], *FEATURES, "spend_90_total", "spend_90_flag"]


def training_table(features: DataFrame) -> DataFrame:
    return features.filter(F.col("split") == "train").select(*TABLE)


def testing_table(features: DataFrame) -> DataFrame:
    return features.filter(F.col("split") == "test").select(*TABLE)


def spend_model(settings: Settings) -> Pipeline:
    """Spend of the next 90 days."""
    gather = VectorAssembler(inputCols=FEATURES, outputCol="spend_features")
    boost = GBTRegressor(
        featuresCol="spend_features",
        labelCol="spend_label",
        predictionCol="pred_total",
        seed=settings.seed,
        **BOOST,
    )
    return Pipeline(stages=[gather, boost])


def probability_model(settings: Settings) -> Pipeline:
    """Probability of any purchase in the next 90 days."""
    gather = VectorAssembler(inputCols=FEATURES, outputCol="prob_features")
    boost = GBTClassifier(
        featuresCol="prob_features",
        labelCol="flag_label",
        predictionCol="pred_flag",
        seed=settings.seed,
        **BOOST,
    )
    boost.setProbabilityCol("pred_probability").setRawPredictionCol("pred_raw")
    return Pipeline(stages=[gather, boost])


def fit_models(train: DataFrame, settings: Settings) -> tuple[PipelineModel, PipelineModel]:
    """The spend model and the probability model."""
    labelled = train.withColumn("spend_label", F.col("spend_90_total").cast("double")).withColumn(
        "flag_label", F.col("spend_90_flag").cast("double")
    )
    jobs = {"spend": spend_model(settings).fit, "prob": probability_model(settings).fit}
    fitted = fit_all(jobs, labelled)
    return fitted["spend"], fitted["prob"]


def score(test: DataFrame, spend: PipelineModel, probability: PipelineModel) -> DataFrame:
    """Predictions next to the features they came from; both models keep the rows."""
    scored = probability.transform(spend.transform(test))
    return with_residual(
        scored.withColumn("pred_prob", vector_to_array("pred_probability")[1])
    )


def with_residual(scored: DataFrame) -> DataFrame:
    """Actual minus predicted spend, and recency as days since the last purchase."""
    return scored.select(
        "customer_id",
        "pred_total",
        "pred_prob",
        "spend_90_total",
        "spend_90_flag",
        F.abs("recency").alias("recency"),
        "frequency",
        "sales_sum",
        "sales_mean",
        (F.col("spend_90_total").cast("double") - F.col("pred_total")).alias(
            "spend_actual_vs_pred"
        ),
    )


def metrics(predictions: DataFrame) -> DataFrame:
    """One row: mean absolute error of spend, area under the curve of the flag."""
    return spend_and_flag_metrics(
        predictions,
        F.col("spend_90_total").cast("double"),
        F.col("pred_total"),
        "spend_90_flag",
        "pred_prob",
    )


def importance(spend: PipelineModel, probability: PipelineModel, spark) -> DataFrame:
    rows = [
        (name, feature, float(weight))
        for name, model in (("spend", spend), ("probability", probability))
        for feature, weight in zip(FEATURES, model.stages[-1].featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "model string, feature string, importance double").orderBy(
        "model", F.desc("importance")
    )


def likely_buyers(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy(F.desc("pred_prob"), "customer_id")


def recent_but_unlikely(
    predictions: DataFrame, days: int = 90, probability: float = 0.2
) -> DataFrame:
    recent = F.col("recency") < days
    return predictions.filter(recent & (F.col("pred_prob") < probability)).orderBy(
        F.desc("pred_prob"), "customer_id"
    )


def missed_opportunities(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("spend_90_total") == 0).orderBy(
        F.desc("pred_total"), "customer_id"
    )


def sample_customers(df: DataFrame, fraction: float) -> DataFrame:
    """A repeatable share of the customers: by digest, so reruns pick the same ones."""
    return df.filter(percent_bucket(F.col("customer_id")) < int(round(fraction * 100)))
