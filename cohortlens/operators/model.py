"""Class-balanced logistic regression with imputation, scaling and calibration.

A fitted model is one ``PipelineModel`` of built-in stages, so Spark's own
persistence saves and loads it, imputation constants, feature order and calibrator
included.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import ElementwiseProduct, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.scalars import user_bucket
from cohortlens.operators.isotonic import MODEL_BLOCKS, StepMap, isotonic_blocks, step_stage
from cohortlens.operators.newton import fit_nested
from cohortlens.sources.schema import LABEL, RECENCY_FEATURES, ensure_columns
from cohortlens.sources.staging import settle

# Imputation constants, split share and iteration limit.
MISSING_RECENCY = 91
MISSING_OTHER = 0
FIT_BUCKETS = 80
ALL_BUCKETS = 100
MAX_ITER = 4000

_PREFIX = "x_"


def imputed(features: Sequence[str], missing_recency: float = MISSING_RECENCY) -> dict[str, Column]:
    """Features as doubles with constants for the missing values."""
    return {f: F.expr(_impute_sql(f, missing_recency)) for f in features}


def _impute_sql(feature: str, missing_recency: float) -> str:
    fill = missing_recency if feature in RECENCY_FEATURES else MISSING_OTHER
    return f"coalesce(cast(`{feature}` AS double), {float(fill)}D)"


def split_fit_validation(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """80/20 split by user; a user always falls on the same side."""
    bucket = user_bucket(F.col("user_id"), ALL_BUCKETS)
    return train.filter(bucket < FIT_BUCKETS), train.filter(bucket >= FIT_BUCKETS)


def balanced_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Row count and weight ``n / (2 * n_class)`` of each class."""
    counts = df.agg(
        F.count("*").alias("rows"), F.sum(F.col(label).cast("bigint")).alias("positives")
    )
    size = F.when(F.col("label") == 1, F.col("positives")).otherwise(F.col("rows") - F.col("positives"))
    return (
        counts.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
        .select("label", size.alias("n"), "rows").filter(F.col("n") > 0)
        .select("label", "n", (F.col("rows").cast("double") / (2 * F.col("n"))).alias("weight"))
    )


def _prepare(features: Sequence[str], missing_recency: float) -> list:
    """Stages that impute and assemble, in feature order."""
    columns = ", ".join(f"{_impute_sql(f, missing_recency)} AS `{_PREFIX}{f}`" for f in features)
    return [
        SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"),
        VectorAssembler(inputCols=[_PREFIX + f for f in features], outputCol="assembled"),
    ]


def fit_statistics(
    fit: DataFrame, features: Sequence[str], missing_recency: float = MISSING_RECENCY, label: str = LABEL
) -> DataFrame:
    """One row: row count ``n``, positives ``pos`` and the population deviation of each feature."""
    x = imputed(features, missing_recency)
    return fit.agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"),
        *[F.stddev_pop(x[f]).alias(f) for f in features],
    )


def fit_logistic(
    fit: DataFrame,
    features: Sequence[str],
    penalty: str = "l2",
    l1_ratio: float = 0.5,
    C: float = 1.0,
    missing_recency: float = MISSING_RECENCY,
    label: str = LABEL,
) -> PipelineModel:
    """Logistic regression on features divided by their population deviation, by Newton passes.

    The penalty weighs against the summed loss (``C``). A constant feature keeps its scale.
    """
    if penalty not in ("l2", "elasticnet"):
        raise ValueError(f"Unknown penalty: {penalty}")
    x = imputed(features, missing_recency)
    named = {f"{_PREFIX}{f}": x[f] for f in features}
    rows = fit.select(F.lit(0).alias("group"), F.col(label).cast("double").alias("label"), *[c.alias(n) for n, c in named.items()])
    ridge_share = 1.0 - (l1_ratio if penalty == "elasticnet" else 0.0)
    found = fit_nested(settle(rows), list(named), 1, ridge_share, C)[0]
    scaler = ElementwiseProduct(
        scalingVec=Vectors.dense(found.scale.tolist()), inputCol="assembled", outputCol="features"
    )
    return PipelineModel([*_prepare(features, missing_recency), scaler, _logistic(fit.sparkSession, found.scaled, found.intercept)])


def _logistic(spark: SparkSession, coefficients: Sequence[float], intercept: float) -> LogisticRegressionModel:
    """Spark's own model with given coefficients."""
    weights = _py2java(spark.sparkContext, Vectors.dense([float(c) for c in coefficients]))
    ml = spark._jvm.org.apache.spark.ml.classification
    return LogisticRegressionModel(ml.LogisticRegressionModel(f"logistic_{uuid.uuid4().hex[:12]}", weights, float(intercept)))


def fixed_model(spark: SparkSession, coefficients: dict[str, float], intercept: float, missing_recency: float = MISSING_RECENCY) -> PipelineModel:
    """A model with given coefficients on unscaled features, for scores fitted elsewhere."""
    scaler = ElementwiseProduct(
        scalingVec=Vectors.dense([1.0] * len(coefficients)), inputCol="assembled", outputCol="features"
    )
    return PipelineModel([
        *_prepare(list(coefficients), missing_recency), scaler, _logistic(spark, list(coefficients.values()), intercept)
    ])


def loss_slopes(model: PipelineModel, fit: DataFrame, penalty: str, l1_ratio: float, C: float, label: str = LABEL) -> DataFrame:
    """(feature, coef, slope): slope of the penalised weighted mean loss in each coefficient.

    The L1 part enters at its least favourable value: at the optimum every slope is zero, for a
    zero coefficient after shrinking by the L1 weight.
    """
    names = feature_names(model)
    stage = logistic_stage(model)
    weights = F.broadcast(balanced_weights(fit, label).select(F.col("label").alias("_label"), "weight"))
    rows = model.transform(fit.select(*names, F.col(label).cast("int").alias("_label")).join(weights, "_label"))
    error = F.col("weight") * (vector_to_array("probability")[1] - F.col("_label"))
    x = vector_to_array("features")
    sums = rows.agg(
        F.count("*").alias("n"), F.sum("weight").alias("total"),
        *[F.sum(error * x[i]).alias(f"s{i}") for i in range(len(names))],
    ).first()
    shrink = 1.0 / (C * sums["n"])
    l1 = shrink * (l1_ratio if penalty == "elasticnet" else 0.0)
    out = []
    for i, (name, coef) in enumerate(zip(names, stage.coefficients.toArray())):
        slope = sums[f"s{i}"] / sums["total"] + (shrink - l1) * coef
        slope = slope + l1 * np.sign(coef) if coef else np.sign(slope) * max(abs(slope) - l1, 0.0)
        out.append((name, float(coef), float(slope)))
    return fit.sparkSession.createDataFrame(out, "feature string, coef double, slope double")


def margin_of(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the model's margin before calibration."""
    names = feature_names(model)
    scored = model.transform(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *names))
    return scored.select("_row.*", vector_to_array("rawPrediction")[1].alias("margin"))


def _margins(model: PipelineModel, validation: DataFrame, label: str) -> DataFrame:
    """Distinct margins of the validation rows with row and positive counts."""
    scored = model.transform(validation)
    return scored.groupBy(vector_to_array("rawPrediction")[1].alias("margin")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos")
    )


def calibrate_isotonic(
    model: PipelineModel, validation: DataFrame, label: str = LABEL, ranges: int | None = None, model_blocks: int = MODEL_BLOCKS
) -> PipelineModel:
    """Monotone map from margin to positive share, interpolated and clipped.

    Equal margins are merged first and pooled on executors. The blocks stay a table if there
    are more than ``model_blocks``.
    """
    blocks = isotonic_blocks(_margins(model, validation, label), ranges)
    return PipelineModel([*model.stages, step_stage(blocks, "rawPrediction", "calibrated", model_blocks)])


def fit_sigmoid(points: DataFrame) -> LogisticRegressionModel:
    """Logistic map of ``margin`` to probability, fitted to smoothed targets, from rows (margin, n, pos).

    A positive counts as ``(P + 1) / (P + 2)`` and a negative as ``1 / (N + 2)``; each
    margin enters as a positive and a negative row weighted by its target mass.
    """
    points = settle(points)
    total = points.agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    pos, neg = total["pos"], total["n"] - total["pos"]
    mass = F.col("pos") * F.lit((pos + 1) / (pos + 2)) + (F.col("n") - F.col("pos")) * F.lit(1 / (neg + 2))
    rows = points.select("margin", F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), mass.alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - mass).alias("weight")),
    )))
    assembled = VectorAssembler(inputCols=["margin"], outputCol="margin_vector").transform(rows)
    return LogisticRegression(
        featuresCol="margin_vector", weightCol="weight", maxIter=MAX_ITER, standardization=False, tol=1e-10,
        predictionCol="calibrated", probabilityCol="calibrated_probability",
        rawPredictionCol="calibrated_margin",
    ).fit(assembled)


def calibrate_sigmoid(model: PipelineModel, validation: DataFrame, label: str = LABEL) -> PipelineModel:
    """Logistic map from margin to probability, fitted on the validation rows."""
    pick = VectorSlicer(inputCol="rawPrediction", outputCol="margin_vector", indices=[1])
    return PipelineModel([*model.stages, pick, fit_sigmoid(_margins(model, validation, label))])


CALIBRATORS = {
    "none": lambda model, validation, label=LABEL: model,
    "isotonic": calibrate_isotonic,
    "sigmoid": calibrate_sigmoid,
}


def logistic_stage(model: PipelineModel) -> LogisticRegressionModel:
    return next(s for s in model.stages if isinstance(s, LogisticRegressionModel))


def feature_names(model: PipelineModel) -> list[str]:
    """The feature order the model was fitted with."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.removeprefix(_PREFIX) for c in assembler.getInputCols()]


def predict(model: PipelineModel, df: DataFrame, output: str = "y_prob") -> DataFrame:
    """Add the probability of the positive class; missing features count as NULL."""
    last = model.stages[-1]
    if isinstance(last, IsotonicRegressionModel):
        probability = F.col(last.getPredictionCol())
    elif isinstance(last, StepMap):
        probability = F.col(last.getOutputCol())
    else:
        probability = vector_to_array(last.getProbabilityCol())[1]
    features = feature_names(model)
    # The row travels as one value, so that its columns cannot meet those of the stages.
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    scored = model.transform(ensure_columns(df, features).select(row, *features))
    return scored.select(*[F.col(f"_row.`{c}`") for c in df.columns], probability.alias(output))


def frozen_logit(intercept: float, coefficients: dict[str, float], missing_recency: float = MISSING_RECENCY) -> Column:
    """Probability from fixed coefficients on unscaled features, as a plain expression."""
    margin = F.lit(float(intercept))
    for feature, column in imputed(list(coefficients), missing_recency).items():
        margin = margin + F.lit(float(coefficients[feature])) * column
    return 1 / (1 + F.exp(-margin))


def coefficients(model: PipelineModel, spark) -> DataFrame:
    """Coefficient (on scaled features) and odds ratio per feature, largest first."""
    values = logistic_stage(model).coefficients.toArray()
    schema = T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("coef", T.DoubleType()),
    ])
    rows = list(zip(feature_names(model), (float(v) for v in np.asarray(values))))
    return spark.createDataFrame(rows, schema).withColumn("odds_ratio", F.exp("coef")).orderBy(F.desc("coef"))
