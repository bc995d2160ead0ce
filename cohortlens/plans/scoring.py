"""Score new rows with a saved model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.model import predict


def score_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``(user_id, y_prob)``; rows without a user id get a generated one.

    Model features the rows lack are treated as missing values. Generated ids are
    unique but carry no order.
    """
    scored = predict(model, rows)
    if "user_id" in rows.columns:
        return scored.select(F.col("user_id").cast("string").alias("user_id"), "y_prob")
    return scored.select(F.monotonically_increasing_id().alias("user_id"), "y_prob")
