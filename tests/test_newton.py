"""Nested fits against single fits, and their passes against the number of samples."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortlens.operators import model as md
from cohortlens.operators import newton
from cohortlens.plans.training import LEARNING_BUCKETS, TrainOptions, learning_curve, learning_fits

FEATURES = ["n_qleads_90d", "n_bookings_90d", "recency_last_qlead"]


def rows(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.poisson(2, n), rng.poisson(1, n), rng.integers(0, 90, n)
    p = 1 / (1 + np.exp(-(-2 + 0.5 * a - 0.3 * b + 0.01 * c)))
    y = (rng.random(n) < p).astype(int)
    data = [(f"u{i}", int(a[i]), int(b[i]), int(c[i]) if c[i] > 9 else None, int(y[i])) for i in range(n)]
    return spark.createDataFrame(data, "user_id string, n_qleads_90d long, n_bookings_90d long, recency_last_qlead int, target_30d int")


@pytest.mark.parametrize("options", [TrainOptions(), TrainOptions(penalty="elasticnet", l1_ratio=0.7, C=0.05)])
def test_each_sample_equals_its_own_fit(spark, options):
    train = rows(spark).cache()
    fits, _ = learning_fits(train, FEATURES, options)
    bucket = md.user_bucket(F.col("user_id"), md.ALL_BUCKETS)
    for share in (0.1, 0.6, 1.0):
        part = train.filter(bucket < LEARNING_BUCKETS[share])
        n, pos = part.count(), part.filter("target_30d = 1").count()
        assert fits[share].rows == n
        weight = F.when(F.col("target_30d") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
        x = md.imputed(FEATURES)
        scaled = part.select(*[(x[f] * float(k)).alias(f) for f, k in zip(FEATURES, fits[share].scale)], F.col("target_30d").cast("double").alias("y"), weight.alias("w"))
        other = LogisticRegression(
            labelCol="y", weightCol="w", standardization=False, tol=1e-10, maxIter=500, regParam=1 / (options.C * n),
            elasticNetParam=options.l1_ratio if options.penalty == "elasticnet" else 0.0,
        ).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scaled))
        assert fits[share].scaled == pytest.approx(other.coefficients.toArray(), abs=1e-4)
        assert fits[share].intercept == pytest.approx(other.intercept, abs=1e-4)
        model = md.fit_logistic(part, FEATURES, options.penalty, options.l1_ratio, options.C)
        slopes = md.loss_slopes(model, part, options.penalty, options.l1_ratio, options.C).collect()
        assert max(abs(r.slope) for r in slopes) < 1e-6
    train.unpersist()


def test_all_samples_share_their_passes(spark, monkeypatch):
    train = rows(spark, 600)
    calls = []
    original = newton._pass
    monkeypatch.setattr(newton, "_pass", lambda *a: calls.append(1) or original(*a))
    curve = {r.fraction: r for r in learning_curve(train, FEATURES).collect()}
    assert len(calls) <= 15 and list(sorted(curve)) == list(LEARNING_BUCKETS)
    sizes = [curve[s].train_rows for s in LEARNING_BUCKETS]
    assert sizes == sorted(sizes) and all(0.5 < r.roc_auc <= 1 for r in curve.values())


def test_steps_that_overshoot_are_halved(spark):
    """Separable rows with a large C: the loss must never rise, and the fit ends."""
    data = [(0, float(i % 2), 40.0 * (i % 2) + i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "group int, label double, x double")
    fit = newton.fit_nested(df, ["x"], 1, C=1e6)[0]
    assert np.isfinite(fit.intercept) and fit.coefficients[0] > 0


def test_constant_features_and_missing_classes(spark):
    df = spark.createDataFrame([(i % 2, float(i % 3 == 0), 5.0, float(i)) for i in range(40)], "group int, label double, k double, x double")
    fits = newton.fit_nested(df, ["k", "x"], 2)
    assert fits[1].rows == 40 and abs(fits[1].coefficients[0]) < 1e-6
    with pytest.raises(ValueError, match="both classes"):
        newton.fit_nested(df.withColumn("label", F.lit(1.0)), ["x"], 2)
    with pytest.raises(ValueError, match="both classes"):
        newton.fit_nested(df.limit(0), ["x"], 1)
