import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import model as md
from cohortlens.plans.scoring import score_rows
from cohortlens.plans.training import TrainOptions, learning_curve, train_and_evaluate
from cohortlens.sources import files
from cohortlens.sources.schema import (
    COUNT_FEATURES,
    KM_FEATURES,
    LABEL,
    RECENCY_FEATURES,
    ensure_columns,
    model_features,
)

FEATURES = [*COUNT_FEATURES, *RECENCY_FEATURES, "reg_km_log1p", "reg_km_is_round_100"]


def sample(n=1500, seed=0):
    """Rows of a dataset as dicts, with missing recencies and readings."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        leads, books, regs, scheds = (int(v) for v in rng.poisson([1.0, 0.4, 0.8, 0.3]))
        rec = lambda k: int(rng.integers(1, 91)) if k else None
        km = float(rng.uniform(3, 5)) if regs and rng.random() < 0.7 else None
        z = -2.2 + 0.5 * leads + 0.9 * books + 0.3 * scheds
        rows.append({
            "set": "train" if i % 3 else "TEST", "cutoff_date": "2025-04-01", "user_id": f"u{i}",
            "n_qleads_90d": leads, "n_bookings_90d": books, "n_registers_90d": regs,
            "n_online_schedules_90d": scheds, "total_signals_90d": leads + regs,
            "recency_last_qlead": rec(leads), "recency_last_booking": rec(books),
            "recency_last_register": rec(regs), "recency_last_online_schedule": rec(scheds),
            "reg_km_log1p": km, "reg_km_is_round_100": int(rng.random() < 0.3) if km else 0,
            LABEL: int(rng.random() < 1 / (1 + np.exp(-z))),
        })
    return rows


SCHEMA = (
    "set string, cutoff_date string, user_id string, n_qleads_90d long, n_bookings_90d long, "
    "n_registers_90d long, n_online_schedules_90d long, total_signals_90d long, recency_last_qlead int, "
    "recency_last_booking int, recency_last_register int, recency_last_online_schedule int, "
    f"reg_km_log1p double, reg_km_is_round_100 int, {LABEL} int"
)


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def dataset(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).persist()


def matrix(rows):
    fill = lambda f, v: v if v is not None else (91 if f in RECENCY_FEATURES else 0)
    x = np.array([[fill(f, r[f]) for f in FEATURES] for r in rows], dtype=float)
    return x, np.array([r[LABEL] for r in rows], dtype=float)


def newton(x, y, C):
    """Balanced L2 logistic regression on features over their population deviation."""
    scale = x.std(axis=0)
    xs = np.hstack([x / np.where(scale > 0, scale, 1), np.ones((len(y), 1))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = np.eye(xs.shape[1]) / C
    ridge[-1, -1] = 0
    beta = np.zeros(xs.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xs @ beta))
        grad = xs.T @ (w * (p - y)) + ridge @ beta
        hess = (xs * (w * p * (1 - p))[:, None]).T @ xs + ridge
        beta -= np.linalg.solve(hess, grad)
    return beta, 1 / (1 + np.exp(-xs @ beta))


@pytest.mark.parametrize("C", [1.0, 0.05])
def test_l2_coefficients_match_newton(dataset, rows, C):
    model = md.fit_logistic(dataset, FEATURES, C=C)
    beta, p = newton(*matrix(rows), C)
    stage = md.logistic_stage(model)
    assert stage.coefficients.toArray() == pytest.approx(beta[:-1], abs=2e-3)
    assert stage.intercept == pytest.approx(beta[-1], abs=5e-3)
    got = {r["user_id"]: r["y_prob"] for r in md.predict(model, dataset).collect()}
    assert [got[r["user_id"]] for r in rows] == pytest.approx(p, abs=1e-3)


def test_elastic_net_reaches_a_stationary_point(dataset, rows):
    C, l1 = 0.02, 0.7
    model = md.fit_logistic(dataset, FEATURES, penalty="elasticnet", l1_ratio=l1, C=C)
    stage = md.logistic_stage(model)
    x, y = matrix(rows)
    xs = x / x.std(axis=0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = stage.coefficients.toArray()
    p = 1 / (1 + np.exp(-(xs @ beta + stage.intercept)))
    slope = C * xs.T @ (w * (p - y)) + (1 - l1) * beta
    assert (beta == 0).any() and (beta != 0).any()
    for b, s in zip(beta, slope):
        if b == 0:
            assert abs(s) <= l1 + 0.02
        else:
            assert s + l1 * np.sign(b) == pytest.approx(0, abs=0.03)


def test_constant_feature_keeps_its_scale(dataset):
    flat = dataset.withColumn("reg_km_log1p", F.lit(2.0))
    model = md.fit_logistic(flat, FEATURES)
    assert model.stages[2].getScalingVec()[FEATURES.index("reg_km_log1p")] == 1.0


def test_fit_needs_both_classes(dataset):
    with pytest.raises(ValueError, match="both classes"):
        md.fit_logistic(dataset.filter(f"{LABEL} = 0"), FEATURES)
    with pytest.raises(ValueError, match="penalty"):
        md.fit_logistic(dataset, FEATURES, penalty="l3")


def test_coefficient_names_follow_the_feature_order(spark, dataset):
    model = md.fit_logistic(dataset, FEATURES)
    assert md.feature_names(model) == FEATURES
    table = {r["feature"]: r for r in md.coefficients(model, spark).collect()}
    values = md.logistic_stage(model).coefficients.toArray()
    for f, v in zip(FEATURES, values):
        assert table[f]["coef"] == pytest.approx(v)
        assert table[f]["odds_ratio"] == pytest.approx(np.exp(v))
    assert max(table, key=lambda f: table[f]["coef"]) == "n_bookings_90d"


def pool_adjacent(margin, y):
    """Isotonic fit: block means over distinct sorted margins."""
    xs = sorted(set(margin))
    blocks = [[y[margin == x].sum(), (margin == x).sum(), [x]] for x in xs]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            s, n, x = out.pop()
            out[-1] = [out[-1][0] + s, out[-1][1] + n, out[-1][2] + x]
    points = [(x, s / n) for s, n, group in out for x in group]
    return np.array([a for a, _ in points]), np.array([b for _, b in points])


def test_isotonic_calibration_matches_pooling(dataset):
    fit, validation = md.split_fit_validation(dataset)
    base = md.fit_logistic(fit, FEATURES)
    model = md.calibrate_isotonic(base, validation)
    margin = lambda df: np.array([
        r[0][1] for r in base.transform(df).orderBy("user_id").select("rawPrediction").collect()
    ])
    y = np.array([r[0] for r in validation.orderBy("user_id").select(LABEL).collect()])
    xs, fitted = pool_adjacent(margin(validation), y)
    got = [r["y_prob"] for r in md.predict(model, dataset).orderBy("user_id").collect()]
    assert got == pytest.approx(list(np.interp(margin(dataset), xs, fitted)), abs=1e-9)
    assert 0 <= min(got) and max(got) <= 1


def test_sigmoid_calibration_minimises_smoothed_loss(dataset):
    fit, validation = md.split_fit_validation(dataset)
    base = md.fit_logistic(fit, FEATURES)
    model = md.calibrate_sigmoid(base, validation)
    m = np.array([r[0][1] for r in base.transform(validation).select("rawPrediction").collect()])
    y = np.array([r[0] for r in base.transform(validation).select(LABEL).collect()])
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = model.stages[-1].coefficients[0], model.stages[-1].intercept
    p = 1 / (1 + np.exp(-(a * m + b)))
    assert np.sum(p - t) == pytest.approx(0, abs=0.05)
    assert np.sum((p - t) * m) == pytest.approx(0, abs=0.05)
    got = [r["y_prob"] for r in md.predict(model, validation).collect()]
    assert sorted(got) == pytest.approx(sorted(p))


def test_split_is_by_user_and_about_80_20(spark):
    users = spark.range(20000).selectExpr("cast(id AS string) AS user_id")
    fit, validation = md.split_fit_validation(users)
    n_fit = fit.count()
    assert 0.78 < n_fit / 20000 < 0.82
    assert n_fit + validation.count() == 20000
    assert fit.join(validation, "user_id").count() == 0


def test_balanced_weights(dataset, rows):
    y = np.array([r[LABEL] for r in rows])
    got = {r["label"]: r["weight"] for r in md.balanced_weights(dataset).collect()}
    assert got[1] == pytest.approx(len(y) / (2 * y.sum()))
    assert got[0] == pytest.approx(len(y) / (2 * (1 - y).sum()))


@pytest.mark.parametrize("calibrate", ["none", "isotonic", "sigmoid"])
def test_save_load_and_score(spark, dataset, tmp_path, calibrate):
    fit, validation = md.split_fit_validation(dataset)
    model = md.CALIBRATORS[calibrate](md.fit_logistic(fit, FEATURES), validation)
    model.write().overwrite().save(str(tmp_path / "run" / "model"))
    again = files.load_model(str(tmp_path / "run"))
    assert md.feature_names(again) == FEATURES
    want = {r["user_id"]: r["y_prob"] for r in score_rows(model, dataset).collect()}
    got = {r["user_id"]: r["y_prob"] for r in score_rows(again, dataset).collect()}
    assert got == want and len(got) == dataset.count()


def test_scoring_fills_missing_features(dataset):
    model = md.fit_logistic(dataset, FEATURES)
    without = dataset.drop("reg_km_log1p", "recency_last_booking")
    explicit = dataset.withColumns({"reg_km_log1p": F.lit(0.0), "recency_last_booking": F.lit(91)})
    key = lambda df: {r["user_id"]: r["y_prob"] for r in score_rows(model, df).collect()}
    assert key(without) == key(explicit)
    anonymous = score_rows(model, dataset.drop("user_id"))
    assert anonymous.columns == ["user_id", "y_prob"]
    assert anonymous.select("user_id").distinct().count() == dataset.count()


def test_frozen_logit_matches_the_formula(spark, dataset, rows):
    weights = {"n_qleads_90d": 0.5, "recency_last_qlead": -0.01}
    got = {
        r["user_id"]: r["p"]
        for r in dataset.select("user_id", md.frozen_logit(-1.0, weights).alias("p")).collect()
    }
    for r in rows[:50]:
        recency = 91 if r["recency_last_qlead"] is None else r["recency_last_qlead"]
        z = -1.0 + 0.5 * r["n_qleads_90d"] - 0.01 * recency
        assert got[r["user_id"]] == pytest.approx(1 / (1 + np.exp(-z)))


def test_feature_order_and_optional_columns(dataset):
    assert model_features(dataset) == FEATURES
    assert model_features(ensure_columns(dataset, KM_FEATURES)) == [*COUNT_FEATURES, *RECENCY_FEATURES, *KM_FEATURES]


def test_train_and_evaluate_and_write(spark, dataset, rows, tmp_path):
    run = train_and_evaluate(dataset, TrainOptions(topk=0.1, calibrate="isotonic"))
    assert run.features == FEATURES
    test_rows = sum(r["set"] == "TEST" for r in rows)
    predictions = run["predictions"]
    assert predictions.columns == ["set", "cutoff_date", "user_id", "y_true", "y_prob", "y_pred_topk"]
    assert predictions.count() == test_rows
    top = run["test_thresholding"].first()
    assert predictions.agg(F.sum("y_pred_topk")).first()[0] == top["tp"] + top["fp"]
    assert top["tp"] + top["fp"] + top["fn"] + top["tn"] == test_rows
    assert run["auc_by_set"].first()["set"] == "TEST"

    folder = str(tmp_path / "out")
    files.write_run(run, folder, reports=["predictions", "threshold_sweep", "coef_importance"])
    metrics = files.read_metrics(spark, folder)
    assert metrics["features_used"] == FEATURES
    assert set(metrics["train"]) == {"roc_auc", "pr_auc", "brier", "positive_rate"}
    assert metrics["test"]["roc_auc"] > 0.6
    assert metrics["test_thresholding"]["confusion_matrix"]["tp"] == top["tp"]
    assert metrics["test_thresholding"]["topk_fraction"] == 0.1
    sweep = spark.read.csv(f"{folder}/threshold_sweep", header=True, inferSchema=True)
    assert sweep.count() == 20
    assert run["lift_table"].agg(F.sum("n")).first()[0] == test_rows
    assert run["calibration"].agg(F.sum("n")).first()[0] == test_rows
    assert run["roc_curve"].count() == run["pr_curve"].count() > 2
    assert run["rec_table"].count() == 4
    scores = score_rows(files.load_model(folder), dataset.filter("set = 'TEST'"))
    want = {r["user_id"]: r["y_prob"] for r in predictions.collect()}
    assert {r["user_id"]: r["y_prob"] for r in scores.collect()} == want


def test_learning_curve(dataset):
    curve = learning_curve(dataset.filter("set = 'train'"), FEATURES).orderBy("fraction").collect()
    assert [r["fraction"] for r in curve] == [0.1, 0.2, 0.4, 0.6, 0.8, 1.0]
    sizes = [r["train_rows"] for r in curve]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]
    fit, _ = md.split_fit_validation(dataset.filter("set = 'train'"))
    assert sizes[-1] == fit.count()
    assert all(0.4 < r["roc_auc"] <= 1 and 0 < r["pr_auc"] <= 1 for r in curve)
