import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ranking as rk

SCHEMA = "set string, user_id string, y_true int, y_prob double"


def make_rows(seed, n, levels=None, hot=None, sets=("train", "test")):
    rng = random.Random(seed)
    rows = []
    for s in sets:
        for i in range(n):
            p = rng.random() if levels is None else rng.randrange(levels) / levels
            if hot is not None and rng.random() < 0.35:
                p = hot
            rows.append((s, f"u{i}", int(rng.random() < 0.2 + 0.5 * p), p))
    return rows


def arrays(rows, which):
    part = [r for r in rows if r[0] == which]
    return np.array([r[2] for r in part]), np.array([r[3] for r in part]), [r[1] for r in part]


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def brute_ap(y, p):
    total, last, out = y.sum(), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / total
        out += (recall - last) * y[hit].mean()
        last = recall
    return out


CASES = [
    (make_rows(1, 60, levels=7), 1_000_000),
    (make_rows(2, 80), 1_000_000),
    (make_rows(3, 80, hot=0.5), 10),  # many score ranges
    (make_rows(4, 90, levels=30, hot=0.9), 5),
]


@pytest.mark.parametrize("rows,rows_per_range", CASES)
def test_metrics_match_brute_force(spark, rows, rows_per_range):
    df = spark.createDataFrame(rows, SCHEMA)
    table = rk.score_table(df, rows_per_range=rows_per_range)
    got = {r["set"]: r for r in rk.metrics(table).collect()}
    for which in ("train", "test"):
        y, p, _ = arrays(rows, which)
        row = got[which]
        assert row["n_rows"] == len(y) and row["positives"] == y.sum()
        assert row["roc_auc"] == pytest.approx(brute_auc(y, p))
        assert row["pr_auc"] == pytest.approx(brute_ap(y, p))
        assert row["brier"] == pytest.approx(np.mean((p - y) ** 2))
        assert row["positive_rate"] == pytest.approx(y.mean())


@pytest.mark.parametrize("rows,rows_per_range", CASES)
def test_running_counts(spark, rows, rows_per_range):
    table = rk.score_table(spark.createDataFrame(rows, SCHEMA), rows_per_range=rows_per_range)
    for r in table.collect():
        y, p, _ = arrays(rows, r["set"])
        at = p >= r["score"]
        assert (r["cum_n"], r["cum_pos"]) == (at.sum(), y[at].sum())
        assert (r["total_n"], r["total_pos"]) == (len(y), y.sum())


def test_many_ranges_are_used(spark):
    df = spark.createDataFrame(CASES[2][0], SCHEMA)
    plan = rk.score_table(df, rows_per_range=10)._jdf.queryExecution().toString()
    assert "_range" in plan


@pytest.mark.parametrize("rows,rows_per_range", CASES)
def test_threshold_sweep_matches_selection(spark, rows, rows_per_range):
    table = rk.score_table(spark.createDataFrame(rows, SCHEMA), rows_per_range=rows_per_range)
    sweep = rk.threshold_sweep(table).collect()
    assert len(sweep) == 40
    for r in sweep:
        y, p, _ = arrays(rows, r["set"])
        n_top = max(1, int(len(p) * r["k_frac"]))
        thr = np.sort(p)[-n_top]
        flag = p >= thr
        assert r["threshold"] == thr
        want = (y[flag].sum(), (~y.astype(bool))[flag].sum(), y[~flag].sum(), (1 - y)[~flag].sum())
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == tuple(int(v) for v in want)
        assert r["precision"] == pytest.approx(y[flag].mean())
        assert r["recall"] == pytest.approx(y[flag].sum() / y.sum())
    recalls = [r["recall"] for r in sorted(sweep, key=lambda r: r["k_pct"]) if r["set"] == "test"]
    assert recalls == sorted(recalls)
    kept = rk.recommendations(rk.threshold_sweep(table)).select("k_pct").distinct().collect()
    assert sorted(r[0] for r in kept) == [2, 5, 10, 15]


def test_top_k_ties_and_minimum(spark):
    rows = [("test", str(i), 0, p) for i, p in enumerate([0.9, 0.5, 0.5, 0.5, 0.1])]
    df = spark.createDataFrame(rows, SCHEMA)
    table = rk.score_table(df)
    top = rk.top_k_report(table, 0.4).first()
    assert top["threshold"] == 0.5 and top["tp"] + top["fp"] == 4 and top["recall"] is None
    assert rk.flag_top(df, top["threshold"]).agg(F.sum("y_pred_topk")).first()[0] == 4
    assert rk.top_k_report(table, 0.01).first()["threshold"] == 0.9
    assert rk.top_k_report(table, 1.0).first()["threshold"] == 0.1


def test_known_auc_and_ap_with_ties(spark):
    rows = [("test", "a", 1, 0.8), ("test", "b", 1, 0.5), ("test", "c", 0, 0.5), ("test", "d", 0, 0.2)]
    got = rk.metrics(rk.score_table(spark.createDataFrame(rows, SCHEMA))).first()
    assert got["roc_auc"] == pytest.approx(0.875)
    assert got["pr_auc"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_one_class_group_has_no_auc(spark):
    rows = [("test", "a", 0, 0.8), ("test", "b", 0, 0.5)]
    got = rk.metrics(rk.score_table(spark.createDataFrame(rows, SCHEMA))).first()
    assert got["roc_auc"] is None and got["pr_auc"] is None


def brute_lift(y, p, users, q=10):
    md5 = [hashlib.md5(u.encode()).hexdigest() for u in users]
    order = sorted(range(len(y)), key=lambda i: (-p[i], md5[i], users[i]))
    dec = np.minimum(np.floor(np.arange(len(y)) / (len(y) / q)).astype(int) + 1, q)
    out = {}
    for d in set(dec):
        rows = [order[i] for i in range(len(y)) if dec[i] == d]
        out[int(d)] = (len(rows), int(y[rows].sum()), p[rows].mean(), y[rows].mean() / y.mean())
    return out


@pytest.mark.parametrize("rows,rows_per_range", CASES)
@pytest.mark.parametrize("q", [10, 7])
def test_lift_matches_brute_force(spark, rows, rows_per_range, q):
    df = spark.createDataFrame(rows, SCHEMA)
    got = rk.lift_table(rk.score_table(df, rows_per_range=rows_per_range), df, q=q).collect()
    for which in ("train", "test"):
        y, p, users = arrays(rows, which)
        want = brute_lift(y, p, users, q)
        mine = {r["decile"]: r for r in got if r["set"] == which}
        assert set(mine) == set(want)
        assert sum(r["n"] for r in mine.values()) == len(y)
        for d, (n, pos, mean_p, lift) in want.items():
            assert (mine[d]["n"], mine[d]["positives"]) == (n, pos)
            assert mine[d]["mean_p"] == pytest.approx(mean_p)
            assert mine[d]["lift"] == pytest.approx(lift)


def test_lift_bin_sizes(spark):
    rows = [("test", str(i), i % 2, i / 25) for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["decile"]: r["n"] for r in rk.lift_table(rk.score_table(df), df).collect()}
    assert [got[d] for d in range(1, 11)] == [3, 2, 3, 2, 3, 2, 3, 2, 3, 2]


def test_lift_reads_rows_only_for_scores_across_borders(spark):
    """Distinct scores are counted from the score table alone, and nothing stays cached."""
    rows = [("test", str(i), i % 2, i / 25) for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = rk.score_table(df)
    unread = df.withColumn("user_id", F.raise_error(F.lit("read")).cast("string"))
    assert rk.lift_table(table, unread).agg(F.sum("n")).first()[0] == 25
    table.unpersist()
    tied = spark.createDataFrame([("test", str(i), i % 2, 0.5) for i in range(20)], SCHEMA)
    table = rk.score_table(tied)
    cached = spark._jsc.sc().getPersistentRDDs().size()
    assert rk.lift_table(table, tied).count() == 10
    assert spark._jsc.sc().getPersistentRDDs().size() == cached


@pytest.mark.parametrize("rows,rows_per_range", CASES)
def test_calibration_bins_match_numpy(spark, rows, rows_per_range):
    table = rk.score_table(spark.createDataFrame(rows, SCHEMA), rows_per_range=rows_per_range)
    got = rk.calibration_bins(table).collect()
    for which in ("train", "test"):
        y, p, _ = arrays(rows, which)
        cuts = np.percentile(p, np.linspace(0, 1, 11) * 100)[1:-1]
        bins = np.searchsorted(cuts, p)
        mine = {r["bin"]: r for r in got if r["set"] == which}
        assert set(mine) == set(bins)
        for b in set(bins):
            assert mine[b]["n"] == (bins == b).sum()
            assert mine[b]["positive_fraction"] == pytest.approx(y[bins == b].mean())
            assert mine[b]["mean_predicted"] == pytest.approx(p[bins == b].mean())


def test_curves(spark):
    rows = make_rows(5, 50, levels=9)
    table = rk.score_table(spark.createDataFrame(rows, SCHEMA))
    roc, pr = rk.roc_points(table).collect(), rk.pr_points(table).collect()
    for which in ("train", "test"):
        y, p, _ = arrays(rows, which)
        points = sorted((r["fpr"], r["tpr"]) for r in roc if r["set"] == which)
        assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
        assert len(points) == len(set(p)) + 1
        fpr, tpr = zip(*points)
        assert np.trapezoid(tpr, fpr) == pytest.approx(brute_auc(y, p))
        mine = {r["threshold"]: r for r in pr if r["set"] == which}
        assert (mine[None]["recall"], mine[None]["precision"]) == (0.0, 1.0)
        for t in set(p):
            assert mine[t]["precision"] == pytest.approx(y[p >= t].mean())
            assert mine[t]["recall"] == pytest.approx(y[p >= t].sum() / y.sum())
            assert mine[t]["baseline"] == pytest.approx(y.mean())


def test_recorded_run_arithmetic(spark):
    """Counts of a published run: flagged ties, precision, recall and positive rate agree."""
    tn, fp, fn, tp = 180572, 23071, 471, 4190
    rows = [("test", 1, 0.04, tp), ("test", 0, 0.04, fp), ("test", 1, 0.01, fn), ("test", 0, 0.01, tn)]
    counted = spark.createDataFrame(rows, "set string, y_true int, y_prob double, times int")
    scored = counted.select("set", "y_true", "y_prob", F.explode(F.sequence(F.lit(1), "times")).alias("i"))
    table = rk.score_table(scored)
    top = rk.top_k_report(table, 0.1).first()
    assert (top["tn"], top["fp"], top["fn"], top["tp"]) == (tn, fp, fn, tp)
    assert top["precision"] == pytest.approx(0.15369942408569018)
    assert top["recall"] == pytest.approx(0.8989487234499035)
    assert rk.metrics(table).first()["positive_rate"] == pytest.approx(0.022375950533835166)


@pytest.mark.parametrize("bad", [None, float("nan")])
@pytest.mark.parametrize("rows_per_range", [1, 1_000_000])
def test_missing_scores_are_refused(spark, bad, rows_per_range):
    rows = [("test", "a", 1, 0.8), ("test", "b", 0, bad), ("test", "c", 0, 0.5)]
    with pytest.raises(Exception, match="NULL or NaN"):
        rk.score_table(spark.createDataFrame(rows, SCHEMA), rows_per_range=rows_per_range)


def test_null_group_keeps_its_rows(spark):
    rows = [(s, f"u{i}", i % 2, 0.5) for s in ("test", None) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (1, 1_000_000):
        table = rk.score_table(df, rows_per_range=size)
        assert {r["set"]: r["n_rows"] for r in rk.metrics(table).collect()} == {"test": 10, None: 10}
        lift = rk.lift_table(table, df, rows_per_cell=size).groupBy("set").agg(F.sum("n").alias("n")).collect()
        assert {r["set"]: r["n"] for r in lift} == {"test": 10, None: 10}
