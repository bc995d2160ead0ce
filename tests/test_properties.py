"""Randomised checks against plain Python."""

import hashlib
import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.functions.scalars import top_count, user_bucket
from cohortlens.operators import ranking as rk
from cohortlens.operators.features import add_km_features

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(kms=st.lists(st.none() | st.integers(0, 10**7), min_size=1, max_size=40))
def test_km_features(spark, kms):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(kms)], "i int, reg_km_last long")
    circular = {r["i"]: r for r in add_km_features(df).collect()}
    plain = {r["i"]: r for r in add_km_features(df, "plain").collect()}
    for i, km in enumerate(kms):
        row = circular[i]
        for step in (1000, 500, 100, 50, 10):
            assert row[f"reg_km_is_round_{step}"] == int(km is not None and km % step == 0)
        if km is None:
            assert row["reg_km_log1p"] is None and row["reg_km_mod1000_norm"] is None
            continue
        text = str(km)
        assert row["reg_km_trailing_zeros"] == len(text) - len(text.rstrip("0"))
        assert math.isclose(row["reg_km_log1p"], math.log10(km + 1), abs_tol=1e-12)
        for step in (1000, 100):
            assert row[f"reg_km_mod{step}_norm"] == min(km % step, step - km % step) / step
            assert plain[i][f"reg_km_mod{step}_norm"] == (km % step) / step


@FEW
@given(users=st.lists(st.text(max_size=12), min_size=1, max_size=40, unique=True))
def test_user_bucket(spark, users):
    df = spark.createDataFrame([(u,) for u in users], "user_id string")
    for u, b in df.select("user_id", user_bucket(F.col("user_id"))).collect():
        assert b == int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % 100


@FEW
@given(pairs=st.lists(st.tuples(st.integers(1, 10**9), st.floats(0.001, 1.0)), min_size=1, max_size=40))
def test_top_count(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, share double")
    for n, share, got in df.select("n", "share", top_count(F.col("n"), F.col("share"))).collect():
        assert got == min(n, max(1, int(n * share)))


@FEW
@given(rows=st.lists(
    st.tuples(st.sampled_from(["s", None]), st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40
))
def test_metrics(spark, rows):
    scored = [(g, f"u{i}", y, p / 6) for i, (g, y, p) in enumerate(rows)]
    df = spark.createDataFrame(scored, "set string, user_id string, y_true int, y_prob double")
    results = []
    for size in (1, 2, 1_000_000):
        table = rk.score_table(df, rows_per_range=size)
        lift = rk.lift_table(table, df, rows_per_cell=size)
        frames = (table, rk.metrics(table), lift, rk.calibration_bins(table))
        results.append([sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x.collect()) for x in frames])
        for group in {g for g, _, _ in rows}:
            own = [(y, p) for g, y, p in rows if g == group]
            pos, neg = [p for y, p in own if y == 1], [p for y, p in own if y == 0]
            same = F.col("set").eqNullSafe(F.lit(group))
            got = rk.metrics(table).filter(same).first()
            if pos and neg:
                auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
                assert math.isclose(got["roc_auc"], auc, abs_tol=1e-9)
            if pos:
                precision = lambda t: sum(p >= t for p in pos) / sum(p >= t for _, p in own)
                assert math.isclose(got["pr_auc"], sum(precision(t) for t in pos) / len(pos), abs_tol=1e-9)
            assert rk.calibration_bins(table).filter(same).agg(F.sum("n")).first()[0] == len(own)
            assert tuple(lift.filter(same).agg(F.sum("n"), F.sum("positives")).first()) == (len(own), len(pos))
    assert results[0] == results[1] == results[2]


def test_interval_index_equals_the_calendar(spark, monkeypatch):
    """Windows of any lengths, overlapping, nested, apart and equal."""
    from datetime import date, timedelta

    from cohortlens.plans import periods as pd_

    rng = random.Random(9)
    day0 = date(2024, 1, 1)
    span = lambda: (day0 + timedelta(rng.randrange(300)), rng.choice([1, 1, 7, 30, 200]))
    many = []
    for i in range(60):
        (a, n), (b, k) = span(), span()
        many.append(pd_.Period(f"p{i % 50}", a + timedelta(n), a, a + timedelta(n), b, b + timedelta(k)))
    days = [(rng.randrange(9), day0 + timedelta(rng.randrange(-40, 560)), rng.random() < 0.5) for _ in range(400)] + [(1, None, True)]
    events = spark.createDataFrame(days, "user_id long, event_date date, lab boolean")
    both = []
    for most in (10**9, 0):
        monkeypatch.setattr(pd_, "CALENDAR_BROADCAST_ROWS", most)
        found = pd_.with_periods(events, many, F.col("lab"))
        both.append(sorted(map(repr, found.select("user_id", "event_date", "lab", "set", "cutoff_date", "period_end_excl").collect())))
    assert both[0] == both[1] and len(both[0]) > 1000
