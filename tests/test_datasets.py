from dataclasses import replace
from datetime import date, timedelta

import pytest
from inline import at, digits, expected_dataset, integer, make_sources, random_rows, streams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import events as ev
from cohortlens.operators.features import add_km_features
from cohortlens.plans import datasets as ds
from cohortlens.plans.periods import HOLDOUT_2025, TEST_2025, TRAIN_2025, WEEK_2025, Period, Week
from cohortlens.sources.schema import DATASET_SCHEMA, WEEKLY_SCHEMA
from cohortlens.sources.tables import Rules

PERIODS = [TRAIN_2025, TEST_2025]
NAMES = {
    "n_lead": "n_qleads_90d", "n_booking": "n_bookings_90d", "n_register": "n_registers_90d",
    "n_schedule": "n_online_schedules_90d", "rec_lead": "recency_last_qlead",
    "rec_booking": "recency_last_booking", "rec_register": "recency_last_register",
    "rec_schedule": "recency_last_online_schedule", "km": "reg_km_last", "label": "target_30d",
}


def as_dict(df):
    rows = {(r["set"], r["user_id"]): {k: r[c] for k, c in NAMES.items()} for r in df.collect()}
    assert len(rows) == df.count()
    return rows


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True), (3, False)])
def test_train_test_dataset_matches_plain_loops(spark, seed, hot):
    rows = random_rows(seed, hot=hot)
    got = as_dict(ds.train_test_dataset(make_sources(spark, **rows), PERIODS))
    assert got == expected_dataset(rows, PERIODS, digits, km_in_key=False, skip_null=False)


@pytest.mark.parametrize("seed", [4, 5])
def test_holdout_dataset_matches_plain_loops(spark, seed):
    rows = random_rows(seed)
    got = as_dict(ds.holdout_dataset(make_sources(spark, **rows), HOLDOUT_2025))
    assert got == expected_dataset(rows, [HOLDOUT_2025], integer, km_in_key=True, skip_null=True)


@pytest.mark.parametrize("seed,hot", [(6, False), (7, True)])
def test_event_streams_match_plain_loops(spark, seed, hot):
    rows = random_rows(seed, hot=hot)
    src, rules = make_sources(spark, **rows), Rules()
    want = streams(rows, digits)
    key = lambda df: {tuple(r) for r in df.collect()}
    assert key(ev.sales_lead_events(src, rules)) == want["lead"]
    assert key(ev.booking_events(src, rules)) == want["booking"]
    assert key(ev.register_events(src, rules)) == want["register"]
    assert key(ev.register_km_events(src, rules)) == want["registerkm"]
    assert key(ev.online_schedule_events(src, rules)) == want["schedule"]
    deals = ev.transaction_events(src, rules, rules.sales_types).union(
        ev.transaction_events(src, rules, rules.supply_types)
    )
    assert key(deals) == want["tx"]
    assert ev.register_events(src, rules).count() == len(want["register"])


WEEK = Week(date(2025, 2, 1), date(2025, 5, 31))


def expected_weekly(rows, fanout):
    ev_ = streams(rows, lambda km: km)
    inside = lambda d, a, b: d is not None and a <= d < b
    as_of = WEEK.as_of
    cohort = {
        a for a, phone, d in rows["accounts"]
        if d is not None and phone is not None and "+52" not in phone
        and WEEK.week_start <= d.date() <= WEEK.week_end
    }
    out = {}
    for u in cohort:
        of = {k: [e for e in ev_[k] if e[0] == u] for k in ev_}
        of["register"] = of["registerkm"]
        row = {}
        for kind in ("lead", "booking", "register", "schedule"):
            days = [e[2] for e in of[kind]]
            row[f"n_{kind}"] = sum(inside(d, as_of - timedelta(90), as_of) for d in days)
            before = [d for d in days if d is not None and d < as_of]
            row[f"rec_{kind}"] = (as_of - max(before)).days if before else None
        for kind, other in (("lead", "register"), ("register", "lead")):
            times = max(1, len(of[other])) if fanout else 1
            for w in (7, 30):
                row[f"n_{kind}_{w}"] = times * sum(
                    inside(e[2], as_of - timedelta(w), as_of) for e in of[kind]
                )
        kms = [e[3] for e in of["register"] if e[3] is not None and e[2] is not None and e[2] < as_of]
        row["km"] = max(kms, default=None)
        row["label"] = int(any(inside(e[2], as_of, as_of + timedelta(30)) for e in of["tx"]))
        row["origin"] = "supply" if row["n_register"] + row["n_schedule"] >= row["n_lead"] else "sales"
        out["test", u] = row
    return out


@pytest.mark.parametrize("fanout", [True, False])
def test_weekly_dataset_matches_plain_loops(spark, fanout):
    rows = random_rows(8, users=40)
    df = ds.weekly_dataset(make_sources(spark, **rows), WEEK, km_mode="raw", fanout=fanout)
    names = {**NAMES, "n_lead_7": "n_qleads_7d", "n_lead_30": "n_qleads_30d", "n_register_7": "n_registers_7d",
             "n_register_30": "n_registers_30d", "origin": "origin_inferred"}
    got = {(r["set"], r["user_id"]): {k: r[c] for k, c in names.items()} for r in df.collect()}
    want = expected_weekly(rows, fanout)
    assert len(want) > 2
    assert got == want


def test_window_edges_and_recency(spark):
    leads = [
        ("a", "o1", at("2025-04-01"), "AR", "web"),
        ("a", "o2", at("2025-06-30", 23), "AR", "web"),
        ("a", "o3", at("2025-07-01", 0), "AR", "web"),
        ("b", "o4", at("2025-04-01", 0), "AR", "web"),
    ]
    src = make_sources(spark, leads=leads, accounts=[("a", "+54", None), ("b", "+54", None)])
    rows = {r["user_id"]: r for r in ds.train_test_dataset(src, [TEST_2025]).collect()}
    assert rows["a"]["n_qleads_90d"] == 2 and rows["a"]["recency_last_qlead"] == 1
    assert rows["b"]["recency_last_qlead"] == 91
    assert rows["a"]["n_bookings_90d"] == 0 and rows["a"]["recency_last_booking"] is None
    assert rows["a"]["reg_km_last"] is None and rows["a"]["reg_km_is_round_10"] == 0


def test_same_day_readings(spark):
    funnel = [
        ("o1", at("2025-03-01"), None, "AR", True, False, "10000"),
        ("o1", at("2025-03-01"), None, "AR", True, False, "12000"),
        ("o1", at("2025-03-02"), None, "AR", True, True, None),
    ]
    src = make_sources(spark, register_funnel=funnel, opportunities=[("o1", "a", "AR", "Compras")])
    train = ds.train_test_dataset(src, [TRAIN_2025]).first()
    assert (train["n_registers_90d"], train["reg_km_last"]) == (2, None)
    assert train["n_online_schedules_90d"] == 1  # falls back to the registration day
    later = replace(TRAIN_2025, set="holdout")
    holdout = ds.holdout_dataset(src, later).first()
    assert (holdout["n_registers_90d"], holdout["reg_km_last"]) == (3, 12000)


def test_fan_out_multiplies(spark):
    leads = [("a", f"l{i}", at("2025-05-28"), "AR", "web") for i in range(2)]
    funnel = [(f"r{i}", at("2025-05-29"), None, "AR", True, False, "1") for i in range(3)]
    src = make_sources(
        spark, leads=leads, register_funnel=funnel, accounts=[("a", "+54", at("2025-05-31"))],
        opportunities=[(f"r{i}", "a", "AR", "Compras") for i in range(3)],
    )
    counts = lambda r: (r["n_qleads_7d"], r["n_registers_7d"], r["n_qleads_30d"], r["n_registers_30d"])
    assert counts(ds.weekly_dataset(src, WEEK, fanout=True).first()) == (6, 6, 6, 6)
    assert counts(ds.weekly_dataset(src, WEEK, fanout=False).first()) == (2, 3, 2, 3)


def test_event_on_the_as_of_day_is_only_a_label(spark):
    src = make_sources(
        spark,
        leads=[("a", "o1", at("2025-05-31"), "AR", "web")],
        accounts=[("a", "+54", at("2025-05-31"))],
        opportunities=[("o1", "a", "AR", "Ventas_ARG")],
        stage_history=[("o1", at("2025-05-31"), "StageName", "Cerrada ganada")],
    )
    row = ds.weekly_dataset(src, WEEK).first()
    assert (row["n_qleads_90d"], row["recency_last_qlead"], row["target_30d"]) == (0, None, 1)
    assert row["origin_inferred"] == "supply"


def test_weekly_recency_has_no_lower_bound(spark):
    src = make_sources(
        spark,
        leads=[("a", "o1", at(str(WEEK.as_of - timedelta(400))), "AR", "web")],
        accounts=[("a", "+54", at("2025-05-31"))],
    )
    row = ds.weekly_dataset(src, WEEK).first()
    assert (row["n_qleads_90d"], row["recency_last_qlead"]) == (0, 400)


def test_schemas(spark):
    src = make_sources(spark, **random_rows(9))
    types = lambda schema: [(f.name, f.dataType) for f in schema]
    assert types(ds.train_test_dataset(src, PERIODS).schema) == types(DATASET_SCHEMA)
    assert types(ds.holdout_dataset(src, HOLDOUT_2025).schema) == types(DATASET_SCHEMA)
    weekly = ds.weekly_dataset(src, WEEK_2025)
    assert types(weekly.schema) == types(WEEKLY_SCHEMA)


def test_empty_sources(spark):
    src = make_sources(spark)
    assert ds.train_test_dataset(src, PERIODS).count() == 0
    assert ds.weekly_dataset(src, WEEK).count() == 0
    assert ds.dataset_summary(ds.holdout_dataset(src, HOLDOUT_2025)).first()["n_rows"] == 0


def test_a_set_name_may_hold_a_quote(spark):
    src = make_sources(spark, **random_rows(9))
    named = replace(TRAIN_2025, set="o'b\\")
    assert {r["set"] for r in ds.train_test_dataset(src, [named]).collect()} == {"o'b\\"}


def test_period_checks():
    day = date(2025, 1, 1)
    with pytest.raises(ValueError):
        Period("x", day, day, day, day, day)
    forward = Period.forward("x", day, date(2025, 4, 1))
    assert forward.label_start == date(2025, 4, 1) and forward.label_end_excl == date(2025, 5, 1)


@pytest.mark.parametrize("km,zeros,rounds,circular,plain", [
    (15500, 2, [0, 1, 1, 1, 1], (0.5, 0.0), (0.5, 0.0)),
    (15750, 1, [0, 0, 0, 1, 1], (0.25, 0.5), (0.75, 0.5)),
    (0, 1, [1, 1, 1, 1, 1], (0.0, 0.0), (0.0, 0.0)),
    (None, None, [0, 0, 0, 0, 0], (None, None), (None, None)),
])
def test_km_features(spark, km, zeros, rounds, circular, plain):
    df = spark.createDataFrame([(km,)], "reg_km_last long")
    for mode, want in (("circular", circular), ("plain", plain)):
        row = add_km_features(df, mode).first()
        assert row["reg_km_trailing_zeros"] == zeros
        assert [row[f"reg_km_is_round_{s}"] for s in (1000, 500, 100, 50, 10)] == rounds
        assert (row["reg_km_mod1000_norm"], row["reg_km_mod100_norm"]) == want
    if km == 15500:
        assert row["reg_km_log1p"] == pytest.approx(4.1903597, abs=1e-7)
    if km == 0:
        assert row["reg_km_log1p"] == 0.0


def test_digit_parsing(spark):
    from cohortlens.functions.km import parse_km

    df = spark.createDataFrame([("12.500 km",), ("km",), ("",), (None,), ("-5",), ("9" * 20,)], "km string")
    values = [r[0] for r in df.select(F.expr(parse_km("km", df.schema["km"].dataType))).collect()]
    assert values == [12500, None, None, None, 5, None]
    numbers = spark.createDataFrame([(-5,), (None,), (-(2**63),)], "km long")
    values = [r[0] for r in numbers.select(F.expr(parse_km("km", numbers.schema["km"].dataType))).collect()]
    assert values == [5, None, None]
    floats = spark.createDataFrame([(12000.0,), (1.5e7,), (12.5,), (None,)], "km double")
    kind = floats.schema["km"].dataType
    values = [r[0] for r in floats.select(F.expr(parse_km("km", kind))).collect()]
    assert values == [12000, 15000000, 125, None]
    values = [r[0] for r in floats.select(F.expr(parse_km("km", kind, "cast"))).collect()]
    assert values == [12000, 15000000, 13, None]


@pytest.mark.parametrize("skip_null", [False, True])
@pytest.mark.parametrize("step, length, horizon", [(1, 30, 10), (3, 40, 25), (2, 15, 90)])
def test_overlapping_periods_as_runs_give_the_rows_of_each_period_alone(spark, skip_null, step, length, horizon):
    from functools import reduce

    from cohortlens.operators import features as ft
    from cohortlens.operators.events import facts
    from cohortlens.plans.periods import feature_span, in_runs, label_span, rolling_periods

    periods = rolling_periods(date(2025, 3, 1), 24, step, length, horizon)
    assert in_runs(periods[::-1]) == periods and in_runs(periods[:2]) is None and in_runs([*periods, periods[0]]) is None
    src = make_sources(spark, **random_rows(21, hot=True))
    events = facts(src, Rules(), feature_span(periods), label_span(periods), km_in_key=True).persist()
    got = ft.period_features(events, periods[::-1], skip_null)
    want = reduce(DataFrame.unionByName, [ft.period_features(events, [p], skip_null) for p in periods])
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr) and got.count() > 100
