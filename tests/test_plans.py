"""Shape of the physical plans: what is pushed down, shuffled, sorted and broadcast."""

from contextlib import contextmanager
from dataclasses import replace
from datetime import date

import pytest
from inline import make_sources, random_rows
from pyspark.sql import functions as F

from checks import mapping as m
from cohortlens.operators import ranking as rk
from cohortlens.plans import datasets as ds
from cohortlens.plans.periods import TRAIN_2025, rolling_periods

SF = "/root/testdata/sf0.001"


@contextmanager
def cluster_like(spark):
    """Plans as with large inputs: no automatic broadcast."""
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "10000"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def period_plan(spark):
    with cluster_like(spark):
        return plan(ds.train_test_dataset(m.sources(spark, SF), m.PERIODS, m.RULES))


def test_no_nested_loops_or_sorted_aggregation(spark, period_plan):
    for word in ("NestedLoop", "CartesianProduct", "SortAggregate", "ObjectHashAggregate", "Window"):
        assert word not in period_plan


def test_only_the_calendar_is_broadcast(spark, period_plan):
    assert period_plan.count("BroadcastExchange") == 1


def test_many_periods_neither_shuffle_nor_join_on_the_day(spark):
    with cluster_like(spark):
        many = rolling_periods(date(1993, 1, 1), 5000, 7, 28, 28)
        text = plan(ds.train_test_dataset(m.sources(spark, SF), many, m.RULES))
    assert "hashpartitioning(event_date" not in text and "Join [event_date" not in text
    assert text.count("BroadcastExchange") == 0


def test_events_of_overlapping_periods_are_not_multiplied_before_they_are_shuffled(spark):
    with cluster_like(spark):
        text = plan(ds.signal_features(m.sources(spark, SF), m.ROLLING, m.RULES))
    # a plan is printed from its result down: the periods of a run come last, after all joins and sums
    assert text.count("explode(") == 1
    assert text.index("explode(") < min(text.index(word) for word in ("Exchange", "Join", "Aggregate"))


def test_number_of_scans_and_shuffles(spark, period_plan):
    # Leads, bookings, funnel, deals, opportunities, accounts: one scan each.
    assert period_plan.count("FileScan") == 6
    # Two for the events, three for the opportunity join, one aggregation, two for accounts.
    assert period_plan.count("Exchange hashpartitioning") <= 8


def test_dates_and_rules_reach_the_scan(period_plan):
    scans = [line for line in period_plan.splitlines() if "FileScan" in line]
    pushed = [s[s.index("PushedFilters"):s.index("ReadSchema")] for s in scans]
    assert sum("GreaterThanOrEqual(o_orderdate,1998-01-01" in p for p in pushed) == 2
    assert any("EqualTo(l_returnflag,R)" in p and "LessThan(l_shipdate,1998-07-01" in p for p in pushed)
    assert any("Not(StringContains(c_name,99))" in p for p in pushed)
    assert not any("o_totalprice" in s for s in scans)


def test_either_funnel_date_reaches_the_scan(spark, tmp_path):
    src = make_sources(spark, **random_rows(14))
    src.register_funnel.write.parquet(str(tmp_path / "funnel"))
    stored = replace(src, register_funnel=spark.read.parquet(str(tmp_path / "funnel")))
    with cluster_like(spark):
        text = plan(ds.train_test_dataset(stored, [TRAIN_2025]))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    pushed = scan[scan.index("PushedFilters"):]
    assert "Or(And(GreaterThanOrEqual(fecha_registro,2025-01-01" in pushed
    assert "GreaterThanOrEqual(fecha_inspeccion_agendada,2025-01-01" in pushed


def test_unused_columns_are_not_computed(spark):
    with cluster_like(spark):
        text = plan(ds.signal_features(m.sources(spark, SF), m.PERIODS, m.RULES).select("user_id", "n_qleads_90d"))
    assert "max_by" not in text and "recency" not in text


def jobs_of(spark, build):
    """The result of ``build`` and the number of jobs it has started."""
    group = f"plan-{id(build)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


@pytest.mark.parametrize("threshold", ["-1", "100m"])
@pytest.mark.parametrize("options", [{}, {"fanout": True}, {"km_mode": "raw"}])
def test_weekly_events_are_semi_joined_and_no_job_runs_before(spark, threshold, options):
    with cluster_like(spark):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        src = m.sources_with_creation(spark, SF)
        df, jobs = jobs_of(spark, lambda: ds.weekly_dataset(src, m.WEEK, m.RULES, **options))
        text = plan(df)
    assert jobs == 0
    # leads with bookings, and the owners of the opportunities
    assert text.count("LeftSemi") >= 2 and "NestedLoop" not in text and "SortAggregate" not in text
    assert df.schema["reg_km_last"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("fanout", [True, False])
def test_weekly_rows_of_others_go_before_they_are_sorted_or_reduced(spark, fanout):
    with cluster_like(spark):
        lines = plan(ds.weekly_features(m.sources_with_creation(spark, SF), m.WEEK, m.RULES, fanout=fanout)).splitlines()
    semi = [i for i, line in enumerate(lines) if "LeftSemi" in line]
    assert semi and all("ShuffledHashJoin" in lines[i] for i in semi)
    # leads, bookings, funnel, deals, and the opportunities for owners and for either stream of theirs
    assert len(semi) == 7
    for i in semi:  # a plan is printed from its result down, the left side of a join first
        scan = next(k for k, line in enumerate(lines) if k > i and "FileScan" in line)
        assert not any(word in line for line in lines[i:scan] for word in ("Sort", "Aggregate"))


def test_an_opportunity_with_most_rows_is_split_where_it_meets_the_cohort(spark):
    week, hot = m.WEEK, 200_000
    days = f"timestamp_ntz'{week.as_of}' - make_interval(0, 0, 0, 1 + cast(id % 60 AS int))"
    funnel = spark.range(hot + 1000).selectExpr(
        f"if(id < {hot}, 7, id) AS opportunity_id", f"{days} AS fecha_registro", "cast(NULL AS timestamp_ntz) AS fecha_inspeccion_agendada",
        "'N' AS country_iso", "true AS flag_register", "false AS flag_online_schedule", "id AS km",
    )
    src = m.sources_with_creation(spark, SF)
    accounts = spark.range(1, 3).selectExpr(
        "id", "'1' AS personmobilephone", "'X' AS segment",
        f"timestamp_ntz'{week.week_start}' - make_interval(cast(id - 1 AS int)) AS createddate",
    )
    opportunities = spark.sql("SELECT 7L AS id, 1L AS accountid, 'x' AS recordtypename UNION ALL SELECT id, 2L, 'x' FROM range(1000, 3000)")
    src = replace(src, register_funnel=funnel, accounts=accounts, opportunities=opportunities)
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        with cluster_like(spark):
            df = ds.weekly_features(src, week, m.RULES, km_mode="raw", fanout=True)
            rows = df.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r["user_id"], r["n_registers_90d"], r["reg_km_last"]) for r in rows] == [(1, hot, hot - 1)]
    final = plan(df).split("== Initial Plan ==")[0]
    assert any("LeftSemi" in line and "skew=true" in line for line in final.splitlines())
    # the cohort is computed once for all its joins
    shuffles = [line for line in final.splitlines() if "REBALANCE_PARTITIONS_BY_COL" in line]
    assert sum("ReusedExchange" not in line for line in shuffles) == 1, shuffles


def test_only_the_asked_for_streams_are_read(spark):
    src = m.sources(spark, SF)
    with cluster_like(spark):
        universe = plan(ds.universe_by_signal(src, m.PERIODS, m.RULES))
        supply = plan(ds.signal_features(src, m.PERIODS, m.RULES, kinds=("register", "schedule")))
    assert universe.count("FileScan") == 5 and "l_extendedprice" not in universe
    assert supply.count("FileScan") == 3 and "l_extendedprice" in supply  # funnel, opportunities, accounts


def test_ranking_sorts_only_inside_groups(spark):
    scored = spark.range(100).selectExpr(
        "'test' AS set", "cast(id AS string) AS user_id", "cast(id % 3 = 0 AS int) AS y_true", "id / 100.0D AS y_prob"
    )
    table = rk.score_table(scored, rows_per_range=10)
    for df in (rk.metrics(table), rk.threshold_sweep(table), rk.lift_table(table, scored), rk.calibration_bins(table)):
        text = plan(df)
        assert "SinglePartition" not in text and "CartesianProduct" not in text
        assert "rangepartitioning" not in text


def test_hot_user_leaves_one_row_per_task(spark):
    """A user with a third of the events reaches the final aggregation pre-aggregated."""
    from cohortlens.operators.features import period_features

    facts = spark.range(0, 3000, 1, 4).selectExpr(
        "'lead' AS kind", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id) END AS user_id",
        "cast(id AS string) AS opportunity_id", "DATE'1998-02-01' AS event_date", "1L AS n", "cast(NULL AS bigint) AS km",
    )
    features = period_features(facts, m.PERIODS)
    assert "partial_sum" in plan(features)
    assert features.filter("user_id = 'hot'").select(F.sum("n_qleads_90d")).first()[0] == 1000
