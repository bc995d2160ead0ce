"""The three datasets: train/test periods, holdout period, week of new accounts."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import inferred_origin
from cohortlens.operators import features as ft
from cohortlens.operators.cohorts import new_accounts
from cohortlens.operators.events import KINDS, SIGNALS, FactsOptions, eligible_accounts, facts, facts_for
from cohortlens.operators.joins import semi_hashed
from cohortlens.plans.periods import Period, Week, feature_span, in_runs, label_span
from cohortlens.sources.schema import DATASET_COLUMNS, WEEKLY_COLUMNS
from cohortlens.sources.tables import Rules, Sources


def signal_features(
    sources: Sources,
    periods: Sequence[Period],
    rules: Rules = Rules(),
    km_mode: str = "digits",
    km_in_key: bool = False,
    skip_null_km: bool = False,
    events: DataFrame | None = None,
    kinds: Collection[str] = KINDS,
    readings: bool = True,
) -> DataFrame:
    """Counts, recencies, last reading and label of every user with a signal in a period.

    ``events`` are stored facts to read instead of the sources; facts that do not cover
    the windows or were built with other rules or odometer options fail. Only the sources
    of ``kinds`` are read: without deals the label is 0, without ``readings`` the last
    reading is NULL.
    """
    spans = feature_span(periods), label_span(periods)
    if events is None:
        events = facts(
            sources, rules, *spans, km_mode=km_mode, km_in_key=km_in_key, kinds=kinds, readings=readings
        )
    else:
        events = facts_for(events, FactsOptions(rules, *spans, km_mode, km_in_key))
    accounts, ordered = eligible_accounts(sources.accounts, rules), in_runs(periods)
    if ordered is not None:  # the accounts meet a user's runs, not each of the periods
        runs = ft.keep_leads_of(ft.period_runs(events, ordered, skip_null_km), accounts)
        return ft.each_period(ft.with_signals(runs), ordered)
    features = ft.period_features(events, periods, skip_null_km)
    return ft.with_signals(ft.keep_leads_of(features, accounts))


def universe_by_signal(
    sources: Sources, periods: Sequence[Period], rules: Rules = Rules()
) -> DataFrame:
    """Distinct ``(set, cutoff_date, user_id)`` with a signal in the feature window."""
    return signal_features(sources, periods, rules, kinds=SIGNALS, readings=False).select(*ft.KEYS)


def complete(features: DataFrame, mod_mode: str) -> DataFrame:
    """Add the derived columns and put the dataset columns in order."""
    return ft.add_km_features(features, mod_mode).withColumns({
        "user_id": F.col("user_id").cast("string"),
        "total_signals_90d": F.col("n_qleads_90d") + F.col("n_registers_90d"),
    }).select(*DATASET_COLUMNS)


def train_test_dataset(
    sources: Sources,
    periods: Sequence[Period],
    rules: Rules = Rules(),
    events: DataFrame | None = None,
) -> DataFrame:
    """One row per period and user with a signal in that period."""
    return complete(signal_features(sources, periods, rules, events=events), "circular")


# How the holdout reads odometers: cast instead of stripped, each reading an event of
# its own, missing readings passed over when looking for the last.
HOLDOUT_KM = {"km_mode": "cast", "km_in_key": True, "skip_null_km": True}


def holdout_dataset(
    sources: Sources,
    period: Period,
    rules: Rules = Rules(),
    mod_mode: str = "plain",
    events: DataFrame | None = None,
) -> DataFrame:
    """The dataset of a later period.

    The modulo features are plain unless ``mod_mode`` says otherwise; a model fitted on
    the train dataset expects ``circular``.
    """
    return complete(signal_features(sources, [period], rules, **HOLDOUT_KM, events=events), mod_mode)


def weekly_features(
    sources: Sources,
    week: Week,
    rules: Rules = Rules(),
    km_mode: str = "cast",
    fanout: bool = False,
    events: DataFrame | None = None,
) -> DataFrame:
    """The accounts of the week with their trailing counts, recencies and label.

    Events are semi-joined with the cohort, whatever its size, by its ids in hash tables
    (``semi_hashed``). ``events`` are stored facts of all days (``fanout``) or of the days before
    the horizon, with readings in the key.
    """
    # A shuffle of its own, which the planner keeps and reuses: the cohort is computed once for its joins.
    cohort = new_accounts(sources.accounts, rules, week).hint("rebalance", "user_id")
    users = cohort.select("user_id")
    spans = (None, None) if fanout else (None, week.as_of), (week.as_of, week.horizon_end)
    # Every cohort account passes the account rule, so its leads all count.
    if events is None:
        events = facts(sources, rules, *spans, km_mode=km_mode, km_in_key=True, only_users=users)
    else:
        events = semi_hashed(facts_for(events, FactsOptions(rules, *spans, km_mode, True)), users, "user_id")
    features = ft.trailing_features(events, week)
    if fanout:
        features = ft.fan_out(features)
    zero = F.lit(0).cast("bigint")
    counts = [c for c in WEEKLY_COLUMNS if c.startswith("n_")]
    return cohort.join(features, "user_id", "left").withColumns({
        **{c: F.coalesce(F.col(c), zero) for c in counts},
        "target_30d": F.coalesce("target_30d", F.lit(0)),
    })


def weekly_dataset(
    sources: Sources,
    week: Week,
    rules: Rules = Rules(),
    km_mode: str = "cast",
    fanout: bool = False,
    events: DataFrame | None = None,
) -> DataFrame:
    """One row per account created in the week, with a forward label.

    Each event counts once; ``fanout`` keeps the 7- and 30-day counts as produced by
    joining leads and registers before counting. ``cast`` and ``digits`` give the highest
    number as last reading; ``raw`` keeps the type of the readings, so that text is
    compared as text.
    """
    features = weekly_features(sources, week, rules, km_mode, fanout, events)
    return features.withColumns({
        "user_id": F.col("user_id").cast("string"),
        "total_signals_90d": F.col("n_qleads_90d") + F.col("n_registers_90d"),
        "origin_inferred": inferred_origin(
            F.col("n_qleads_90d"), F.col("n_registers_90d"), F.col("n_online_schedules_90d")
        ),
    }).select(*WEEKLY_COLUMNS)


def dataset_summary(dataset: DataFrame) -> DataFrame:
    """Rows, positives and positive rate of a dataset."""
    return dataset.agg(
        F.count("*").alias("n_rows"),
        F.sum("target_30d").alias("positives"),
        F.avg(F.col("target_30d").cast("double")).alias("positive_rate"),
    )
