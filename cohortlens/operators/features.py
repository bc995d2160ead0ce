"""Windowed counts, recencies and last readings per user, in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.km import km_columns
from cohortlens.functions.scalars import in_range
from cohortlens.operators.events import BOOKING, LEAD, REGISTER, SCHEDULE, SIGNALS, TX
from cohortlens.plans.periods import Period, Week, in_runs, of_period, run_of, with_periods

KEYS = ["set", "cutoff_date", "user_id"]

COUNT_NAMES = {
    LEAD: "n_qleads_90d",
    BOOKING: "n_bookings_90d",
    REGISTER: "n_registers_90d",
    SCHEDULE: "n_online_schedules_90d",
}
RECENCY_NAMES = {
    LEAD: "recency_last_qlead",
    BOOKING: "recency_last_booking",
    REGISTER: "recency_last_register",
    SCHEDULE: "recency_last_online_schedule",
}
TRAILING_STEMS = {LEAD: "n_qleads", REGISTER: "n_registers"}


def _total(test: str) -> str:
    return f"coalesce(sum(CASE WHEN {test} THEN n END), 0L)"


def _km_order(skip_null: bool) -> tuple[str, str]:
    """Which events count for the last reading, and what the last one has the highest value of."""
    test = f"kind = '{REGISTER}'" + (" AND km IS NOT NULL" if skip_null else "")
    day = "cast(unix_date(event_date) AS decimal(7, 0)) * 100000000000000000000BD"
    reading = "coalesce(cast(km AS decimal(20, 0)) + 9223372036854775809BD, 0BD)"
    return test, f"{day} + {reading}"


def last_km(skip_null: bool) -> str:
    """Reading of the newest register day, the highest one if the day has several.

    With ``skip_null`` rows without a reading are passed over; otherwise a newest day
    without any reading gives NULL. Day and reading are ordered as one decimal (any
    reading above none): a struct would not fit a fixed-width buffer, and Spark would
    sort all facts instead of hashing them.
    """
    test, order = _km_order(skip_null)
    return f"max_by(km, CASE WHEN {test} THEN {order} END)"


def period_features(facts: DataFrame, periods: Sequence[Period], skip_null_km: bool = False) -> DataFrame:
    """Counts, recencies, last reading and label per period and user.

    Signals count in the feature window and won deals in the label window of each
    period; the events find their periods without a shuffle, one aggregation produces all columns, and
    partial aggregation leaves each task at most one row per period and user. Users
    who only have deals are kept here with no signals. Periods that overlap much are taken
    as runs (``period_runs``).
    """
    ordered = in_runs(periods)
    if ordered is not None:
        return each_period(period_runs(facts, ordered, skip_null_km), ordered)
    dated = with_periods(facts, periods, F.col("kind") == TX)
    last = lambda k: f"max(CASE WHEN kind = '{k}' THEN event_date END)"
    aggregates = [f"{_total(f'kind = {k!r}')} AS {COUNT_NAMES[k]}" for k in SIGNALS]
    aggregates += [f"datediff(max(period_end_excl), {last(k)}) AS {RECENCY_NAMES[k]}" for k in SIGNALS]
    aggregates += [
        f"{last_km(skip_null_km)} AS reg_km_last",
        "max(CASE WHEN is_label THEN 1 ELSE 0 END) AS target_30d",
    ]
    return dated.groupBy(*KEYS).agg(*map(F.expr, aggregates))


def period_runs(facts: DataFrame, periods: Sequence[Period], skip_null_km: bool = False) -> DataFrame:
    """The features per user for runs of periods, from ``_first`` to before ``_end``, in which they stay the same.

    ``periods`` are in the order of ``in_runs``. An event enters at the first of its periods and
    leaves after the last, so it makes two rows, whatever the number of its periods; running sums
    over the entries and exits of a user, at most one row for each period, give the counts. The
    newest event that has entered leaves last. Recency columns hold the last day until
    ``each_period``.
    """
    is_tx, day = F.col("kind") == TX, F.col("event_date")
    runs = zip(
        run_of(day, [(p.label_start, p.label_end_excl) for p in periods]),
        run_of(day, [(p.period_start, p.period_end_excl) for p in periods]),
    )
    first, end = (F.when(is_tx, label).otherwise(feature) for label, feature in runs)
    edges = (
        facts.select("kind", "user_id", "event_date", "n", "km", first.alias("_enter"), end.alias("_leave"))
        .filter("_enter < _leave")
        .selectExpr("kind", "user_id", "event_date", "n", "km", """inline(array(
            named_struct('_first', _enter, '_sign', 1L), named_struct('_first', _leave, '_sign', -1L)))""")
    )
    read, order = _km_order(skip_null_km)
    order = f"CASE WHEN {read} AND _sign = 1 THEN {order} END"
    net = lambda test, n: f"coalesce(sum(CASE WHEN {test} THEN _sign * {n} END), 0L)"
    steps = [f"{net(f'kind = {k!r}', 'n')} AS {COUNT_NAMES[k]}" for k in SIGNALS]
    steps += [f"max(CASE WHEN kind = '{k}' AND _sign = 1 THEN event_date END) AS {RECENCY_NAMES[k]}" for k in SIGNALS]
    steps += [
        f"{net(read, 1)} AS _readings", f"max_by(km, {order}) AS reg_km_last", f"max({order}) AS _order",
        f"{net(f'kind = {TX!r}', 1)} AS _deals",
    ]
    per_user = Window.partitionBy("user_id").orderBy("_first")
    so_far = per_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {c: F.sum(c).over(so_far) for c in [*COUNT_NAMES.values(), "_readings", "_deals"]}
    running |= {c: F.max(c).over(so_far) for c in RECENCY_NAMES.values()}
    running |= {"reg_km_last": F.max_by("reg_km_last", "_order").over(so_far), "_end": F.lead("_first").over(per_user)}
    states = edges.groupBy("user_id", "_first").agg(*map(F.expr, steps)).select(
        "user_id", "_first", *[column.alias(name) for name, column in running.items()]
    )
    return states.filter(" OR ".join(f"{c} > 0" for c in [*COUNT_NAMES.values(), "_deals"])).select(
        "user_id", "_first", "_end", *COUNT_NAMES.values(),
        *[F.when(F.col(COUNT_NAMES[k]) > 0, F.col(RECENCY_NAMES[k])).alias(RECENCY_NAMES[k]) for k in SIGNALS],
        F.when(F.col("_readings") > 0, F.col("reg_km_last")).alias("reg_km_last"),
        F.when(F.col("_deals") > 0, 1).otherwise(0).alias("target_30d"),
    )


def each_period(runs: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """One row per period and user from the rows of ``period_runs``."""
    rows = runs.withColumn("_period", F.explode(F.sequence(F.col("_first"), F.col("_end") - 1)))
    rows = rows.withColumns(of_period(F.col("_period"), periods))
    return rows.withColumns({c: F.datediff("period_end_excl", c) for c in RECENCY_NAMES.values()}).select(
        *KEYS, *COUNT_NAMES.values(), *RECENCY_NAMES.values(), "reg_km_last", "target_30d"
    )


def kind_aggregates(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Number of events and last day per stream and user, leads only of ``accounts``."""
    per_user = facts.groupBy("kind", "user_id").agg(
        F.sum("n").alias("n_events"), F.max("event_date").alias("last_date")
    )
    known = per_user.join(accounts.selectExpr("user_id", "true AS is_known"), "user_id", "left")
    return known.filter(f"kind <> '{LEAD}' OR is_known").drop("is_known")


def last_readings(facts: DataFrame, periods: Sequence[Period], skip_null_km: bool = False) -> DataFrame:
    """The last odometer reading per period and user with registers."""
    return (
        with_periods(facts.filter(F.col("kind") == REGISTER), periods, F.lit(False))
        .groupBy(*KEYS).agg(F.expr(f"{last_km(skip_null_km)} AS reg_km_last"))
    )


def keep_leads_of(features: DataFrame, accounts: DataFrame) -> DataFrame:
    """Blank the lead columns of users that are not among ``accounts`` (``user_id``).

    Whether leads count depends on the user alone, so it is decided on one row per
    period and user rather than on every lead.
    """
    joined = features.join(accounts.selectExpr("user_id", "true AS is_known"), "user_id", "left")
    n, recency = COUNT_NAMES[LEAD], RECENCY_NAMES[LEAD]
    return joined.withColumns({
        n: F.expr(f"CASE WHEN is_known THEN {n} ELSE 0L END"),
        recency: F.expr(f"CASE WHEN is_known THEN {recency} END"),
    }).drop("is_known")


def with_signals(features: DataFrame) -> DataFrame:
    """Users with at least one signal of any kind: the universe of a period."""
    return features.filter(" OR ".join(f"{name} > 0" for name in COUNT_NAMES.values()))


def add_km_features(features: DataFrame, mode: str = "circular") -> DataFrame:
    return features.withColumns(km_columns("reg_km_last", mode))


def trailing_features(facts: DataFrame, week: Week, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Counts over trailing windows, unbounded recencies, highest reading and label.

    Feature events lie before the as-of day; recencies and the reading look back
    without limit. ``_all_*`` are the numbers of lead and register events of any day,
    which ``fan_out`` needs.
    """
    past = f"event_date < DATE'{week.as_of}'"
    since = lambda days: f"{past} AND event_date >= DATE'{week.back(days)}'"
    kind = lambda k: f"kind = '{k}'"
    aggregates = [f"{_total(f'{kind(k)} AND {since(week.lookback_days)}')} AS {COUNT_NAMES[k]}" for k in SIGNALS]
    aggregates += [
        f"datediff(DATE'{week.as_of}', max(CASE WHEN {kind(k)} AND {past} THEN event_date END)) AS {RECENCY_NAMES[k]}"
        for k in SIGNALS
    ]
    for k, stem in TRAILING_STEMS.items():
        aggregates += [f"{_total(f'{kind(k)} AND {since(d)}')} AS {stem}_{d}d" for d in windows]
        aggregates.append(f"{_total(kind(k))} AS _all_{k}")
    deal = f"{kind(TX)} AND {in_range('event_date', week.as_of, week.horizon_end)}"
    aggregates += [
        f"max(CASE WHEN {kind(REGISTER)} AND {past} THEN km END) AS reg_km_last",
        f"max(CASE WHEN {deal} THEN 1 ELSE 0 END) AS target_30d",
    ]
    return facts.groupBy("user_id").agg(*map(F.expr, aggregates))


def fan_out(features: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Multiply the trailing counts as a join of leads with registers would.

    Pairing every lead of a user with every register of that user counts each lead
    once per register and the reverse; an empty side pairs once. The product gives
    the same numbers without building the pairs.
    """
    other = {LEAD: REGISTER, REGISTER: LEAD}
    return features.withColumns({
        f"{stem}_{d}d": F.expr(f"{stem}_{d}d * greatest(1L, _all_{other[k]})")
        for k, stem in TRAILING_STEMS.items() for d in windows
    })
