"""Event streams: distinct dated facts per user, at day grain.

Two forms are offered. The ``*_events`` functions return the distinct rows
``(user_id, opportunity_id, event_date[, km])`` of one stream. ``facts`` returns all
streams in one long compact frame ``(kind, user_id, opportunity_id, event_date, n,
km)`` with one row per user, opportunity and day, which is what the feature
aggregations read.

Everything keyed by opportunity is reduced to one row per opportunity and day
before it meets the opportunity table, so an opportunity with very many raw rows
costs that join no more rows than it has days.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.km import parse_km
from cohortlens.functions.scalars import in_range
from cohortlens.operators.joins import join_salted, semi_hashed
from cohortlens.sources.tables import Rules, Sources

LEAD, BOOKING, REGISTER, SCHEDULE, TX = "lead", "booking", "register", "schedule", "tx"
SIGNALS = (LEAD, BOOKING, REGISTER, SCHEDULE)
KINDS = (*SIGNALS, TX)
NO_KM = "cast(NULL AS bigint)"

Span = tuple[date | None, date | None]
ANY_DAY: Span = (None, None)


def _day(name: str) -> str:
    return f"cast({name} AS date)"


def _rows(df: DataFrame, kind: str, conditions: list[str], columns: list[str]) -> DataFrame:
    return df.filter(" AND ".join(f"({c})" for c in conditions)).selectExpr(f"'{kind}' AS kind", *columns)


def _lead_rows(leads: DataFrame, rules: Rules, span: Span) -> DataFrame:
    day = _day("createddate")
    return _rows(
        leads, LEAD, [rules.lead, in_range(day, *span), "accountid IS NOT NULL"],
        ["accountid AS user_id", "opp_id AS opportunity_id", f"{day} AS event_date"],
    )


def _booking_rows(reservations: DataFrame, rules: Rules, span: Span) -> DataFrame:
    day = _day("paymentdate")
    return _rows(
        reservations, BOOKING,
        [rules.booking, in_range(day, *span), "account IS NOT NULL", "opportunity IS NOT NULL"],
        ["account AS user_id", "opportunity AS opportunity_id", f"{day} AS event_date"],
    )


def _km(funnel: DataFrame, km_mode: str) -> str:
    return parse_km("km", funnel.schema["km"].dataType, km_mode)


def _register_rows(funnel: DataFrame, rules: Rules, span: Span, km_mode: str) -> DataFrame:
    day = _day("fecha_registro")
    return _rows(
        funnel, REGISTER, [rules.funnel, in_range(day, *span)],
        ["opportunity_id", f"{day} AS event_date", f"{_km(funnel, km_mode)} AS km"],
    )


def _schedule_rows(funnel: DataFrame, rules: Rules, span: Span) -> DataFrame:
    day = f"coalesce({_day('fecha_inspeccion_agendada')}, {_day('fecha_registro')})"
    return _rows(
        funnel, SCHEDULE, [rules.funnel, rules.schedule, in_range(day, *span)],
        ["opportunity_id", f"{day} AS event_date"],
    )


def _funnel_rows(funnel: DataFrame, rules: Rules, span: Span, km_mode: str, readings: bool = True) -> DataFrame:
    """Register and schedule rows from a single scan of the funnel, with or without readings."""
    registered, inspected = _day("fecha_registro"), _day("fecha_inspeccion_agendada")
    # Either date may place a row inside the span; this wider test reaches the scan.
    either = f"{in_range(registered, *span)} OR {in_range(inspected, *span)}"
    rows = funnel.filter(f"({rules.funnel}) AND ({either})").selectExpr(
        "opportunity_id",
        f"{registered} AS registered",
        f"CASE WHEN {rules.schedule} THEN coalesce({inspected}, {registered}) END AS scheduled",
        f"coalesce({rules.schedule}, false) AS is_scheduled",
        f"{_km(funnel, km_mode) if readings else NO_KM} AS km",
    )
    km_type = rows.schema["km"].dataType.simpleString()
    return rows.selectExpr(
        "opportunity_id",
        "is_scheduled",
        f"""inline(array(
            named_struct('kind', '{REGISTER}', 'event_date', registered, 'km', km),
            named_struct('kind', '{SCHEDULE}', 'event_date', scheduled, 'km', cast(NULL AS {km_type}))
        ))""",
    ).filter(
        f"(kind = '{REGISTER}' OR is_scheduled) AND {in_range('event_date', *span)}"
    ).select("kind", "opportunity_id", "event_date", "km")


def _won_rows(history: DataFrame, rules: Rules, span: Span) -> DataFrame:
    day = _day("createddate")
    return _rows(
        history, TX, [rules.won, in_range(day, *span)],
        ["opportunityid AS opportunity_id", f"{day} AS event_date"],
    )


def _opportunity_rows(opportunities: DataFrame, rules: Rules) -> DataFrame:
    counts = F.expr(rules.opportunity) & F.col("recordtypename").isin(
        *rules.sales_types, *rules.supply_types
    )
    return opportunities.filter("id IS NOT NULL AND accountid IS NOT NULL").select(
        F.col("id").alias("opportunity_id"), F.col("accountid").alias("user_id"),
        F.coalesce(counts, F.lit(False)).alias("deal"),
    )


def opportunity_users(opportunities: DataFrame, rules: Rules, only_users: DataFrame | None = None) -> DataFrame:
    """Distinct ``(opportunity_id, user_id)`` with a flag for won deals that count, of ``only_users`` if given."""
    rows, key = _opportunity_rows(opportunities, rules), ["opportunity_id", "user_id"]
    if only_users is not None:
        # Dealt anew, so that adaptive execution may split a user with very many opportunities.
        rows = semi_hashed(rows, only_users, "user_id").repartition(*key)
    return rows.groupBy(*key).agg(F.bool_or("deal").alias("deal"))


def facts(
    sources: Sources,
    rules: Rules,
    feature_span: Span,
    label_span: Span,
    km_mode: str = "digits",
    km_in_key: bool = False,
    only_users: DataFrame | None = None,
    kinds: Collection[str] = KINDS,
    readings: bool = True,
) -> DataFrame:
    """Streams as ``(kind, user_id, opportunity_id, event_date, n, km)``; only the sources of ``kinds`` are read.

    ``n`` is the number of distinct events the row stands for: 1, or with
    ``km_in_key`` the number of different readings (a missing one included) of that
    day, because then each reading is an event of its own. ``km`` is the highest
    reading of the day, or NULL without ``readings``. The account rule for leads is not
    applied here; it belongs to the user and is cheaper on the aggregate (see
    ``features.keep_leads_of``).

    ``only_users`` is a frame of ``user_id``: streams of users and the opportunities'
    owners are semi-joined with it, whatever its size, and streams of opportunities with
    the opportunities that are left, all before anything is reduced or sorted.
    """
    by_user = []
    if LEAD in kinds:
        by_user.append(_lead_rows(sources.leads, rules, feature_span))
    if BOOKING in kinds:
        by_user.append(_booking_rows(sources.reservations, rules, feature_span))
    by_opp = []
    if REGISTER in kinds or SCHEDULE in kinds:
        funnel = _funnel_rows(sources.register_funnel, rules, feature_span, km_mode, readings or km_in_key)
        by_opp.append(funnel.filter(F.col("kind").isin([k for k in (REGISTER, SCHEDULE) if k in kinds])))
    km_type = by_opp[0].schema["km"].dataType.simpleString() if by_opp else "bigint"
    no_km = f"cast(NULL AS {km_type}) AS km"
    if TX in kinds:
        by_opp.append(_won_rows(sources.stage_history, rules, label_span).selectExpr("*", no_km))

    parts = []
    columns = ["kind", "user_id", "opportunity_id", "event_date", "n", "km"]
    if by_user:
        rows = reduce(DataFrame.unionByName, by_user)
        if only_users is not None:
            rows = semi_hashed(rows, only_users, "user_id")
        parts.append(rows.distinct().selectExpr(*columns[:4], "1L AS n", no_km))
    if by_opp:
        owners = opportunity_users(sources.opportunities, rules, only_users)
        rows = reduce(DataFrame.unionByName, by_opp)
        day_key = ["kind", "opportunity_id", "event_date"]
        event_key = [*day_key, "km"] if km_in_key else day_key
        if only_users is not None:
            theirs = semi_hashed(_opportunity_rows(sources.opportunities, rules), only_users, "user_id")
            # Dealt anew, so that adaptive execution may split an opportunity with very many rows.
            rows = semi_hashed(rows, theirs.select("opportunity_id"), "opportunity_id").repartition(*event_key)
            owners = owners.hint("shuffle_hash")
        n = "1L"
        if km_in_key:
            rows = rows.dropDuplicates(event_key)
            n = "count(*)"
        rows = rows.groupBy(*day_key).agg(F.expr(f"{n} AS n"), F.expr("max(km) AS km"))
        owned = rows.join(owners, "opportunity_id")
        if TX in kinds:
            owned = owned.filter(f"kind <> '{TX}' OR deal")
        parts.append(owned.select(*columns))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class FactsOptions:
    """How stored facts were built, kept with them as the column ``built``."""

    rules: Rules
    feature_span: Span
    label_span: Span
    km_mode: str = "digits"
    km_in_key: bool = False

    def column(self) -> Column:
        day = lambda d: F.lit(d).cast("date")
        return F.struct(
            F.lit(repr(self.rules)).alias("rules"), F.lit(self.km_mode).alias("km_mode"),
            F.lit(self.km_in_key).alias("km_in_key"),
            day(self.feature_span[0]).alias("feature_first"), day(self.feature_span[1]).alias("feature_end"),
            day(self.label_span[0]).alias("label_first"), day(self.label_span[1]).alias("label_end"),
        )


def facts_for(events: DataFrame, needed: FactsOptions) -> DataFrame:
    """Stored facts, after a check that they suit ``needed``: same options, and days that cover its spans.

    The check runs with the rows; the first that does not suit fails with both records.
    """
    if "built" not in events.columns:
        raise ValueError("these facts carry no record of how they were built; store them with write_facts")
    want, have = needed.column(), F.col("built")
    fits = F.lit(True)
    for name in ("rules", "km_mode", "km_in_key"):
        fits = fits & (have[name] == want[name])
    for kind in ("feature", "label"):
        first, end = f"{kind}_first", f"{kind}_end"
        fits = fits & (have[first].isNull() | F.coalesce(have[first] <= want[first], F.lit(False)))
        fits = fits & (have[end].isNull() | F.coalesce(have[end] >= want[end], F.lit(False)))
    wrong = F.raise_error(F.concat(
        F.lit("stored facts do not suit: built with "), F.to_json(have), F.lit(", needed "), F.to_json(want)
    ))
    return events.filter(F.when(fits, F.lit(True)).otherwise(wrong.cast("boolean"))).drop("built")


# -- one stream at a time ------------------------------------------------------------


def _event(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.selectExpr(
        "cast(user_id AS string) AS user_id", "cast(opportunity_id AS string) AS opportunity_id",
        "event_date", *extra,
    )


def eligible_accounts(accounts: DataFrame, rules: Rules) -> DataFrame:
    """Distinct ids of accounts that pass the account rule."""
    return accounts.filter(rules.account).select(F.col("id").alias("user_id")).distinct()


def sales_lead_events(sources: Sources, rules: Rules, span: Span = ANY_DAY) -> DataFrame:
    rows = _lead_rows(sources.leads, rules, span).drop("kind")
    kept = join_salted(
        rows.distinct(), eligible_accounts(sources.accounts, rules), "user_id",
        ["opportunity_id", "event_date"], how="left_semi", counted=rows,
    )
    return _event(kept)


def booking_events(sources: Sources, rules: Rules, span: Span = ANY_DAY) -> DataFrame:
    return _event(_booking_rows(sources.reservations, rules, span).distinct())


def _owned(rows: DataFrame, opportunities: DataFrame, *extra: str) -> DataFrame:
    owners = opportunities.filter("accountid IS NOT NULL").select(
        F.col("id").alias("opportunity_id"), F.col("accountid").alias("user_id")
    ).distinct()
    rows = rows.drop("kind")
    if not extra:  # at most a row for each day of an opportunity
        return _event(rows.distinct().join(owners, "opportunity_id"))
    owned = join_salted(rows.distinct(), owners, "opportunity_id", ["event_date", *extra], counted=rows)
    return _event(owned, *extra)


def transaction_events(
    sources: Sources, rules: Rules, record_types: tuple[str, ...], span: Span = ANY_DAY
) -> DataFrame:
    """Deals won on opportunities of the given record types."""
    deals = sources.opportunities.filter(rules.opportunity).filter(
        F.col("recordtypename").isin(list(record_types))
    )
    return _owned(_won_rows(sources.stage_history, rules, span), deals)


def register_events(sources: Sources, rules: Rules, span: Span = ANY_DAY) -> DataFrame:
    rows = _register_rows(sources.register_funnel, rules, span, "raw").drop("km")
    return _owned(rows, sources.opportunities)


def online_schedule_events(sources: Sources, rules: Rules, span: Span = ANY_DAY) -> DataFrame:
    return _owned(_schedule_rows(sources.register_funnel, rules, span), sources.opportunities)


def register_km_events(
    sources: Sources, rules: Rules, span: Span = ANY_DAY, km_mode: str = "digits"
) -> DataFrame:
    rows = _register_rows(sources.register_funnel, rules, span, km_mode)
    return _owned(rows, sources.opportunities, "km")
