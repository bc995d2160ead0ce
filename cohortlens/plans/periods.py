"""Feature and label windows."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALENDAR_BROADCAST_ROWS = 200_000
#: Windows that hold a day, on average, from which periods count as runs.
OVERLAP = 4


@dataclass(frozen=True)
class Period:
    """A cohort period: half-open feature and label windows and the as-of day."""

    set: str
    cutoff_date: date
    period_start: date
    period_end_excl: date
    label_start: date
    label_end_excl: date

    def __post_init__(self) -> None:
        if self.period_start >= self.period_end_excl or self.label_start >= self.label_end_excl:
            raise ValueError(f"Empty feature or label window in period {self.set!r}")

    @classmethod
    def forward(cls, set: str, start: date, end_excl: date, horizon_days: int = 30) -> "Period":
        """A period whose label window starts where the features end."""
        return cls(set, end_excl, start, end_excl, end_excl, end_excl + timedelta(days=horizon_days))


# The train, test and holdout windows.
TRAIN_2025 = Period(
    "train", date(2025, 4, 1), date(2025, 1, 1), date(2025, 4, 1), date(2025, 1, 1), date(2025, 7, 1)
)
TEST_2025 = Period(
    "test", date(2025, 7, 1), date(2025, 4, 1), date(2025, 7, 1), date(2025, 4, 1), date(2025, 7, 1)
)
HOLDOUT_2025 = Period(
    "holdout", date(2025, 10, 1), date(2025, 7, 1), date(2025, 10, 1), date(2025, 7, 1), date(2025, 10, 1)
)


@dataclass(frozen=True)
class Week:
    """A closed week of new accounts, seen as of its last day."""

    week_start: date
    week_end: date
    set: str = "test"
    lookback_days: int = 90
    horizon_days: int = 30

    @property
    def as_of(self) -> date:
        return self.week_end

    @property
    def horizon_end(self) -> date:
        return self.week_end + timedelta(days=self.horizon_days)

    def back(self, days: int) -> date:
        return self.week_end - timedelta(days=days)


# Fixed value: the week of the recorded run.
WEEK_2025 = Week(date(2025, 10, 8), date(2025, 10, 14))


def feature_span(periods: Sequence[Period]) -> tuple[date, date]:
    return min(p.period_start for p in periods), max(p.period_end_excl for p in periods)


def label_span(periods: Sequence[Period]) -> tuple[date, date]:
    return min(p.label_start for p in periods), max(p.label_end_excl for p in periods)


def period_frame(spark: SparkSession, periods: Sequence[Period]) -> DataFrame:
    """The periods as rows."""
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(
        f"""named_struct('set', {text(p.set)}, 'cutoff_date', DATE'{p.cutoff_date}',
            'period_start', DATE'{p.period_start}', 'period_end_excl', DATE'{p.period_end_excl}',
            'label_start', DATE'{p.label_start}', 'label_end_excl', DATE'{p.label_end_excl}')"""
        for p in periods
    )
    return spark.range(0, 1, 1, 1).selectExpr(f"inline(array({rows}))")


def rolling_periods(first: date, count: int, step_days: int, length_days: int, horizon_days: int, name: str = "rolling") -> list[Period]:
    """``count`` periods of equal length, each ``step_days`` after the one before, named by their first day."""
    starts = [first + timedelta(days=i * step_days) for i in range(count)]
    return [Period.forward(f"{name} {s}", s, s + timedelta(days=length_days), horizon_days) for s in starts]


def calendar_days(periods: Sequence[Period]) -> int:
    return sum((p.period_end_excl - p.period_start).days + (p.label_end_excl - p.label_start).days for p in periods)


def calendar(spark: SparkSession, periods: Sequence[Period]) -> DataFrame:
    """One row per day that a period uses, for features and for labels."""
    keys = ["set", "cutoff_date", "period_end_excl"]
    return period_frame(spark, periods).selectExpr(*keys, """inline(array(
        named_struct('is_label', false, 'first', period_start, 'last', date_sub(period_end_excl, 1)),
        named_struct('is_label', true, 'first', label_start, 'last', date_sub(label_end_excl, 1))
    ))""").selectExpr(*keys, "is_label", "explode(sequence(first, last)) AS event_date")


def _constant(values: Sequence, kind: str) -> Column:
    """A list as one literal; a tree with an expression for each entry would slow the planner."""
    return F.from_json(F.lit(json.dumps(values, default=str)), kind)


def windows_of(day: Column, windows: Sequence[tuple[date, date]]) -> Column:
    """The numbers of the half-open windows that hold ``day``, from an index in the expression itself.

    Days are cut into blocks as wide as the median window. A block lists the windows that touch
    it, so a day looks at those of its block alone, whatever the number of windows.
    """
    origin = min(s for s, _ in windows)
    width = int(median((e - s).days for s, e in windows))
    blocks: list[list[int]] = [[] for _ in range((max(e for _, e in windows) - origin).days // width + 1)]
    for i, (start, end) in enumerate(windows):
        for b in range((start - origin).days // width, ((end - origin).days - 1) // width + 1):
            blocks[b].append(i)
    offset = F.datediff(day, F.lit(origin))
    near = F.get(_constant(blocks, "array<array<int>>"), F.floor(offset / width).cast("int"))
    starts, ends = (_constant([w[k] for w in windows], "array<date>") for k in (0, 1))
    return F.filter(near, lambda i: (F.get(starts, i) <= day) & (day < F.get(ends, i)))


def with_periods(events: DataFrame, periods: Sequence[Period], is_label: Column) -> DataFrame:
    """A row for each event and period whose feature window, or label window where ``is_label``, holds its day.

    Adds set, cutoff_date, period_end_excl and is_label. Up to ``CALENDAR_BROADCAST_ROWS`` days in all
    windows, the range test becomes an equality with a broadcast calendar; beyond, each event finds its
    periods in an interval index. Neither shuffles the events.
    """
    marked = events.withColumn("is_label", is_label)
    if calendar_days(periods) <= CALENDAR_BROADCAST_ROWS:
        return marked.join(F.broadcast(calendar(events.sparkSession, periods)), ["event_date", "is_label"])
    day = F.col("event_date")
    found = F.when(F.col("is_label"), windows_of(day, [(p.label_start, p.label_end_excl) for p in periods])).otherwise(
        windows_of(day, [(p.period_start, p.period_end_excl) for p in periods])
    )
    return marked.withColumn("_period", F.explode(found)).withColumns(of_period(F.col("_period"), periods)).drop("_period")


def in_runs(periods: Sequence[Period]) -> list[Period] | None:
    """The periods in an order in which every day lies in consecutive ones, if they overlap much and have one.

    That is where no window begins or ends before that of an earlier period, and each set and cutoff
    day belongs to one period.
    """
    bounds = lambda p: (p.period_start, p.period_end_excl, p.label_start, p.label_end_excl)
    ordered = sorted(periods, key=bounds)
    days = sum((end - first).days for first, end in (feature_span(periods), label_span(periods)))
    if calendar_days(periods) < OVERLAP * days or len({(p.set, p.cutoff_date) for p in periods}) < len(periods):
        return None
    steps = zip(map(bounds, ordered), map(bounds, ordered[1:]))
    return ordered if all(x <= y for a, b in steps for x, y in zip(a, b)) else None


def run_of(day: Column, windows: Sequence[tuple[date, date]]) -> tuple[Column, Column]:
    """First and end of the run of ``windows``, in the order of ``in_runs``, that hold ``day``; the same or NULL where none does."""
    starts, ends = [w[0] for w in windows], [w[1] for w in windows]
    days = [starts[0] + timedelta(days=i) for i in range((ends[-1] - starts[0]).days)]
    offset = F.datediff(day, F.lit(starts[0]))
    return tuple(F.get(_constant([bisect_right(b, d) for d in days], "array<int>"), offset) for b in (ends, starts))


def of_period(number: Column, periods: Sequence[Period]) -> dict[str, Column]:
    """set, cutoff_date and period_end_excl of the period with that number."""
    columns = {
        "set": ("array<string>", [p.set for p in periods]), "cutoff_date": ("array<date>", [p.cutoff_date for p in periods]),
        "period_end_excl": ("array<date>", [p.period_end_excl for p in periods]),
    }
    return {n: F.get(_constant(v, kind), number) for n, (kind, v) in columns.items()}
