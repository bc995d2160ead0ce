"""Small shared column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(day: str, start: date | None, end: date | None) -> str:
    """Half-open ``[start, end)`` test in SQL; a missing bound is open.

    With no bound at all every row passes, rows without a day included.

    Bounds are literals so that Spark turns ``cast(ts AS date)`` tests into
    timestamp ranges on the stored column and pushes them to the scan.
    """
    tests = []
    if start is not None:
        tests.append(f"{day} >= DATE'{start}'")
    if end is not None:
        tests.append(f"{day} < DATE'{end}'")
    return f"({' AND '.join(tests)})" if tests else "true"


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` in doubles, NULL when the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def top_count(rows: Column, share: Column) -> Column:
    """How many rows a top share holds: truncated, at least one, at most all."""
    wanted = F.floor(rows.cast("double") * share.cast("double")).cast("bigint")
    return F.least(rows, F.greatest(F.lit(1).cast("bigint"), wanted))


def user_bucket(user_id: Column, buckets: int = 100) -> Column:
    """Stable bucket of a user, the same in any engine that has md5."""
    head = F.substring(F.md5(user_id.cast("string")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def inferred_origin(leads: Column, registers: Column, schedules: Column) -> Column:
    """Which side a user came from; a draw counts as supply."""
    return F.when(registers + schedules >= leads, "supply").otherwise("sales")
