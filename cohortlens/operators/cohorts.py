"""Who is in a dataset: users of several streams, or new accounts of a week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.plans.periods import Week
from cohortlens.sources.tables import Rules


def union_users(*streams: DataFrame) -> DataFrame:
    """Distinct users over several streams."""
    out = streams[0].select("user_id")
    for df in streams[1:]:
        out = out.unionByName(df.select("user_id"))
    return out.distinct()


def new_accounts(accounts: DataFrame, rules: Rules, week: Week) -> DataFrame:
    """Accounts created in the closed week, once each."""
    created = F.col("createddate").cast("date")
    return (
        accounts.filter(rules.account)
        .filter((created >= F.lit(week.week_start)) & (created <= F.lit(week.week_end)))
        .select(
            F.lit(week.set).alias("set"), F.lit(week.as_of).alias("cutoff_date"),
            F.col("id").alias("user_id"),
        )
        .distinct()
    )
