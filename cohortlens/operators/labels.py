"""Did the user close a deal in the label window?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.plans.periods import Period, with_periods


def label_users(deals: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Distinct ``(set, cutoff_date, user_id)`` with a deal in the label window."""
    return with_periods(deals, periods, F.lit(True)).select("set", "cutoff_date", "user_id").distinct()


def label_universe(universe: DataFrame, deals: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Universe with a 0/1 ``target_30d`` from the deals of each period."""
    hits = label_users(deals, periods).withColumn("_hit", F.lit(1))
    return universe.join(hits, ["set", "cutoff_date", "user_id"], "left").select(
        *universe.columns, F.coalesce("_hit", F.lit(0)).alias("target_30d")
    )
