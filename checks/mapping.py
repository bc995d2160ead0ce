"""The generated order tables, seen as the six source tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.plans.periods import Period, Week, rolling_periods
from cohortlens.sources.tables import Rules, Sources

TRAIN = Period(
    "train", date(1998, 4, 1), date(1998, 1, 1), date(1998, 4, 1), date(1998, 1, 1), date(1998, 7, 1)
)
TEST = Period(
    "test", date(1998, 7, 1), date(1998, 4, 1), date(1998, 7, 1), date(1998, 4, 1), date(1998, 7, 1)
)
HOLDOUT = Period(
    "holdout", date(1998, 10, 1), date(1998, 7, 1), date(1998, 10, 1), date(1998, 7, 1), date(1998, 10, 1)
)
PERIODS = [TRAIN, TEST]
ROLLING = rolling_periods(date(1992, 1, 1), 2500, 1, 60, 30)
WEEK = Week(date(1995, 1, 8), date(1995, 2, 14))

RULES = Rules(
    lead="country = 'O'",
    account="segment <> 'MACHINERY' AND personmobilephone NOT LIKE '%99%'",
    booking="status = 'P'",
    funnel="country_iso = 'N'",
    schedule="flag_register AND flag_online_schedule",
    won="field = 'F' AND newvalue = 'R'",
    opportunity="recordtypename IS NOT NULL",
    sales_types=("1-URGENT", "2-HIGH"),
    supply_types=("5-LOW",),
)


# Given rather than read from the files, which would cost a job per table.
SCHEMAS = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    customer = table(spark, sf_dir, "customer")
    accounts = customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("personmobilephone"),
        F.col("c_mktsegment").alias("segment"),
    )
    return Sources(
        leads=orders.select(
            F.col("o_custkey").alias("accountid"),
            F.col("o_orderkey").alias("opp_id"),
            F.col("o_orderdate").alias("createddate"),
            F.col("o_orderstatus").alias("country"),
        ),
        accounts=accounts,
        reservations=orders.select(
            F.col("o_custkey").alias("account"),
            F.col("o_orderkey").alias("opportunity"),
            F.col("o_orderdate").alias("paymentdate"),
            F.col("o_orderstatus").alias("status"),
        ),
        stage_history=lines.select(
            F.col("l_orderkey").alias("opportunityid"),
            F.col("l_shipdate").alias("createddate"),
            F.col("l_linestatus").alias("field"),
            F.col("l_returnflag").alias("newvalue"),
        ),
        opportunities=orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("accountid"),
            F.col("o_orderpriority").alias("recordtypename"),
        ),
        register_funnel=lines.select(
            F.col("l_orderkey").alias("opportunity_id"),
            F.col("l_shipdate").alias("fecha_registro"),
            F.when(F.col("l_discount") >= 0.05, F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS"))
            .alias("fecha_inspeccion_agendada"),
            F.col("l_returnflag").alias("country_iso"),
            (F.col("l_linestatus") == "O").alias("flag_register"),
            (F.col("l_tax") >= 0.04).alias("flag_online_schedule"),
            F.when(F.col("l_linenumber") != 7, F.floor(F.col("l_extendedprice") / 50) * 50)
            .cast("bigint").alias("km"),
        ),
    )


def sources_with_creation(spark: SparkSession, sf_dir: str) -> Sources:
    """The same, with an account's first order as its creation date."""
    base = sources(spark, sf_dir)
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("o_orderdate").alias("createddate")
    )
    return Sources(**{**base.__dict__, "accounts": base.accounts.join(first, "id")})
