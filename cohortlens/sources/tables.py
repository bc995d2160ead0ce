"""The six source tables and the business rules applied to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Sources:
    """Source tables under their canonical column names.

    ``leads``            accountid, opp_id, createddate, country, origen
    ``accounts``         id, personmobilephone, createddate
    ``reservations``     account, opportunity, paymentdate, status, country
    ``stage_history``    opportunityid, createddate, field, newvalue
    ``opportunities``    id, accountid, country, recordtypename
    ``register_funnel``  opportunity_id, fecha_registro, fecha_inspeccion_agendada,
                         country_iso, flag_register, flag_online_schedule, km

    Account ids must have one type in all tables, and so must opportunity ids.
    """

    leads: DataFrame
    accounts: DataFrame
    reservations: DataFrame
    stage_history: DataFrame
    opportunities: DataFrame
    register_funnel: DataFrame


# Column names of the warehouse tables that differ from the canonical ones.
WAREHOUSE_COLUMNS = {
    "reservations": {
        "account__c": "account",
        "opportunity__c": "opportunity",
        "paymentdate__c": "paymentdate",
        "status__c": "status",
        "country__c": "country",
    },
    "opportunities": {"country__c": "country", "recordtypename__c": "recordtypename"},
}


def read_sources(
    spark: SparkSession,
    names: dict[str, str],
    columns: dict[str, dict[str, str]] = WAREHOUSE_COLUMNS,
    fmt: str = "table",
) -> Sources:
    """Load the six sources by table name (or by path, with ``fmt`` naming the format)."""
    frames = {}
    for source, name in names.items():
        df = spark.read.table(name) if fmt == "table" else spark.read.format(fmt).load(name)
        frames[source] = df.withColumnsRenamed(columns.get(source, {}))
    return Sources(**frames)


@dataclass(frozen=True)
class Rules:
    """Row conditions per source, as SQL predicates on the canonical columns.

    A predicate that evaluates to NULL drops the row, as in any SQL filter.
    """

    # The market, channel, status and record-type constants.
    lead: str = "country = 'AR' AND origen <> 'Meli wpp'"
    account: str = "personmobilephone NOT LIKE '%+52%'"
    booking: str = "status = 'Capturada' AND country = 'AR'"
    funnel: str = "country_iso = 'AR'"
    schedule: str = "flag_register AND flag_online_schedule"
    won: str = "field = 'StageName' AND newvalue = 'Cerrada ganada'"
    opportunity: str = "country = 'AR'"
    sales_types: tuple[str, ...] = ("Ventas_ARG", "Sales_Global")
    supply_types: tuple[str, ...] = ("Compras", "Supply_Global")
