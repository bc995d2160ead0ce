"""Staged tables, the stored event facts and lineage cuts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.operators.events import FactsOptions

BUCKET_BYTES = 256 << 20
MAX_BUCKETS = 16_384


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder that the session names in ``spark.checkpoint.dir``, if it does."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, for work that reads it many times.

    Writes parquet to the shared folder, which outlives executors and lets later steps
    read only their columns. Without a shared folder the frame is cached instead and lost
    blocks are recomputed.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        return df.persist()
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_path = path
    return settled


def release(settled: DataFrame) -> None:
    """Let go of a frame from ``settle`` that no later step reads."""
    path = getattr(settled, "settled_path", None)
    if path is None:
        settled.unpersist()
        return
    spark = settled.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def buckets_for(df: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` by the optimizer's size of ``df``.

    That is the stored size of files and cached rows; of a frame with joins it is their product
    and says nothing, so such a frame has to be settled and computed first.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MAX_BUCKETS, max(1, -(-size // BUCKET_BYTES)))


VERSION = "cohortlens.version"


def staged_version(spark: SparkSession, name: str) -> str | None:
    """The stored table that a staged name points to, if it is one."""
    if not spark.catalog.tableExists(name):
        return None
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}.get(VERSION)


def _versions(spark: SparkSession, name: str) -> list[str]:
    """All stored versions of a staged name, oldest first."""
    database, _, table = name.rpartition(".")
    where = f" IN {database}" if database else ""
    found = sorted(r["tableName"] for r in spark.sql(f"SHOW TABLES{where} LIKE '{table}__v*'").collect())
    return [f"{database}.{t}" if database else t for t in found]


def _swap(spark: SparkSession, name: str, version: str) -> None:
    """Point ``name`` to ``version`` by replacing the view, one change in the catalog."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{VERSION}' = '{version}') AS SELECT * FROM {version}")


def _write_buckets(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store ``df`` dealt by the hash that bucketing uses, so that there are as many files as buckets."""
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def stage_table(df: DataFrame, name: str, key: str | None = "user_id", buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a new version of a table and point ``name`` to it; return the stored rows.

    The name is a view on the current version and is swapped in one step when the new one is
    complete: a reader finds the old rows or the new ones at any time, ``df`` may read the old ones,
    and a run that fails anywhere leaves them. The version before stays for its readers, older ones
    are dropped. With a ``key`` a version is bucketed and sorted by it, so that later joins and
    aggregations on that key read it without a shuffle; the number of buckets follows from the size
    of the computed rows unless given, and a task writes one bucket as one file. A plain table of that
    name becomes the oldest version.
    """
    spark = df.sparkSession
    version = f"{name}__v{time.time_ns() // 1000:017d}"
    if key is None:
        df.write.format("parquet").saveAsTable(version)
    elif buckets is not None:
        _write_buckets(df, version, key, buckets)
    else:
        settled = settle(df)
        if settled.is_cached:
            settled.count()
        try:
            _write_buckets(settled, version, key, buckets_for(settled))
        finally:
            release(settled)
    before = staged_version(spark, name)
    if before is None and spark.catalog.tableExists(name):
        before = f"{name}__v{0:017d}"
        spark.sql(f"ALTER TABLE {name} RENAME TO {before}")
    _swap(spark, name, version)
    for old in _versions(spark, name):
        if before is not None and old < before:
            spark.sql(f"DROP TABLE IF EXISTS {old}")
    return spark.read.table(name)


def drop_staged(spark: SparkSession, name: str) -> None:
    """Drop a staged name and all its versions; a name that does not exist is no error."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for version in _versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS {version}")


def with_rank(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``_rank``, the 0-based place of a row by ``keys`` (NULL first), without a global sort.

    Rows are sorted by ranges and stored with their number in the range; the totals of the ranges
    before, a row each, are added. Rows that agree in all keys follow in any order.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    stored = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start")
    )
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_part", part).join(starts, "_part")
        .withColumn("_rank", F.col("_start") + inside).drop("_part", "_at", "_start")
    )


def write_facts(facts: DataFrame, path: str, built: FactsOptions) -> None:
    """Store event facts by month, so that several datasets can read them instead of the sources.

    ``built`` tells how the facts were made and is stored with them. The rows of a month
    are divided into tasks and files by their size (a rebalance, which needs adaptive
    execution). Facts without a day are stored, too.
    """
    month = F.date_format("event_date", "yyyy-MM")
    (
        facts.withColumns({"built": built.column(), "month": month}).hint("rebalance", "month")
        .write.mode("overwrite").partitionBy("month").parquet(path)
    )


def read_facts(
    spark: SparkSession, path: str, first: date | None = None, end_excl: date | None = None
) -> DataFrame:
    """Stored facts of the days ``[first, end_excl)``; only the months concerned are read.

    Their record ``built`` then covers no more than these days.
    """
    facts = spark.read.parquet(path)
    for kind in ("feature", "label"):
        begin, end = F.col(f"built.{kind}_first"), F.col(f"built.{kind}_end")
        facts = facts.withColumn("built", F.col("built").withField(
            f"{kind}_first", F.greatest(begin, F.lit(first).cast("date"))
        ).withField(f"{kind}_end", F.least(end, F.lit(end_excl).cast("date"))))
    tests = []
    if first is not None:
        tests.append(f"month >= '{first:%Y-%m}' AND event_date >= DATE'{first}'")
    if end_excl is not None:
        tests.append(f"month <= '{end_excl:%Y-%m}' AND event_date < DATE'{end_excl}'")
    return facts.filter(" AND ".join(tests) or "true").drop("month")
