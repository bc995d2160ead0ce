"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
HOT_ROWS = 10_000_000
SALTS = 64


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Has ``df`` at most ``max_rows`` rows, so that it may be broadcast?

    Counts each partition where it is. A small frame stays cached for its use that follows.
    """
    cached_before = df.storageLevel.useMemory or df.storageLevel.useDisk
    small = df.persist().count() <= max_rows
    if not small and not cached_before:
        df.unpersist()
    return small


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough, else as it is, to be shuffled."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def semi_hashed(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The ``rows`` whose ``on`` is among ``keys``, which are few against the rows but of any number.

    Both sides are shuffled and a task keeps the distinct keys of its partition in a hash table; the
    rows pass by it. A merge join would sort them, the ones to drop included, in a task's memory.
    """
    return rows.join(keys.hint("shuffle_hash"), on, "left_semi")


def join_salted(
    facts: DataFrame,
    side: DataFrame,
    on: str,
    spread: list[str],
    how: str = "inner",
    counted: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    max_hot: int = BROADCAST_ROWS,
) -> DataFrame:
    """``facts`` joined with ``side`` (distinct rows) on ``on``, with hot values split.

    A value with more than ``hot_rows`` rows in ``counted`` (the facts unless given; raw rows
    are cheaper to count, as only their key is read and no distinct comes first) is spread
    over ``salts`` tasks by a hash of the ``spread`` columns; only such values are repeated
    on the other side. The broadcast list holds the ``max_hot`` most frequent ones at most:
    which values are split changes the balance of the tasks, never the result.
    """
    counted = facts if counted is None else counted
    hot = F.broadcast(
        counted.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"), on).limit(max_hot)
        .select(F.col(on), F.lit(True).alias("_hot"))
    )
    salted_facts = facts.join(hot, on, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0),
    ).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_side = side.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return salted_facts.join(salted_side, [on, "_salt"], how).drop("_salt")
