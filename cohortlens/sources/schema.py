"""Dataset contracts: column order, required and optional columns, types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the datasets and of the model inputs.
ID_COLUMNS = ["set", "cutoff_date", "user_id"]
COUNT_FEATURES = [
    "n_qleads_90d",
    "n_bookings_90d",
    "n_registers_90d",
    "n_online_schedules_90d",
    "total_signals_90d",
]
RECENCY_FEATURES = [
    "recency_last_qlead",
    "recency_last_booking",
    "recency_last_register",
    "recency_last_online_schedule",
]
KM_FEATURES = [
    "reg_km_log1p",
    "reg_km_trailing_zeros",
    "reg_km_mod1000_norm",
    "reg_km_mod100_norm",
    "reg_km_is_round_1000",
    "reg_km_is_round_500",
    "reg_km_is_round_100",
    "reg_km_is_round_50",
    "reg_km_is_round_10",
]
LABEL = "target_30d"
REQUIRED_COLUMNS = [*ID_COLUMNS, *COUNT_FEATURES, *RECENCY_FEATURES, LABEL]

DATASET_SCHEMA = T.StructType([
    T.StructField("set", T.StringType()),
    T.StructField("cutoff_date", T.DateType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("n_qleads_90d", T.LongType()),
    T.StructField("n_bookings_90d", T.LongType()),
    T.StructField("recency_last_qlead", T.IntegerType()),
    T.StructField("recency_last_booking", T.IntegerType()),
    T.StructField("n_registers_90d", T.LongType()),
    T.StructField("n_online_schedules_90d", T.LongType()),
    T.StructField("recency_last_register", T.IntegerType()),
    T.StructField("recency_last_online_schedule", T.IntegerType()),
    T.StructField("total_signals_90d", T.LongType()),
    T.StructField("reg_km_last", T.LongType()),
    T.StructField("reg_km_log1p", T.DoubleType()),
    T.StructField("reg_km_trailing_zeros", T.IntegerType()),
    T.StructField("reg_km_is_round_1000", T.IntegerType()),
    T.StructField("reg_km_is_round_500", T.IntegerType()),
    T.StructField("reg_km_is_round_100", T.IntegerType()),
    T.StructField("reg_km_is_round_50", T.IntegerType()),
    T.StructField("reg_km_is_round_10", T.IntegerType()),
    T.StructField("reg_km_mod1000_norm", T.DoubleType()),
    T.StructField("reg_km_mod100_norm", T.DoubleType()),
    T.StructField("target_30d", T.IntegerType()),
])
DATASET_COLUMNS = DATASET_SCHEMA.names

WEEKLY_SCHEMA = T.StructType([
    *DATASET_SCHEMA.fields[:3],
    T.StructField("n_qleads_90d", T.LongType()),
    T.StructField("n_bookings_90d", T.LongType()),
    T.StructField("n_registers_90d", T.LongType()),
    T.StructField("n_online_schedules_90d", T.LongType()),
    T.StructField("recency_last_qlead", T.IntegerType()),
    T.StructField("recency_last_booking", T.IntegerType()),
    T.StructField("recency_last_register", T.IntegerType()),
    T.StructField("recency_last_online_schedule", T.IntegerType()),
    T.StructField("total_signals_90d", T.LongType()),
    T.StructField("n_qleads_7d", T.LongType()),
    T.StructField("n_qleads_30d", T.LongType()),
    T.StructField("n_registers_7d", T.LongType()),
    T.StructField("n_registers_30d", T.LongType()),
    T.StructField("origin_inferred", T.StringType()),
    T.StructField("reg_km_last", T.LongType()),
    T.StructField("target_30d", T.IntegerType()),
])
WEEKLY_COLUMNS = WEEKLY_SCHEMA.names


def require_columns(df: DataFrame, needed: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def ensure_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add absent columns as NULL doubles."""
    return df.withColumns({
        c: F.lit(None).cast("double") for c in names if c not in df.columns
    })


def model_features(df: DataFrame) -> list[str]:
    """Model inputs in order: counts, recencies, and the odometer columns present."""
    return [*COUNT_FEATURES, *RECENCY_FEATURES, *(c for c in KM_FEATURES if c in df.columns)]


def coerce_dataset(df: DataFrame) -> DataFrame:
    """Check the required columns and give keys and label their types.

    A row without a label fails when it is read.
    """
    no_label = F.raise_error(F.lit(f"{LABEL} is NULL"))
    return require_columns(df).withColumns({
        "set": F.col("set").cast("string"),
        "cutoff_date": F.col("cutoff_date").cast("date"),
        "user_id": F.col("user_id").cast("string"),
        LABEL: F.coalesce(F.col(LABEL).cast("int"), no_label),
    })


def validate(df: DataFrame, needed: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """What a training run would refuse, as rows (rule, column, rows), from one pass over the dataset.

    Rules: ``missing column`` (rows: all), ``no key`` for a NULL in a key column, ``no label``, ``bad label``
    for one that is neither 0 nor 1, ``not a number`` for a text in a number's column, ``other set`` for rows
    of neither split and ``empty set`` (rows: 0; the column is the split). A valid dataset gives no rows.
    """
    present = {c for c in needed if c in df.columns}
    if "set" in present:
        counted = {("empty set", s): F.count_if(F.lower("set") == s) for s in ("train", "test")}
        counted["other set", "set"] = F.count_if(~F.coalesce(F.lower("set").isin("train", "test"), F.lit(True)))
    else:
        counted = {}
    for c in [c for c in ID_COLUMNS if c in present]:
        counted["no key", c] = F.count_if(F.col(c).isNull())
    if LABEL in present:
        label = F.col(LABEL).try_cast("double")
        counted["no label", LABEL] = F.count_if(F.col(LABEL).isNull())
        counted["bad label", LABEL] = F.count_if(F.col(LABEL).isNotNull() & ~F.coalesce(label.isin(0.0, 1.0), F.lit(False)))
    for c in [c for c in (*COUNT_FEATURES, *RECENCY_FEATURES) if c in present]:
        counted["not a number", c] = F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
    for c in needed:
        if c not in present:
            counted["missing column", c] = F.count("*")
    row = lambda rule, column, n: F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), n.alias("rows"))
    listed = df.agg(*[n.alias(f"n{i}") for i, n in enumerate(counted.values())]).select(
        F.inline(F.array(*[row(rule, c, F.col(f"n{i}")) for i, (rule, c) in enumerate(counted)]))
    )
    return listed.filter("rule = 'missing column' OR (rule = 'empty set') = (rows = 0)")


def split_sets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the ``set`` column, whatever its case."""
    train = df.filter(F.lower("set") == "train")
    test = df.filter(F.lower("set") == "test")
    if train.isEmpty() or test.isEmpty():
        raise ValueError("Train or test split is empty; check the values of 'set'.")
    return train, test
