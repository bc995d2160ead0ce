"""Reading datasets and writing datasets, scores, reports and models."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources.schema import DATASET_SCHEMA, WEEKLY_SCHEMA
from cohortlens.sources.staging import with_rank


def _csv_types(extra: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in [*WEEKLY_SCHEMA, *DATASET_SCHEMA, *extra]}


def _typed(name: str, kind: T.DataType, cast: str) -> str:
    """A text column as its type; whole numbers may be written with a fraction."""
    value = f"`{name}`"
    if isinstance(kind, T.IntegralType):
        value = f"coalesce(try_cast(`{name}` AS bigint), {cast}({cast}(`{name}` AS double) AS bigint))"
    return f"{cast}({value} AS {kind.simpleString()})"


def _read_csv(spark: SparkSession, path: str, extra: T.StructType) -> DataFrame:
    """Contract types by column name, other columns as text, without a pass to infer types.

    Whole numbers may be written with a fraction (``12.0``), as exports of nullable
    integers often are. Text that is no number fails instead of turning into NULL.
    """
    types = _csv_types(extra)
    text = spark.read.csv(path, header=True)
    return text.selectExpr(*[f"{_typed(c, types.get(c, T.StringType()), 'cast')} AS `{c}`" for c in text.columns])


def read_csv_checked(spark: SparkSession, path: str, extra: T.StructType = T.StructType()) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV dataset that fit the contract, and those that do not.

    A row is kept aside if it has too few or too many values or a text that is not of its column's
    type. The second frame has the row's ``text`` and ``reasons``, a list of ``columns`` or of
    ``name: value``. Both come from the same reading of the files; settle what is used often.
    """
    names = spark.read.csv(path, header=True).columns
    broken = next(f"_broken{i or ''}" for i in range(len(names) + 1) if f"_broken{i or ''}" not in names)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, broken]])
    text = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=broken)
    types = _csv_types(extra)
    typed = {c: F.expr(_typed(c, types.get(c, T.StringType()), "try_cast")) for c in names}
    wrong = [
        F.when(F.col(f"`{c}`").isNotNull() & typed[c].isNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in names
    ]
    reasons = F.when(F.col(broken).isNotNull(), F.array(F.lit("columns"))).otherwise(F.array_compact(F.array(*wrong)))
    line = F.coalesce(F.col(broken), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names])))
    checked = text.select(
        F.struct(*[typed[c].alias(c) for c in names]).alias("row"), line.alias("text"), reasons.alias("reasons")
    )
    fits = F.size("reasons") == 0
    return checked.filter(fits).select("row.*"), checked.filter(~fits).select("text", "reasons")


def read_dataset(
    spark: SparkSession, path: str, fmt: str = "parquet", extra: T.StructType = T.StructType()
) -> DataFrame:
    """A dataset from files; ``extra`` gives the types of further CSV columns."""
    if fmt == "csv":
        return _read_csv(spark, path, extra)
    return spark.read.format(fmt).load(path)


def write_dataset(
    df: DataFrame, path: str, fmt: str = "parquet", order_by: Sequence[str] = ()
) -> None:
    """Write a dataset, parquet partitioned by ``set``; CSV keeps every column in the file.

    ``order_by`` sorts it as a whole over the written files, which only readers of the
    files themselves need.
    """
    if order_by:
        df = df.orderBy(*order_by)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.partitionBy("set").format(fmt).save(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], rows_per_file: int = 1_000_000, fmt: str = "csv") -> None:
    """Write ``df`` in the order of ``keys`` over files of exactly ``rows_per_file`` rows, the last fewer.

    Files lie in folders ``file=0000000``, ``file=0000001`` and so on, whose order is the order of the
    keys (NULL first). A file is written by one task, and no task sorts more than a range of the rows.
    """
    if not keys or rows_per_file < 1:
        raise ValueError("sorted files need keys and at least one row each")
    number = F.format_string("%07d", F.expr(f"_rank div {rows_per_file}"))
    placed = with_rank(df, keys).withColumn("file", number).repartition("file").sortWithinPartitions("file", "_rank").drop("_rank")
    writer = placed.write.mode("overwrite").partitionBy("file")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A table from ``write_table`` with the types it had."""
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def metrics_document(
    metrics: DataFrame, top: DataFrame, features: list[str], split: str = "split"
) -> DataFrame:
    """The nested metrics of a run as a one-row frame.

    ``metrics`` has one row per split and ``top`` one for the test split.
    """
    names = ["roc_auc", "pr_auc", "brier", "positive_rate"]
    part = lambda which: F.max(F.when(F.col(split) == which, F.struct(*names))).alias(which)
    matrix = F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix")
    thresholding = top.select(F.struct(
        "topk_fraction", "threshold", matrix,
        F.col("precision").alias("precision_at_k"), F.col("recall").alias("recall_at_k"),
    ).alias("test_thresholding"), F.lit(1).alias("_one"))
    return (
        metrics.agg(part("train"), part("test")).withColumn("_one", F.lit(1))
        .join(F.broadcast(thresholding), "_one")
        .select(
            "train", "test",
            F.array(*[F.lit(f) for f in features]).alias("features_used"), "test_thresholding",
        )
    )


def write_run(run, folder: str, fmt: str = "csv", reports: Iterable[str] | None = None) -> None:
    """Save the model, the metrics document and the reports (all unless named) of a run."""
    run.model.write().overwrite().save(f"{folder}/model")
    write_metrics(metrics_document(run["metrics"], run["test_thresholding"], run.features), folder)
    for name in run.reports if reports is None else reports:
        if name not in ("metrics", "test_thresholding"):
            write_table(run[name], f"{folder}/{name}", fmt)


_QUALITY = "struct<roc_auc: double, pr_auc: double, brier: double, positive_rate: double>"
METRICS_SCHEMA = f"""train {_QUALITY}, test {_QUALITY}, features_used array<string>,
test_thresholding struct<topk_fraction: double, threshold: double,
  confusion_matrix: struct<tn: bigint, fp: bigint, fn: bigint, tp: bigint>, precision_at_k: double, recall_at_k: double>"""


def read_metrics(spark: SparkSession, folder: str) -> Mapping:
    return json.loads(spark.read.json(f"{folder}/metrics").toJSON().first())


def write_metrics(document: DataFrame, folder: str) -> None:
    document.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")


def metrics_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The stored quality of the splits as rows: split, roc_auc, pr_auc, brier, positive_rate."""
    stored = spark.read.schema(METRICS_SCHEMA).json(f"{folder}/metrics")
    return stored.select(F.inline(F.array(*[F.struct(F.lit(s).alias("split"), f"{s}.*") for s in ("train", "test")])))


def thresholding_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The stored threshold of the test split as one row with its confusion counts."""
    stored = spark.read.schema(METRICS_SCHEMA).json(f"{folder}/metrics").select("test_thresholding.*")
    return stored.select("topk_fraction", "threshold", "precision_at_k", "recall_at_k", "confusion_matrix.*")


def load_model(folder: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/model")
