"""Shared helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the operators' contracts: blank and the five ASCII control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors reach.

    Only a local session without that setting gets a temporary folder, set once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="cohortlens-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet in the shared folder and read from there.

    Cuts the lineage with files that outlive executors; later reads fetch only the
    columns they use.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled.settled_path = path
    return settled


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames from ``settle`` that no later step reads."""
    for settled in frames:
        jvm = settled.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(settled.settled_path)
        path.getFileSystem(settled.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def valid_texts(texts: pa.Array) -> pa.Array:
    """The texts as strings; what is not UTF-8 in one becomes the replacement character U+FFFD."""
    texts = texts.cast(pa.string())
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        raw = texts.cast(pa.binary()).to_pylist()
        texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.string())
    return texts


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character unchanged."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def total(df: DataFrame, *columns: Column) -> tuple:
    """One row of aggregates over ``df``."""
    return tuple(df.agg(*columns).first())


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which otherwise stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
