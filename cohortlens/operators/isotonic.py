"""Isotonic regression of counted shares, pooled on executors.

The fit is the convex minorant of the points (rows so far, positives so far): each of its
edges is a block of margins with one share. Ranges of margins are pooled side by side,
which leaves few blocks, and neighbouring ranges are then merged. For any slope ``s`` the
place where ``positives - s * rows`` is least is a corner of the minorant, so blocks on its
two sides never pool together: a round takes such places for several slopes at once, one
grouped minimum over all blocks, and cuts the sequence there into segments. Rounds end when
every segment fits a task or is a single block. No list of steps reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.sources.staging import settle

ROWS_PER_RANGE = 1_000_000
#: Slopes tried in a round beside the mean of a segment.
SLOPES = 15
#: Blocks up to which the map becomes Spark's own model, which keeps its steps on the driver.
MODEL_BLOCKS = 100_000
BLOCK = "lo double, hi double, n double, pos double"


def pool(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks with rising shares from adjacent ones in order of their margins."""
    los, his, ns, ps = [], [], [], []
    for a, b, w, y in zip(lo.tolist(), hi.tolist(), n.tolist(), pos.tolist()):
        while ns and ps[-1] * w >= y * ns[-1]:
            a, w, y = los.pop(), w + ns.pop(), y + ps.pop()
            his.pop()
        los.append(a)
        his.append(b)
        ns.append(w)
        ps.append(y)
    return tuple(np.array(x, float) for x in (los, his, ns, ps))


def _pool_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's rows (margin, n, pos), sorted, with running sums inside the task."""
    read = [tuple(c.to_numpy() for c in batch.columns) for batch in batches]
    margin, n, pos = (np.concatenate([np.zeros(0), *x]) for x in zip(*read)) if read else [np.zeros(0)] * 3
    blocks = pool(margin, margin, n, pos)
    part = np.full(len(blocks[0]), TaskContext.get().partitionId(), np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (part, *blocks, np.cumsum(blocks[2]), np.cumsum(blocks[3]))],
        names=["part", "lo", "hi", "n", "pos", "in_n", "in_pos"],
    )


def _pool_segment(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("lo")
    return pd.DataFrame(dict(zip(("lo", "hi", "n", "pos"), pool(*(rows[c].to_numpy() for c in ("lo", "hi", "n", "pos"))))))


def _split(blocks: DataFrame, rows_per_range: int) -> tuple[DataFrame, DataFrame]:
    """``blocks`` in segments that pool by themselves, and the large segments that are one block.

    A segment is named by the rows before it. Each round costs two aggregations over the blocks.
    """
    blocks = blocks.withColumn("segment", F.lit(0.0))
    single: list[DataFrame] = []
    while True:
        shares = [i / (SLOPES + 1) for i in range(1, SLOPES + 1)]
        stats = blocks.groupBy("segment").agg(
            F.count("*").alias("size"), F.min(F.col("cp") - F.col("pos")).alias("p0"), F.max("cn").alias("n1"),
            F.max("cp").alias("p1"), F.percentile_approx(F.col("pos") / F.col("n"), shares, 1000).alias("tried"),
        ).filter(F.col("size") > rows_per_range)
        if single:
            stats = stats.join(reduce(DataFrame.unionByName, single).select("segment"), "segment", "left_anti")
        mean = (F.col("p1") - F.col("p0")) / (F.col("n1") - F.col("segment"))
        stats = settle(stats.withColumn("slopes", F.array_distinct(F.concat(F.array(mean), "tried"))).drop("tried", "size"))
        if stats.isEmpty():
            break
        height = (F.col("cp") - F.col("p0")) - F.col("slope") * (F.col("cn") - F.col("segment"))
        least = (
            blocks.join(stats, "segment").withColumn("slope", F.explode("slopes"))
            .groupBy("segment", "slope").agg(F.min(F.struct(height.alias("height"), "cn", "n1", "p1")).alias("least"))
        )
        # A cut at either end is none; below zero up to what doubles resolve.
        real = (F.col("least.height") < -1e-12 * F.greatest(F.col("least.p1"), F.lit(1.0))) & (F.col("least.cn") < F.col("least.n1"))
        cuts = settle(least.filter(real).groupBy("segment").agg(F.collect_set("least.cn").alias("cuts")))
        single.append(settle(stats.join(cuts, "segment", "left_anti").select("segment")))
        before = F.filter("cuts", lambda c: c <= F.col("cn") - F.col("n"))
        blocks = settle(
            blocks.join(cuts, "segment", "left")
            .withColumn("segment", F.coalesce(F.array_max(before), "segment")).drop("cuts")
        )
    whole = reduce(DataFrame.unionByName, single) if single else blocks.select("segment").limit(0)
    return blocks, whole


def isotonic_blocks(points: DataFrame, ranges: int | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Blocks (lo, hi, n, pos) of the isotonic fit to rows (margin, n, pos), with rising ``pos / n``.

    Equal margins are one point. The number of ranges follows from the number of margins unless
    given; the result is the same for any. Without points there are no blocks.
    """
    merged = settle(points.groupBy(F.col("margin").cast("double").alias("margin")).agg(
        F.sum(F.col("n").cast("double")).alias("n"), F.sum(F.col("pos").cast("double")).alias("pos")
    ).filter("n > 0"))
    if ranges is None:
        ranges = max(1, math.ceil(merged.count() / rows_per_range))
    ranged = merged.repartitionByRange(ranges, "margin") if ranges > 1 else merged.coalesce(1)
    pooled = settle(
        ranged.sortWithinPartitions("margin")
        .mapInArrow(_pool_range, f"part int, {BLOCK}, in_n double, in_pos double")
    )
    if ranges == 1:
        return pooled.select("lo", "hi", "n", "pos")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = pooled.groupBy("part").agg(F.sum("n").alias("rn"), F.sum("pos").alias("rp")).select(
        "part", F.coalesce(F.sum("rn").over(before), F.lit(0.0)).alias("n0"), F.coalesce(F.sum("rp").over(before), F.lit(0.0)).alias("p0")
    )
    running = pooled.join(starts, "part").select(
        "lo", "hi", "n", "pos", (F.col("n0") + F.col("in_n")).alias("cn"), (F.col("p0") + F.col("in_pos")).alias("cp")
    )
    blocks, whole = _split(settle(running), rows_per_range)
    one = blocks.join(whole, "segment", "left_semi").groupBy("segment").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("pos").alias("pos")
    ).drop("segment")
    many = blocks.join(whole, "segment", "left_anti").select("segment", "lo", "hi", "n", "pos").groupBy("segment").applyInPandas(_pool_segment, BLOCK)
    return settle(one.unionByName(many))


def isotonic_values(blocks: DataFrame, margins: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(margin, value) for each distinct margin: linear between blocks, clipped outside.

    Blocks and margins meet by ranges, each of which also gets the blocks next to it. Without
    blocks the value is NULL.
    """
    corners = blocks.select(F.explode(F.array("lo", "hi")).alias("margin"), (F.col("pos") / F.col("n")).alias("value")).distinct()
    corners = settle(corners)
    margins = margins.select(F.col("margin").cast("double").alias("margin")).distinct()
    ranges = max(1, math.ceil(corners.count() / rows_per_range))
    shares = [i / ranges for i in range(1, ranges)]
    edges = sorted(set(corners.approxQuantile("margin", shares, 1 / (4 * ranges)))) if shares else []

    def ranged(df: DataFrame) -> DataFrame:
        if not edges:
            return df.withColumn("range", F.lit(0.0))
        return Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="margin", outputCol="range").transform(df)

    placed = ranged(corners)
    ends = placed.groupBy("range").agg(
        F.min(F.struct("margin", "value")).alias("first"), F.max(F.struct("margin", "value")).alias("last")
    )
    every = margins.sparkSession.range(len(edges) + 1).select(F.col("id").cast("double").alias("range"))
    order = Window.orderBy("range")  # a row for each range
    sides = every.join(ends, "range", "left").select(
        "range", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("below"),
        F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("above"),
    )
    beside = sides.select("range", F.explode(F.array("below", "above")).alias("corner")).filter(
        "corner IS NOT NULL"
    ).select("corner.margin", "corner.value", "range")

    def interpolate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["margin", "value"])
        value = np.interp(left["margin"], right["margin"], right["value"]) if len(right) else np.full(len(left), np.nan)
        return pd.DataFrame({"margin": left["margin"], "value": value})

    found = ranged(margins).groupBy("range").cogroup(placed.unionByName(beside).groupBy("range")).applyInPandas(
        interpolate, "margin double, value double"
    )
    return found.select("margin", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


class StepMap(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """A monotone map kept as a table of blocks, for more steps than a driver should hold.

    ``inputCol`` is a vector whose second entry is the margin. The blocks are saved and loaded
    with the stage.
    """

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, blocks: DataFrame | None = None):
        super().__init__()
        given = dict(self._input_kwargs)
        self.blocks = given.pop("blocks", None)
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in dataset.columns]).alias("_row")
        rows = settle(dataset.select(row, vector_to_array(self.getInputCol())[1].alias("margin")))
        values = settle(isotonic_values(self.blocks, rows))
        return rows.join(values, "margin", "left").select("_row.*", F.col("value").alias(self.getOutputCol()))

    def write(self) -> MLWriter:
        return _StepMapWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StepMapReader()


class _StepMapWriter(MLWriter):
    def __init__(self, stage: StepMap):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.blocks.write.parquet(f"{path}/blocks")


class _StepMapReader(MLReader):
    def load(self, path: str) -> StepMap:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = StepMap(blocks=self.sparkSession.read.parquet(f"{path}/blocks"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


def step_stage(blocks: DataFrame, input_col: str, output_col: str, model_blocks: int = MODEL_BLOCKS) -> IsotonicRegressionModel | StepMap:
    """A pipeline stage that applies the blocks: Spark's own model up to ``model_blocks``, else a ``StepMap``."""
    if blocks.count() > model_blocks:
        return StepMap(inputCol=input_col, outputCol=output_col, blocks=blocks)
    share = F.col("pos") / F.col("n")
    corners = blocks.select(F.explode(F.array("lo", "hi")).alias("margin"), share.alias("label"), F.col("n").alias("weight"))
    model = IsotonicRegression(featuresCol="margin", weightCol="weight").fit(corners)
    return model.setFeaturesCol(input_col).setFeatureIndex(1).setPredictionCol(output_col)
