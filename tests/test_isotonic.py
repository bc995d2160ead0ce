"""Isotonic blocks against a reference by plain pooling, for any number of ranges."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from cohortlens.operators import isotonic as iso
from cohortlens.operators import model as md


def reference(points):
    """Shares of the isotonic fit at each margin, by pooling from the left."""
    blocks = []
    for m, n, pos in sorted(points):
        blocks.append([[m], n, pos])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {m: pos / n for ms, n, pos in blocks for m in ms}


def shapes():
    rng = np.random.default_rng(8)
    noise = [(i / 100, float(n), float(rng.integers(0, n + 1))) for i, n in enumerate(rng.integers(1, 9, 400))]
    rising = [(float(i), 10.0, float(i // 40)) for i in range(400)]
    falling = [(float(i), 10.0, float(10 - i // 40)) for i in range(400)]
    slow = [(float(i), 5.0, float(rng.random() < i / 400) * 5) for i in range(400)]
    cliff = [(float(i), 1000.0, float(i)) for i in range(399)] + [(399.0, 1e6, 0.0)]
    return {"noise": noise, "rising": rising, "falling": falling, "slow": slow, "cliff": cliff, "one": [(1.0, 2.0, 1.0)], "none": []}


@pytest.mark.parametrize("name", list(shapes()))
def test_blocks_equal_plain_pooling(spark, name):
    points = shapes()[name]
    df = spark.createDataFrame(points, "margin double, n double, pos double")
    want = reference(points)
    for ranges, rows in ((1, 1000), (7, 12)):
        blocks = iso.isotonic_blocks(df, ranges, rows)
        got = {r.margin: r.value for r in iso.isotonic_values(blocks, df.select("margin"), rows).collect()}
        assert got == pytest.approx(want)
        shares = [r.pos / r.n for r in blocks.orderBy("lo").collect()]
        assert shares == sorted(shares)


def test_values_between_and_outside(spark):
    blocks = spark.createDataFrame([(0.0, 1.0, 4.0, 1.0), (3.0, 3.0, 2.0, 1.0), (5.0, 9.0, 4.0, 4.0)], iso.BLOCK)
    margins = spark.createDataFrame([(x,) for x in (-9.0, 0.5, 2.0, 3.0, 4.0, 7.0, 99.0, 2.0)], "margin double")
    for rows in (2, 100):
        got = {r.margin: r.value for r in iso.isotonic_values(blocks, margins, rows).collect()}
        assert got == pytest.approx({-9.0: 0.25, 0.5: 0.25, 2.0: 0.375, 3.0: 0.5, 4.0: 0.75, 7.0: 1.0, 99.0: 1.0})
    assert [r.value for r in iso.isotonic_values(blocks.limit(0), margins).collect()] == [None] * 7


def test_a_million_steps_without_a_collect(spark, monkeypatch):
    """A million distinct rising shares: every step stays a block and comes back at its margin."""
    points = spark.range(1_000_000).selectExpr("double(id) AS margin", "double(1000000) AS n", "double(id) AS pos")

    def refuse(self, *args):
        raise AssertionError("rows were collected")

    with monkeypatch.context() as patch:
        patch.setattr(type(points), "collect", refuse)
        patch.setattr(type(points), "toPandas", refuse)
        blocks = iso.isotonic_blocks(points, rows_per_range=100_000)
        values = iso.isotonic_values(blocks, points, 100_000)
    assert blocks.count() == 1_000_000
    assert values.filter("abs(value - margin / 1000000) > 1e-12").count() == 0 and values.count() == 1_000_000


def test_calibrated_model_with_either_stage(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"u{i}", float(x), int(rng.random() < 1 / (1 + np.exp(-x)))) for i, x in enumerate(rng.normal(0, 2, 600))]
    df = spark.createDataFrame(rows, "user_id string, n_qleads_90d double, target_30d int")
    base = md.fixed_model(spark, {"n_qleads_90d": 1.0}, 0.0)
    plain = md.calibrate_isotonic(base, df)
    table = md.calibrate_isotonic(base, df, ranges=5, model_blocks=0)
    assert isinstance(table.stages[-1], iso.StepMap) and not isinstance(plain.stages[-1], iso.StepMap)
    table.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    other = spark.createDataFrame([(f"v{i}", float(x)) for i, x in enumerate(np.linspace(-9, 9, 50))] + [("v1", None)], "user_id string, n_qleads_90d double")
    scores = [{(r.user_id, r.n_qleads_90d): r.y_prob for r in md.predict(m, other).collect()} for m in (plain, table, loaded)]
    assert scores[0] == pytest.approx(scores[1]) and scores[1] == scores[2] and len(scores[0]) == 51
    assert min(scores[0].values()) >= 0 and max(scores[0].values()) <= 1
    want = reference([(m, n, p) for m, n, p in [(r.m, r.n, r.p) for r in df.groupBy(F.col("n_qleads_90d").alias("m")).agg(
        F.count("*").cast("double").alias("n"), F.sum("target_30d").cast("double").alias("p")).collect()]])
    got = {r.n_qleads_90d: r.y_prob for r in md.predict(plain, df).collect()}
    assert got == pytest.approx(want)
