import pytest
from inline import make_sources, random_rows
from pyspark.sql import functions as F

from cohortlens import jobs
from cohortlens.sources.files import read_dataset
from cohortlens.sources.schema import DATASET_COLUMNS, WEEKLY_COLUMNS


def test_dataset_train_and_score(spark, tmp_path):
    rows = random_rows(21, users=150)
    for name, df in make_sources(spark, **rows).__dict__.items():
        df.write.parquet(str(tmp_path / "in" / name))
    tables = ["--tables", f"{tmp_path}/in/{{}}", "--tables-format", "parquet"]
    data, run = str(tmp_path / "train_test"), str(tmp_path / "run")

    jobs.main(["dataset", "train-test", *tables, "--out", data])
    dataset = read_dataset(spark, data)
    assert sorted(dataset.columns) == sorted(DATASET_COLUMNS)
    jobs.main(["train", "--data", data, "--outdir", run, "--topk", "0.2", "--calibrate", "sigmoid"])
    curve = spark.read.csv(f"{run}/learning_curve", header=True)
    assert curve.count() == 6

    jobs.main(["dataset", "weekly", *tables, "--week-start", "2025-05-01", "--week-end", "2025-05-31",
               "--out", str(tmp_path / "weekly"), "--format", "csv"])
    weekly = read_dataset(spark, str(tmp_path / "weekly"), "csv")
    assert weekly.columns == WEEKLY_COLUMNS and weekly.count() > 0
    jobs.main(["score", "--data", str(tmp_path / "weekly"), "--format", "csv", "--model", run,
               "--out", str(tmp_path / "scores")])
    scores = spark.read.csv(str(tmp_path / "scores"), header=True, inferSchema=True)
    assert scores.columns == ["user_id", "y_prob"] and scores.count() == weekly.count()
    assert scores.filter(F.col("y_prob").between(0, 1)).count() == scores.count()


def test_periods_and_missing_dates(spark, tmp_path):
    for name, df in make_sources(spark, **random_rows(22, users=40)).__dict__.items():
        df.write.parquet(str(tmp_path / "in" / name))
    tables = ["--tables", f"{tmp_path}/in/{{}}", "--tables-format", "parquet"]
    out = str(tmp_path / "out")
    jobs.main(["dataset", "train-test", *tables, "--out", out,
               "--period", "spring,2025-06-01,2025-03-01,2025-06-01,2025-06-01,2025-07-01"])
    assert {r["set"] for r in read_dataset(spark, out).select("set").distinct().collect()} == {"spring"}
    with pytest.raises(SystemExit, match="--week-start"):
        jobs.main(["dataset", "weekly", *tables, "--out", out])
    with pytest.raises(SystemExit):
        jobs.main(["dataset", "holdout", *tables, "--out", out, "--period", "x,2026-01-01"])
