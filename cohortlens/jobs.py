"""Jobs for ``spark-submit``: build a dataset, train and evaluate, score.

    spark-submit cohortlens/jobs.py train --data /data/train_test --outdir /data/run \\
        --topk 0.10 --calibrate isotonic
    spark-submit cohortlens/jobs.py score --data /data/holdout --model /data/run --out /data/scores
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date

from pyspark.sql import SparkSession

from cohortlens.operators.model import CALIBRATORS
from cohortlens.plans import datasets as ds
from cohortlens.plans.periods import HOLDOUT_2025, TEST_2025, TRAIN_2025, Period, Week
from cohortlens.plans.scoring import score_rows
from cohortlens.plans.training import TrainOptions, train_and_evaluate
from cohortlens.sources.files import load_model, read_dataset, write_dataset, write_run, write_table
from cohortlens.sources.tables import Sources, read_sources


def build_dataset(spark: SparkSession, args: argparse.Namespace) -> None:
    names = {t: args.tables.format(t) for t in Sources.__dataclass_fields__}
    sources = read_sources(spark, names, fmt=args.tables_format)
    if args.kind == "train-test":
        dataset = ds.train_test_dataset(sources, args.period or [TRAIN_2025, TEST_2025])
    elif args.kind == "holdout":
        periods = args.period or [HOLDOUT_2025]
        if len(periods) != 1:
            raise SystemExit("a holdout dataset takes one --period")
        dataset = ds.holdout_dataset(sources, periods[0], mod_mode=args.mod_mode)
    else:
        if not (args.week_start and args.week_end):
            raise SystemExit("a weekly dataset needs --week-start and --week-end")
        week = Week(args.week_start, args.week_end)
        dataset = ds.weekly_dataset(sources, week, km_mode=args.km_mode, fanout=args.fanout)
    write_dataset(dataset, args.out, args.format)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    options = TrainOptions(args.topk, args.penalty, args.l1_ratio, args.C, args.calibrate)
    write_run(train_and_evaluate(read_dataset(spark, args.data, args.format), options), args.outdir)


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = read_dataset(spark, args.data, args.format)
    write_table(score_rows(load_model(args.model), rows), args.out)


def period(text: str) -> Period:
    """``name,cutoff,start,end,label_start,label_end`` with ends exclusive."""
    name, *days = text.split(",")
    if len(days) != 5:
        raise argparse.ArgumentTypeError("a period is name,cutoff,start,end,label_start,label_end")
    return Period(name, *map(date.fromisoformat, days))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cohortlens")
    jobs = top.add_subparsers(required=True)
    options = TrainOptions()

    job = jobs.add_parser("dataset")
    job.set_defaults(run=build_dataset)
    job.add_argument("kind", choices=["train-test", "holdout", "weekly"])
    job.add_argument("--tables", required=True, help="table name or path with {} for the source")
    job.add_argument("--tables-format", default="table")
    job.add_argument("--period", type=period, action="append", help="name,cutoff,start,end,label_start,label_end")
    job.add_argument("--week-start", type=date.fromisoformat)
    job.add_argument("--week-end", type=date.fromisoformat)
    job.add_argument("--mod-mode", choices=["circular", "plain"], default="circular",
                     help="modulo features of a holdout; a model of the train dataset expects circular")
    job.add_argument("--km-mode", choices=["cast", "digits", "raw"], default="cast")
    job.add_argument("--fanout", action="store_true", help="weekly counts as a join of leads with registers gives them")
    job.add_argument("--out", required=True)
    job.add_argument("--format", default="parquet")

    job = jobs.add_parser("train")
    job.set_defaults(run=train)
    job.add_argument("--data", required=True)
    job.add_argument("--outdir", required=True)
    job.add_argument("--topk", type=float, default=options.topk)
    job.add_argument("--penalty", choices=["l2", "elasticnet"], default=options.penalty)
    job.add_argument("--l1_ratio", type=float, default=options.l1_ratio)
    job.add_argument("--C", type=float, default=options.C)
    job.add_argument("--calibrate", choices=list(CALIBRATORS), default=options.calibrate)
    job.add_argument("--format", default="parquet")

    job = jobs.add_parser("score")
    job.set_defaults(run=score)
    job.add_argument("--data", required=True)
    job.add_argument("--model", required=True, help="folder of a training run")
    job.add_argument("--out", required=True)
    job.add_argument("--format", default="parquet")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("cohortlens").getOrCreate(), args)


if __name__ == "__main__":
    main()
