"""Train, calibrate and evaluate a propensity model on a train/test dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import add

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalars import user_bucket
from cohortlens.operators import model as md
from cohortlens.operators import ranking as rk
from cohortlens.operators.newton import MAX_PASSES, NestedFit, fit_nested
from cohortlens.sources.schema import LABEL, coerce_dataset, model_features, split_sets
from cohortlens.sources.staging import settle

# Shares of the fit rows on the learning curve, as split buckets of 80.
LEARNING_BUCKETS = {0.1: 8, 0.2: 16, 0.4: 32, 0.6: 48, 0.8: 64, 1.0: 80}


@dataclass(frozen=True)
class TrainOptions:
    topk: float = 0.1
    penalty: str = "l2"
    l1_ratio: float = 0.5
    C: float = 1.0
    calibrate: str = "none"
    missing_recency: float = md.MISSING_RECENCY


class TrainingRun:
    """A fitted model and its reports, each a DataFrame that is built when asked for."""

    def __init__(self, model: PipelineModel, features: list[str], options: TrainOptions,
                 train: DataFrame, test: DataFrame):
        self.model = model
        self.features = features
        self.options = options
        self._train = train
        self._test = test
        self._built: dict[str, DataFrame] = {}

    @cached_property
    def test_scored(self) -> DataFrame:
        """Test rows with ``y_true``, ``y_prob`` and the lower-case ``split``."""
        return self._score(self._test)

    @cached_property
    def train_scored(self) -> DataFrame:
        """The same for the train rows, which only the metrics need."""
        return self._score(self._train)

    def _score(self, rows: DataFrame) -> DataFrame:
        return settle(md.predict(self.model, rows).select(
            "set", "cutoff_date", "user_id", F.col(LABEL).alias("y_true"), "y_prob",
            F.lower("set").alias("split"),
        ))

    @cached_property
    def test_table(self) -> DataFrame:
        return rk.score_table(self.test_scored, by=["split"])

    @cached_property
    def train_table(self) -> DataFrame:
        return rk.score_table(self.train_scored, by=["split"])

    def _predictions(self) -> DataFrame:
        threshold = self["test_thresholding"].first()["threshold"]
        return rk.flag_top(self.test_scored, threshold).select(
            "set", "cutoff_date", "user_id", "y_true", "y_prob", "y_pred_topk"
        )

    _BUILDERS = {
        "metrics": lambda run: rk.metrics(run.train_table.unionByName(run.test_table), ["split"]),
        "test_thresholding": lambda run: rk.top_k_report(run.test_table, run.options.topk, ["split"]),
        "predictions": _predictions,
        "coef_importance": lambda run: md.coefficients(run.model, run._train.sparkSession),
        "threshold_sweep": lambda run: rk.threshold_sweep(run.test_table, by=["split"]),
        "rec_table": lambda run: rk.recommendations(run["threshold_sweep"]),
        "lift_table": lambda run: rk.lift_table(run.test_table, run.test_scored, by=["split"]),
        "calibration": lambda run: rk.calibration_bins(run.test_table, by=["split"]),
        "roc_curve": lambda run: rk.roc_points(run.test_table, ["split"]),
        "pr_curve": lambda run: rk.pr_points(run.test_table, ["split"]),
        # Grouped by the stored value, so spellings of one set stay apart.
        "auc_by_set": lambda run: rk.metrics(rk.score_table(run.test_scored)).select(
            "set", F.col("roc_auc").alias("auc")
        ),
        "learning_curve": lambda run: learning_curve(run._train, run.features, run.options),
    }

    def close(self) -> None:
        """Release the cached score tables; reports not yet written are computed anew."""
        for name in ("train_scored", "test_scored", "train_table", "test_table"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        self._built.clear()

    @property
    def reports(self) -> list[str]:
        return list(self._BUILDERS)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._BUILDERS[name](self)
        return self._built[name]


def fit_model(train: DataFrame, features: Sequence[str], options: TrainOptions = TrainOptions()) -> PipelineModel:
    """Fit on 80% of the users and, if asked, calibrate on the others."""
    fit, validation = md.split_fit_validation(train)
    model = md.fit_logistic(
        fit, features, options.penalty, options.l1_ratio, options.C, options.missing_recency
    )
    return md.CALIBRATORS[options.calibrate](model, validation)


def learning_fits(
    train: DataFrame, features: Sequence[str], options: TrainOptions = TrainOptions(), max_passes: int = MAX_PASSES
) -> tuple[dict[float, NestedFit], DataFrame]:
    """Fits of the growing samples of the learning curve, and the prepared rows (group, label, features).

    Samples are prefixes of the user buckets, so each contains the smaller ones and one pass over
    the rows serves all fits. The validation rows have the last group.
    """
    shares = list(LEARNING_BUCKETS)
    bucket = user_bucket(F.col("user_id"))
    group = reduce(add, [(bucket >= LEARNING_BUCKETS[s]).cast("int") for s in shares])
    x = md.imputed(features, options.missing_recency)
    rows = settle(train.select(
        group.alias("group"), F.col(LABEL).cast("double").alias("label"), *[x[f].alias(f) for f in features]
    ))
    ridge_share = 1.0 - (options.l1_ratio if options.penalty == "elasticnet" else 0.0)
    fits = fit_nested(rows.filter(F.col("group") < len(shares)), features, len(shares), ridge_share, options.C, max_passes)
    return dict(zip(shares, fits)), rows


def learning_curve(
    train: DataFrame, features: Sequence[str], options: TrainOptions = TrainOptions(), max_passes: int = MAX_PASSES
) -> DataFrame:
    """AUC and average precision on the validation users for growing fit samples, all fitted together."""
    fits, rows = learning_fits(train, features, options, max_passes)

    def probability(fit: NestedFit) -> Column:
        terms = [F.lit(float(c)) * F.col(f"`{f}`") for f, c in zip(features, fit.coefficients)]
        return 1 / (1 + F.exp(-reduce(add, terms, F.lit(fit.intercept))))

    scored = rows.filter(F.col("group") == len(fits)).select(
        F.col("label").cast("int").alias("y_true"),
        F.inline(F.array(*[F.struct(F.lit(s).alias("fraction"), probability(f).alias("y_prob")) for s, f in fits.items()])),
    )
    by = ["fraction"]
    sizes = F.create_map(*[x for s, f in fits.items() for x in (F.lit(s), F.lit(f.rows).cast("long"))])
    return rk.metrics(rk.score_table(scored, by=by), by).select(
        "fraction", sizes[F.col("fraction")].alias("train_rows"), "roc_auc", "pr_auc"
    )


def train_and_evaluate(dataset: DataFrame, options: TrainOptions = TrainOptions()) -> TrainingRun:
    """Fit on the train rows of a dataset; the run reports on its train and test rows."""
    features = model_features(dataset)
    train, test = split_sets(settle(coerce_dataset(dataset)))
    return TrainingRun(fit_model(train, features, options), features, options, train, test)
