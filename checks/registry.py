"""The queries by name. Each takes a session and the folder of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import mapping as m
from cohortlens.functions.scalars import user_bucket
from cohortlens.operators import events as ev
from cohortlens.operators import features as ft
from cohortlens.operators import model as md
from cohortlens.operators import ranking as rk
from cohortlens.operators.cohorts import new_accounts, union_users
from cohortlens.operators.isotonic import BLOCK, MODEL_BLOCKS, isotonic_blocks, isotonic_values, step_stage
from cohortlens.operators.labels import label_universe
from cohortlens.plans import datasets as ds
from cohortlens.plans.periods import feature_span, label_span
from cohortlens.plans.scoring import score_rows
from cohortlens.plans.training import TrainingRun, TrainOptions, fit_model, learning_curve, learning_fits, train_and_evaluate
from cohortlens.sources import files
from cohortlens.sources.schema import LABEL, coerce_dataset, model_features, split_sets, validate
from cohortlens.sources.staging import checkpoint_dir, drop_staged, settle, stage_table

Query = Callable[[SparkSession, str], DataFrame]

SIGNAL_SPAN = feature_span(m.PERIODS)
DEAL_SPAN = label_span(m.PERIODS)
HOLDOUT_SPAN = feature_span([m.HOLDOUT])

KM_COLUMNS = [c for c in ds.DATASET_COLUMNS if c.startswith("reg_km_")]

# Coefficients on unscaled features for the fixed scorer, also used in its SQL.
FROZEN_INTERCEPT = -3.0
FROZEN = {
    "n_qleads_90d": 0.4,
    "n_bookings_90d": 0.7,
    "n_registers_90d": 0.25,
    "n_online_schedules_90d": 0.35,
    "total_signals_90d": 0.1,
    "recency_last_qlead": -0.004,
    "recency_last_booking": -0.006,
    "recency_last_register": -0.003,
    "recency_last_online_schedule": -0.002,
    "reg_km_log1p": 0.15,
    "reg_km_trailing_zeros": 0.05,
}


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def text_user(df: DataFrame) -> DataFrame:
    return df.withColumn("user_id", F.col("user_id").cast("string"))


def train_test(spark: SparkSession, sf: str) -> DataFrame:
    return ds.train_test_dataset(m.sources(spark, sf), m.PERIODS, m.RULES)


def holdout(spark: SparkSession, sf: str) -> DataFrame:
    return ds.holdout_dataset(m.sources(spark, sf), m.HOLDOUT, m.RULES)


def weekly(spark: SparkSession, sf: str, fanout: bool) -> DataFrame:
    return ds.weekly_dataset(m.sources_with_creation(spark, sf), m.WEEK, m.RULES, km_mode="raw", fanout=fanout)


def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return train_test(spark, sf).filter(F.lower("set") == "train")


def proxy_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Dataset rows scored on an integer grid, so that ties are many and exact."""
    grid = 10 * F.least("total_signals_90d", F.lit(9)) + F.least("n_bookings_90d", F.lit(9))
    return train_test(spark, sf).select(
        "set", "cutoff_date", "user_id", F.col(LABEL).alias("y_true"),
        (grid.cast("double") / F.lit(100.0)).alias("y_prob"),
    )


def proxy_table(spark: SparkSession, sf: str) -> DataFrame:
    return rk.score_table(proxy_scored(spark, sf))


# -- events, cohorts, features, labels --------------------------------------------------


def _events(build: Callable) -> Query:
    return lambda spark, sf: build(m.sources(spark, sf), m.RULES)


def _transactions(types: tuple[str, ...]) -> Query:
    return lambda spark, sf: ev.transaction_events(m.sources(spark, sf), m.RULES, types)


def register_km_text(spark: SparkSession, sf: str) -> DataFrame:
    """Registers whose readings are text with separators and a unit, some of them empty."""
    src = m.sources(spark, sf)
    text = F.expr("""CASE WHEN opportunity_id % 4 = 0 THEN '' WHEN opportunity_id % 4 = 1 THEN 'km'
        ELSE concat(km div 1000, '.', lpad(km % 1000, 3, '0'), ' km') END""")
    return ev.register_km_events(replace(src, register_funnel=src.register_funnel.withColumn("km", text)), m.RULES)


def lead_origin_events(spark: SparkSession, sf: str) -> DataFrame:
    """Leads under an inequality of their own, accounts under the name rule alone."""
    src = m.sources(spark, sf)
    orders = m.table(spark, sf, "orders").select(F.col("o_orderkey").alias("opp_id"), F.col("o_orderpriority").alias("origen"))
    rules = replace(m.RULES, lead="country = 'O' AND origen <> '5-LOW'", account="personmobilephone NOT LIKE '%99%'")
    return ev.sales_lead_events(replace(src, leads=src.leads.join(orders, "opp_id")), rules)


def universe(spark: SparkSession, sf: str) -> DataFrame:
    return text_user(ds.universe_by_signal(m.sources(spark, sf), m.PERIODS, m.RULES))


def rolling_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """Users, signals and won users of 2,500 periods of 60 days, one starting each day."""
    features = ds.signal_features(m.sources(spark, sf), m.ROLLING, m.RULES, readings=False)
    return features.groupBy("set", "cutoff_date").agg(
        F.count("*").alias("n_users"), F.sum(F.col("n_qleads_90d") + F.col("n_registers_90d")).alias("n_signals"),
        F.sum("recency_last_register").alias("register_days"), F.sum(F.col("target_30d").cast("long")).alias("positives"),
    )


def universe_union(spark: SparkSession, sf: str) -> DataFrame:
    src = m.sources(spark, sf)
    return union_users(*[
        stream(src, m.RULES, HOLDOUT_SPAN)
        for stream in (ev.sales_lead_events, ev.booking_events, ev.register_events, ev.online_schedule_events)
    ])


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return text_user(new_accounts(m.sources_with_creation(spark, sf).accounts, m.RULES, m.WEEK))


def _features(names: list[str]) -> Query:
    readings = "reg_km_last" in names

    def run(spark: SparkSession, sf: str) -> DataFrame:
        features = ds.signal_features(
            m.sources(spark, sf), m.PERIODS, m.RULES, kinds=ev.SIGNALS, readings=readings
        )
        return text_user(features).select(*ft.KEYS, *names)

    return run


def last_km_any(spark: SparkSession, sf: str) -> DataFrame:
    facts = ev.facts(m.sources(spark, sf), m.RULES, SIGNAL_SPAN, DEAL_SPAN)
    return text_user(ft.last_readings(facts, m.PERIODS))


def last_km_present(spark: SparkSession, sf: str) -> DataFrame:
    facts = ev.facts(
        m.sources(spark, sf), m.RULES, HOLDOUT_SPAN, HOLDOUT_SPAN, km_mode="cast", km_in_key=True
    )
    readings = ft.last_readings(facts, [m.HOLDOUT], skip_null_km=True)
    return text_user(readings).filter("reg_km_last IS NOT NULL").select("user_id", "reg_km_last")


def kind_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    src = m.sources(spark, sf)
    facts = ev.facts(src, m.RULES, HOLDOUT_SPAN, HOLDOUT_SPAN, km_mode="cast", km_in_key=True)
    signals = facts.filter(F.col("kind") != ev.TX)
    return text_user(ft.kind_aggregates(signals, ev.eligible_accounts(src.accounts, m.RULES)))


def label_exists(spark: SparkSession, sf: str) -> DataFrame:
    types = (*m.RULES.sales_types, *m.RULES.supply_types)
    deals = ev.transaction_events(m.sources(spark, sf), m.RULES, types, DEAL_SPAN)
    return label_universe(universe(spark, sf), deals, m.PERIODS)


def trailing(spark: SparkSession, sf: str, fanout: bool) -> DataFrame:
    features = ds.weekly_features(m.sources_with_creation(spark, sf), m.WEEK, m.RULES, km_mode="raw", fanout=fanout)
    return text_user(features).select(
        "user_id", "n_qleads_90d", "n_qleads_7d", "n_qleads_30d",
        "n_registers_90d", "n_registers_7d", "n_registers_30d",
    )


# -- model inputs and scores ---------------------------------------------------------------


def user_split(spark: SparkSession, sf: str) -> DataFrame:
    bucket = user_bucket(F.col("user_id"))
    return train_rows(spark, sf).select(
        "user_id", bucket.alias("bucket"), (bucket < md.FIT_BUCKETS).cast("int").alias("is_fit")
    )


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(md.balanced_weights(train_rows(spark, sf)), "weight")


def imputed_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = train_test(spark, sf)
    columns = md.imputed(model_features(rows))
    return rows.select(*ft.KEYS, *[F.round(c, 6).alias(n) for n, c in columns.items()])


def feature_scales(spark: SparkSession, sf: str) -> DataFrame:
    rows = train_rows(spark, sf)
    features = model_features(rows)
    return rounded(md.fit_statistics(rows, features), *features)


def frozen_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = md.frozen_logit(FROZEN_INTERCEPT, FROZEN)
    return train_test(spark, sf).select(*ft.KEYS, F.round(p, 6).alias("y_prob"))


def null_group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics by a group that is NULL for the train rows."""
    scored = proxy_scored(spark, sf).withColumn("grp", F.expr("CASE WHEN set = 'test' THEN set END"))
    return rounded(rk.metrics(rk.score_table(scored, by=["grp"]), ["grp"]), "roc_auc", "pr_auc", "brier", "positive_rate")


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    scored = proxy_scored(spark, sf).filter("set = 'test'").persist()
    top = rk.top_k_report(rk.score_table(scored), 0.1)
    return rk.flag_top(scored, top.first()["threshold"])


def _metric(name: str) -> Query:
    return lambda spark, sf: rounded(rk.metrics(proxy_table(spark, sf)), name).select("set", name)


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rk.threshold_sweep(proxy_table(spark, sf)), "precision", "recall")


def lift(spark: SparkSession, sf: str) -> DataFrame:
    scored = proxy_scored(spark, sf).persist()
    table = rk.lift_table(rk.score_table(scored), scored)
    return rounded(table, "mean_p", "response_rate", "lift")


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rk.calibration_bins(proxy_table(spark, sf)), "mean_predicted", "positive_fraction")


# -- trained models ------------------------------------------------------------------------


def train_and_score(spark: SparkSession, sf: str) -> DataFrame:
    return train_and_evaluate(train_test(spark, sf), TrainOptions(calibrate="isotonic"))["predictions"]


def trained_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return train_and_evaluate(train_test(spark, sf), TrainOptions(calibrate="sigmoid"))["metrics"]


def _fitted(spark: SparkSession, sf: str, options: TrainOptions):
    rows = settle(train_rows(spark, sf))
    return fit_model(rows, model_features(rows), options)


def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return md.coefficients(_fitted(spark, sf, TrainOptions(penalty="elasticnet", l1_ratio=0.3, C=0.8)), spark)


def curve(spark: SparkSession, sf: str) -> DataFrame:
    rows = train_rows(spark, sf)
    return learning_curve(rows, model_features(rows))


def score_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return score_rows(_fitted(spark, sf, TrainOptions(calibrate="isotonic")), holdout(spark, sf))


def score_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly rows lack the derived odometer columns, which then count as missing."""
    return score_rows(_fitted(spark, sf, TrainOptions()), weekly(spark, sf, fanout=True))


def _train_part(spark: SparkSession, sf: str) -> DataFrame:
    """Train rows as a training run takes them."""
    return settle(split_sets(coerce_dataset(train_test(spark, sf)))[0])


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and positives of the sets, whatever the case of their names, after the dataset's checks."""
    mixed = train_test(spark, sf).withColumn("set", F.initcap("set"))
    return reduce(DataFrame.unionByName, [
        part.groupBy(F.lower("set").alias("split")).agg(F.count("*").alias("n"), F.sum(LABEL).alias("positives"))
        for part in split_sets(coerce_dataset(mixed))
    ])


def stationarity(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes of the loss at the fitted coefficients: zero for either penalty."""
    rows = _train_part(spark, sf)
    fit, _ = md.split_fit_validation(rows)
    parts = []
    for penalty in ("l2", "elasticnet"):
        model = md.fit_logistic(fit, model_features(rows), penalty, 0.3, 0.8)
        slopes = md.loss_slopes(model, fit, penalty, 0.3, 0.8)
        parts.append(slopes.select(F.lit(penalty).alias("penalty"), "feature", (F.abs(F.round("slope", 3))).alias("slope")))
    return parts[0].unionByName(parts[1])


def sigmoid_stationarity(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of error and of error times margin at the fitted sigmoid, per unit of weight: zero."""
    rows = _train_part(spark, sf)
    fit, validation = md.split_fit_validation(rows)
    model = md.fit_logistic(fit, model_features(rows))
    calibrated = md.predict(md.calibrate_sigmoid(model, validation), validation, "p")
    margin = md.margin_of(model, calibrated)
    pos = F.sum(LABEL).over(Window.partitionBy())
    n = F.count("*").over(Window.partitionBy())
    target = F.when(F.col(LABEL) == 1, (pos + 1) / (pos + 2)).otherwise(1 / (n - pos + 2))
    error = margin.select("p", "margin", target.alias("t"))
    return error.agg(
        F.abs(F.round(F.avg(F.col("p") - F.col("t")), 3)).alias("error"),
        F.abs(F.round(F.avg((F.col("p") - F.col("t")) * F.col("margin")), 3)).alias("error_by_margin"),
    )


def isotonic_map(spark: SparkSession, sf: str, ranges: int = 1) -> DataFrame:
    """The isotonic map of the fixed proxy score at each of its values."""
    points = settle(
        proxy_scored(spark, sf).groupBy(F.col("y_prob").alias("margin"))
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.col("y_true").cast("double")).alias("pos"))
    )
    mapped = isotonic_values(isotonic_blocks(points, ranges, rows_per_range=3), points, rows_per_range=4)
    return rounded(mapped.select("margin", F.col("value").alias("calibrated")), "calibrated")


def _fixed_scores(rows: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        model = md.fixed_model(spark, FROZEN, FROZEN_INTERCEPT)
        return rounded(score_rows(model, rows(spark, sf)), "y_prob")

    return run


#: Features of the fits that the SQL repeats by Newton steps.
NEWTON_FEATURES = ["n_qleads_90d", "recency_last_booking"]


def curve_two_features(spark: SparkSession, sf: str) -> DataFrame:
    """The learning curve on two features."""
    return rounded(learning_curve(train_rows(spark, sf), NEWTON_FEATURES), "roc_auc", "pr_auc")


def curve_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of all samples of the learning curve on two features."""
    fits, _ = learning_fits(train_rows(spark, sf), NEWTON_FEATURES)
    rows = [(s, f.rows, f.intercept, *map(float, f.coefficients)) for s, f in fits.items()]
    table = spark.createDataFrame(rows, "fraction double, train_rows long, intercept double, n_qleads double, recency_booking double")
    return table.withColumns({c: F.round(c, 4) for c in table.columns[2:]})


def coefficients_two_features(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients on unscaled features of the model's own fit on two features."""
    fit, _ = md.split_fit_validation(_train_part(spark, sf))
    model = md.fit_logistic(fit, NEWTON_FEATURES)
    stage = md.logistic_stage(model)
    scale = next(s for s in model.stages if isinstance(s, ElementwiseProduct)).getScalingVec().toArray()
    row = (float(stage.intercept), *map(float, stage.coefficients.toArray() * scale))
    table = spark.createDataFrame([row], "intercept double, n_qleads double, recency_booking double")
    return table.withColumns({c: F.round(c, 4) for c in table.columns})


def sigmoid_map(spark: SparkSession, sf: str) -> DataFrame:
    """The sigmoid map of the fixed proxy score at each of its values."""
    points = settle(
        proxy_scored(spark, sf).groupBy(F.col("y_prob").alias("margin"))
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.col("y_true").cast("double")).alias("pos"))
    )
    fitted = md.fit_sigmoid(points)
    at = F.lit(float(fitted.intercept)) + F.lit(float(fitted.coefficients[0])) * F.col("margin")
    return points.select("margin", F.round(1 / (1 + F.exp(-at)), 4).alias("calibrated"))


def curve_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return curve(spark, sf).select("fraction", "train_rows")


def coefficient_names(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a fitted model, and whether each odds ratio is the exponential and the order descends."""
    by_coef = Window.orderBy(F.desc("coef"))
    listed = coefficients(spark, sf).withColumn("at", F.monotonically_increasing_id())
    return listed.select(
        "feature", (F.abs(F.log("odds_ratio") - F.col("coef")) < 1e-9).alias("odds_fit"),
        (F.row_number().over(by_coef) == F.row_number().over(Window.orderBy("at"))).alias("in_order"),
    )


# -- sinks, persistence and validation: written, read back and compared ------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    shared = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(name: str, fmt: str, query: Query) -> Query:
    """A query's rows, written as a table and read back."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows, path = query(spark, sf), scratch(spark, name)
        files.write_table(rows, path, fmt)
        return files.read_table(spark, path, rows.schema, fmt)

    return run


def staged_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset staged over an older version of itself, read through its name."""
    rows, name = rounded(train_test(spark, sf), "reg_km_log1p"), f"staged_{uuid.uuid4().hex}"
    path = scratch(spark, "staged")
    try:
        stage_table(rows.filter("set = 'train'"), name)
        stage_table(rows.filter("set = 'test'").unionByName(spark.read.table(name)), name)
        files.write_table(spark.read.table(name), path, "parquet")
    finally:
        drop_staged(spark, name)
    return files.read_table(spark, path, rows.schema, "parquet")


def csv_dataset(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    files.write_dataset(train_test(spark, sf), path, "csv")
    rows, rejected = files.read_csv_checked(spark, path)
    return rounded(rows.join(rejected.select(F.col("text").alias("user_id")), "user_id", "left_anti"), "reg_km_log1p").select(*ds.DATASET_COLUMNS)


def _broken_csv(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Dataset rows as CSV, a seventh with a text for a number and a seventh with a value too few."""
    path, kind = scratch(spark, "broken"), F.col("user_id").cast("long") % 7
    line = F.concat_ws(",", "set", "cutoff_date", "user_id")
    train_test(spark, sf).select(
        F.when(kind == 0, F.concat(line, F.lit(",many"))).when(kind == 1, line).otherwise(F.concat_ws(",", line, "n_qleads_90d"))
        .alias("set,cutoff_date,user_id,n_qleads_90d")
    ).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(path)
    return files.read_csv_checked(spark, path)


def csv_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return _broken_csv(spark, sf)[1].select("text", F.array_join("reasons", "; ").alias("reasons"))


def sorted_export(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and first and last key of sorted files, and whether each is in order."""
    path = scratch(spark, "sorted")
    files.write_sorted(train_test(spark, sf).select("set", "user_id", "n_qleads_90d"), path, ["set", "user_id"], 200)
    rows = spark.read.schema("set string, user_id string, n_qleads_90d long, file int").option("header", True).csv(path)
    key = F.concat_ws(" ", "set", "user_id")
    line = Window.partitionBy("file").orderBy("at")
    lines = rows.withColumns({"key": key, "at": F.monotonically_increasing_id()}).withColumn("before", F.lag("key").over(line))
    return lines.groupBy("file").agg(
        F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        F.bool_and(F.coalesce(F.col("before") < F.col("key"), F.lit(True))).alias("in_order"),
    )


def scores_without_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of rows without ids, written as several files: the generated ids are unique."""
    model = md.fixed_model(spark, FROZEN, FROZEN_INTERCEPT)
    path = scratch(spark, "scores")
    files.write_table(score_rows(model, holdout(spark, sf).drop("user_id").repartition(5)), path, "parquet")
    return spark.read.parquet(path).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("ids"), F.round(F.sum(F.round("y_prob", 6)), 4).alias("total")
    )


def _metrics_folder(spark: SparkSession, sf: str) -> str:
    scored = proxy_scored(spark, sf).withColumn("split", F.lower("set"))
    table, folder = rk.score_table(scored, by=["split"]), scratch(spark, "metrics")
    top = rk.top_k_report(table.filter("split = 'test'"), 0.1, ["split"])
    files.write_metrics(files.metrics_document(rk.metrics(table, ["split"]), top, NEWTON_FEATURES), folder)
    return folder


def metrics_document_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(files.metrics_rows(spark, _metrics_folder(spark, sf)), "roc_auc", "pr_auc", "brier", "positive_rate")


def threshold_document(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(files.thresholding_rows(spark, _metrics_folder(spark, sf)), "precision_at_k", "recall_at_k")


#: A calibrator with given blocks: margin from and to, rows, positives.
FIXED_BLOCKS = [(-4.0, -2.5, 10.0, 1.0), (-1.0, 0.0, 10.0, 4.0), (2.0, 9.0, 10.0, 9.0)]


def _saved_scores(model_blocks: int) -> Query:
    """Holdout scores of a fixed model with a fixed calibrator, saved and loaded before use."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        blocks = spark.createDataFrame(FIXED_BLOCKS, BLOCK)
        base = md.fixed_model(spark, FROZEN, FROZEN_INTERCEPT)
        folder = scratch(spark, "model")
        model = PipelineModel([*base.stages, step_stage(blocks, "rawPrediction", "calibrated", model_blocks)])
        model.write().overwrite().save(f"{folder}/model")
        return rounded(score_rows(files.load_model(folder), holdout(spark, sf)), "y_prob")

    return run


def validation_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings on a dataset without test rows, with columns missing, labels gone and texts for numbers."""
    number = F.col("user_id").cast("long")
    broken = train_rows(spark, sf).drop("n_bookings_90d", "recency_last_qlead").withColumns({
        LABEL: F.when(number % 3 == 0, F.lit(None).cast("int")).when(number % 3 == 1, F.lit(7)).otherwise(F.col(LABEL)),
        "n_qleads_90d": F.when(number % 5 == 0, F.lit("many")).otherwise(F.col("n_qleads_90d").cast("string")),
        "user_id": F.when(number % 4 != 0, F.col("user_id")),
    })
    return validate(broken)


# Coefficients without simple ratios, so that no two different rows share a score by chance.
RUN_INTERCEPT = -2.917341
RUN = {c: w * (1 + 0.0137717 * (i + 1)) for i, (c, w) in enumerate(FROZEN.items())}


def _run_report(name: str, *numbers: str) -> Query:
    """A report of a training run at fixed coefficients."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = settle(coerce_dataset(train_test(spark, sf)))
        train, test = split_sets(rows)
        fixed = TrainingRun(md.fixed_model(spark, RUN, RUN_INTERCEPT), model_features(rows), TrainOptions(), train, test)
        return rounded(fixed[name], *numbers)

    return run


QUERIES: dict[str, Query] = {
    "sales_lead_events": _events(ev.sales_lead_events),
    "booking_events": _events(ev.booking_events),
    "sales_tx_events": _transactions(m.RULES.sales_types),
    "supply_tx_events": _transactions(m.RULES.supply_types),
    "register_events": _events(ev.register_events),
    "online_schedule_events": _events(ev.online_schedule_events),
    "register_km_events": _events(ev.register_km_events),
    "register_km_text_events": register_km_text,
    "lead_origin_events": lead_origin_events,
    "universe_by_signal": universe,
    "universe_union_distinct": universe_union,
    "rolling_cohorts": rolling_cohorts,
    "new_account_cohort": cohort,
    "sales_features": _features([
        "n_qleads_90d", "n_bookings_90d", "recency_last_qlead", "recency_last_booking",
    ]),
    "supply_features": _features([
        "n_registers_90d", "n_online_schedules_90d", "recency_last_register",
        "recency_last_online_schedule", "reg_km_last",
    ]),
    "last_km_asof": last_km_any,
    "last_km_row_number": last_km_present,
    "km_features_circular": lambda spark, sf: rounded(
        train_test(spark, sf).select(*ft.KEYS, *KM_COLUMNS), "reg_km_log1p"
    ),
    "km_features_plain": lambda spark, sf: rounded(
        holdout(spark, sf).select(*ft.KEYS, *KM_COLUMNS), "reg_km_log1p"
    ),
    "per_kind_aggregates": kind_aggregates,
    "label_exists": label_exists,
    "label_left_join": lambda spark, sf: holdout(spark, sf).select("user_id", LABEL),
    "trailing_window_counts": lambda spark, sf: trailing(spark, sf, fanout=False),
    "trailing_window_counts_fanout": lambda spark, sf: trailing(spark, sf, fanout=True),
    "dataset_train_test": lambda spark, sf: rounded(train_test(spark, sf), "reg_km_log1p"),
    "dataset_holdout": lambda spark, sf: rounded(holdout(spark, sf), "reg_km_log1p"),
    "dataset_weekly": lambda spark, sf: weekly(spark, sf, fanout=True),
    "dataset_weekly_corrected": lambda spark, sf: weekly(spark, sf, fanout=False),
    "dataset_summary": lambda spark, sf: rounded(ds.dataset_summary(holdout(spark, sf)), "positive_rate"),
    "user_split_80_20": user_split,
    "balanced_class_weights": class_weights,
    "imputed_features": imputed_features,
    "feature_scales": feature_scales,
    "score_frozen_logit": frozen_scores,
    "predictions_topk": flagged,
    "roc_auc": _metric("roc_auc"),
    "average_precision": _metric("pr_auc"),
    "brier_score": _metric("brier"),
    "auc_by_set": lambda spark, sf: rounded(
        rk.metrics(proxy_table(spark, sf)).select("set", F.col("roc_auc").alias("auc")), "auc"
    ),
    "metrics_by_set": lambda spark, sf: rounded(
        rk.metrics(proxy_table(spark, sf)), "roc_auc", "pr_auc", "brier", "positive_rate"
    ),
    "metrics_by_null_group": null_group_metrics,
    "topk_threshold_report": lambda spark, sf: rounded(
        rk.top_k_report(proxy_table(spark, sf), 0.1), "precision", "recall"
    ),
    "threshold_sweep": sweep,
    "recommendation_table": lambda spark, sf: rk.recommendations(sweep(spark, sf)),
    "lift_by_decile": lift,
    "calibration_bins": calibration,
    "roc_points": lambda spark, sf: rounded(rk.roc_points(proxy_table(spark, sf)), "fpr", "tpr"),
    "pr_points": lambda spark, sf: rounded(
        rk.pr_points(proxy_table(spark, sf)), "recall", "precision", "baseline"
    ),
    "train_and_score": train_and_score,
    "trained_metrics": trained_metrics,
    "coefficients": coefficients,
    "learning_curve": curve,
    "score_holdout": score_holdout,
    "score_weekly": score_weekly,
    "split_counts": split_counts,
    "fit_stationarity": stationarity,
    "sigmoid_stationarity": sigmoid_stationarity,
    "isotonic_map": isotonic_map,
    "isotonic_map_50_ranges": lambda spark, sf: isotonic_map(spark, sf, 50),
    "score_holdout_fixed": _fixed_scores(holdout),
    "score_weekly_fixed": _fixed_scores(lambda spark, sf: weekly(spark, sf, fanout=True)),
    "learning_curve_sizes": curve_sizes,
    "learning_curve_two_features": curve_two_features,
    "learning_curve_coefficients": curve_coefficients,
    "fit_two_features": coefficients_two_features,
    "sigmoid_map": sigmoid_map,
    "coefficient_names": coefficient_names,
    "staged_dataset": staged_dataset,
    "csv_dataset": csv_dataset,
    "csv_checked_rows": lambda spark, sf: _broken_csv(spark, sf)[0],
    "csv_rejected_rows": csv_rejected,
    "sorted_export": sorted_export,
    "predictions_sink": _stored("predictions", "csv", flagged),
    "scores_sink": _stored("scores", "csv", _fixed_scores(holdout)),
    "scores_without_ids": scores_without_ids,
    "sweep_sink": _stored("sweep", "csv", sweep),
    "metrics_document_rows": metrics_document_rows,
    "threshold_document": threshold_document,
    "saved_model_scores": _saved_scores(MODEL_BLOCKS),
    "saved_table_model_scores": _saved_scores(0),
    "validation_findings": validation_findings,
    "run_metrics": _run_report("metrics", "roc_auc", "pr_auc", "brier", "positive_rate"),
    "run_predictions": _run_report("predictions", "y_prob"),
    "run_threshold": _run_report("test_thresholding", "threshold", "precision", "recall"),
    "run_sweep": _run_report("threshold_sweep", "threshold", "precision", "recall"),
    "run_lift": _run_report("lift_table", "mean_p", "response_rate", "lift"),
    "run_calibration": _run_report("calibration", "mean_predicted", "positive_fraction"),
    "run_auc_by_set": _run_report("auc_by_set", "auc"),
}
