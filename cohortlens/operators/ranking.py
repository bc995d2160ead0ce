"""Ranking metrics from one cumulative score table.

``score_table`` reduces scored rows to one row per distinct score with running
counts from the top. AUC, average precision, Brier score, thresholds, sweeps, lift,
calibration bins and curves all read that table, so the scored rows are aggregated
once and are never sorted as a whole. Running counts are taken inside score
ranges and shifted by the totals of the ranges above, so no task holds more than
about ``rows_per_range`` scores, and equal scores are one row however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalars import ratio, top_count
from cohortlens.operators.joins import BROADCAST_ROWS

ROWS_PER_RANGE = 1_000_000


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL, so that a NULL group keeps its rows."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])


def _checked(score: str) -> Column:
    """The score, or an error where there is none: it could be ranked nowhere."""
    value = F.col(score).cast("double")
    missing = F.raise_error(F.lit(f"column {score} holds NULL or NaN; drop or impute such rows before ranking"))
    return F.when(value.isNull() | F.isnan(value), missing.cast("double")).otherwise(value)


def score_table(
    scored: DataFrame,
    by: Sequence[str] = ("set",),
    label: str = "y_true",
    score: str = "y_prob",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Distinct scores per group with counts and running counts, highest score first.

    Columns: ``by``, ``score``, ``n`` rows and ``pos`` positives with that score,
    ``cum_n`` and ``cum_pos`` down to and including it, ``total_n`` and ``total_pos`` of
    the group. A NULL in ``by`` is a group like any other; a NULL or NaN score is refused.
    The number of score ranges follows from the number of distinct scores, and one range
    is computed like many. The table is computed here and cached for its several readers.
    """
    by = list(by)
    counts = scored.select(*by, _checked(score).alias("score"), F.col(label).cast("bigint").alias("_y")).groupBy(
        *by, "score"
    ).agg(F.count("*").alias("n"), F.sum("_y").alias("pos")).persist()
    ranges = max(1, math.ceil(counts.count() / rows_per_range))
    table = _running_by_range(counts, by, ranges).persist()
    table.count()
    counts.unpersist()
    return table


def _running_by_range(counts: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """Running counts inside score ranges of similar size, plus the totals above each."""
    shares = [i / ranges for i in range(1, ranges)]
    edges = sorted(set(counts.approxQuantile("score", shares, 1 / (4 * ranges)))) if shares else []
    if edges:
        cut = Bucketizer(
            splits=[-math.inf, *edges, math.inf], inputCol="score", outputCol="_range"
        ).transform(counts)
    else:
        cut = counts.withColumn("_range", F.lit(0.0))
    group = Window.partitionBy(*by)  # at most one row per range here
    above = group.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = cut.groupBy(*by, "_range").agg(F.sum("n").alias("rn"), F.sum("pos").alias("rp")).select(
        *by, "_range",
        F.coalesce(F.sum("rn").over(above), zero).alias("above_n"),
        F.coalesce(F.sum("rp").over(above), zero).alias("above_pos"),
        F.sum("rn").over(group).alias("total_n"),
        F.sum("rp").over(group).alias("total_pos"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = cut.select(
        *by, "_range", "score", "n", "pos",
        F.sum("n").over(inside).alias("in_n"), F.sum("pos").over(inside).alias("in_pos"),
    )
    return _same(running, offsets, [*by, "_range"]).select(
        *by, "score", "n", "pos",
        (F.col("in_n") + F.col("above_n")).alias("cum_n"),
        (F.col("in_pos") + F.col("above_pos")).alias("cum_pos"),
        "total_n", "total_pos",
    )


def _d(name: str) -> Column:
    return F.col(name).cast("double")


# Score-table columns in doubles: products of counts outgrow a bigint.
def _negatives() -> Column:
    return _d("n") - _d("pos")


def roc_auc() -> Column:
    """Aggregate: share of positive/negative pairs ranked right, ties counting half."""
    won = F.sum(_negatives() * (_d("cum_pos") - _d("pos") + _d("pos") / 2))
    positives, rows = F.max(_d("total_pos")), F.max(_d("total_n"))
    return ratio(won, positives * (rows - positives))


def average_precision() -> Column:
    """Aggregate: precision summed over recall steps, without interpolation."""
    steps = F.sum(_d("pos") * _d("cum_pos") / _d("cum_n"))
    return ratio(steps, F.max(_d("total_pos")))


def brier() -> Column:
    """Aggregate: mean squared distance of score and label."""
    s = F.col("score")
    loss = F.sum(_negatives() * s * s + _d("pos") * (1 - s) * (1 - s))
    return ratio(loss, F.max(_d("total_n")))


def positive_rate() -> Column:
    return ratio(F.sum("pos"), F.sum("n"))


def metrics(table: DataFrame, by: Sequence[str] = ("set",)) -> DataFrame:
    """All rank metrics per group; AUC is NULL for a group with one class."""
    return table.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.sum("pos").alias("positives"),
        roc_auc().alias("roc_auc"),
        average_precision().alias("pr_auc"),
        brier().alias("brier"),
        positive_rate().alias("positive_rate"),
    )


# -- thresholds ----------------------------------------------------------------------


def _at_threshold(table: DataFrame, by: list[str], extra: list[Column | str]) -> DataFrame:
    """Confusion counts when every score down to this row's is flagged."""
    tp, fp = F.col("cum_pos"), F.col("cum_n") - F.col("cum_pos")
    fn = F.col("total_pos") - F.col("cum_pos")
    tn = F.col("total_n") - F.col("cum_n") - fn
    return table.select(
        *by, *extra,
        F.col("score").alias("threshold"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
    )


def _holds(position: Column) -> Column:
    """Is the row at this 1-based position from the top among this score's rows?"""
    return (position <= F.col("cum_n")) & (position > F.col("cum_n") - F.col("n"))


def top_k_report(table: DataFrame, share: float, by: Sequence[str] = ("set",)) -> DataFrame:
    """Threshold of the top share and the confusion matrix at it.

    Scores equal to the threshold are all flagged, so ties can flag more than the
    share.
    """
    wanted = top_count(F.col("total_n"), F.lit(float(share)))
    return _at_threshold(
        table.filter(_holds(wanted)), list(by), [F.lit(float(share)).alias("topk_fraction")]
    )


def threshold_sweep(table: DataFrame, max_k: int = 20, by: Sequence[str] = ("set",)) -> DataFrame:
    """``top_k_report`` for 1 to ``max_k`` percent, in one pass over the table."""
    if not 1 <= max_k <= 100:
        raise ValueError("max_k must be between 1 and 100")
    # Cheap and slightly too wide: could a whole percent end inside this row's positions?
    percent = lambda position: F.lit(100.0) * position / F.col("total_n")
    above = F.col("cum_n") - F.col("n")
    near = (above == 0) | (
        F.ceil(percent(above + 1) - F.lit(1e-6)) < percent(F.col("cum_n") + 1) + F.lit(1e-6)
    )
    share = lambda k: k.cast("double") / F.lit(100.0)
    hits = F.filter(
        F.sequence(F.lit(1), F.lit(max_k)), lambda k: _holds(top_count(F.col("total_n"), share(k)))
    )
    rows = table.filter(near).withColumn("k_pct", F.explode(hits))
    return _at_threshold(rows, list(by), ["k_pct", share(F.col("k_pct")).alias("k_frac")])


# The shares, in percent, of the recommendation table.
RECOMMENDED_PCT = [2, 5, 10, 15]


def recommendations(sweep: DataFrame) -> DataFrame:
    return sweep.filter(F.col("k_pct").isin(RECOMMENDED_PCT))


def flag_top(scored: DataFrame, threshold: float, score: str = "y_prob") -> DataFrame:
    return scored.withColumn("y_pred_topk", (F.col(score) >= F.lit(threshold)).cast("int"))


# -- curves --------------------------------------------------------------------------


def _curve(table: DataFrame, by: list[str], point: dict[str, Column], end: dict[str, float]) -> DataFrame:
    """One row per distinct score, and the fixed ``end`` point next to the highest score."""
    row = F.struct(F.col("score").alias("threshold"), *[c.alias(n) for n, c in point.items()])
    last = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        *[(F.lit(end[n]) if n in end else c).alias(n) for n, c in point.items()],
    )
    is_first = F.col("cum_n") == F.col("n")
    return table.select(*by, F.inline(F.when(is_first, F.array(row, last)).otherwise(F.array(row))))


def roc_points(table: DataFrame, by: Sequence[str] = ("set",)) -> DataFrame:
    """False and true positive rate at every distinct score, and the origin."""
    return _curve(table, list(by), {
        "fpr": ratio(F.col("cum_n") - F.col("cum_pos"), F.col("total_n") - F.col("total_pos")),
        "tpr": ratio(F.col("cum_pos"), F.col("total_pos")),
    }, end={"fpr": 0.0, "tpr": 0.0})


def pr_points(table: DataFrame, by: Sequence[str] = ("set",)) -> DataFrame:
    """Recall and precision at every distinct score, the end point (0, 1) and the base rate."""
    return _curve(table, list(by), {
        "recall": ratio(F.col("cum_pos"), F.col("total_pos")),
        "precision": ratio(F.col("cum_pos"), F.col("cum_n")),
        "baseline": ratio(F.col("total_pos"), F.col("total_n")),
    }, end={"recall": 0.0, "precision": 1.0})


# -- bins ----------------------------------------------------------------------------


def _decile(position: Column, q: int) -> Column:
    """1-based bin of a 0-based position when the rows are cut into ``q`` equal widths."""
    width = _d("total_n") / F.lit(q)
    return F.least(F.floor(position.cast("double") / width).cast("int") + 1, F.lit(q))


def lift_table(
    table: DataFrame,
    scored: DataFrame,
    q: int = 10,
    by: Sequence[str] = ("set",),
    label: str = "y_true",
    score: str = "y_prob",
    user: str = "user_id",
    rows_per_cell: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Response rate and lift per score decile, tied scores ordered by the md5 of the user.

    A score whose rows all fall into one decile is counted from the score table. Only
    the at most ``q - 1`` scores per group that cross a border need their rows ranked;
    since md5 spreads evenly and sorts by prefix, such a score is cut into cells of about
    ``rows_per_cell`` rows that are ranked side by side. Where no score crosses a border,
    ``scored`` is not read. It must give the same scores each time it is read; settle it if
    they are costly or come from a model.
    """
    by = list(by)
    first = _decile(F.col("cum_n") - F.col("n"), q)
    last = _decile(F.col("cum_n") - 1, q)
    placed = table.withColumns({"_first": first, "_last": last})
    whole = placed.filter("_first = _last").select(
        *by, F.col("_first").alias("decile"), "n", "pos", (_d("n") * F.col("score")).alias("score_sum")
    )

    # Hexadecimal digits of the md5 that name a cell: enough for the rows of the tie.
    digits = F.ceil(F.log(16.0, F.greatest(_d("n") / F.lit(float(rows_per_cell)), F.lit(1.0)))).cast("int")
    crossing = placed.filter("_first < _last").select(
        *by, "score", "total_n", (F.col("cum_n") - F.col("n")).alias("_start"), digits.alias("_digits")
    )
    borders = crossing.count()  # reads the score table only
    if not borders:
        return _lift_of(whole, by)
    if borders <= BROADCAST_ROWS:
        crossing = F.broadcast(crossing)
    tied = _same(
        scored.select(*by, F.col(score).cast("double").alias("score"), F.col(label).alias("_y"),
                      F.col(user).cast("string").alias("_user")),
        crossing, [*by, "score"],
    ).withColumn("_order", F.md5("_user")).withColumn(
        "_cell", F.coalesce(F.expr("substring(_order, 1, _digits)"), F.lit(""))
    )
    cell = [*by, "score", "_cell"]
    before = Window.partitionBy(*by, "score").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_start = tied.groupBy(*cell).agg(F.count("*").alias("_cell_n")).select(
        *cell, F.coalesce(F.sum("_cell_n").over(before), F.lit(0).cast("bigint")).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_order", "_user"))
    ranked = _same(tied.withColumn("_rank", rank), cell_start, cell).select(
        *by,
        _decile(F.col("_start") + F.col("_before") + F.col("_rank") - 1, q).alias("decile"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("_y").cast("bigint").alias("pos"),
        F.col("score").alias("score_sum"),
    )

    return _lift_of(whole.unionByName(ranked), by)


def _lift_of(counted: DataFrame, by: list[str]) -> DataFrame:
    """The lift table of partial counts (decile, n, pos, score_sum) per group."""
    bins = counted.groupBy(*by, "decile").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum("score_sum").alias("score_sum")
    )
    group = Window.partitionBy(*by)  # at most q rows each
    overall = ratio(F.sum("positives").over(group), F.sum("n").over(group))
    rate = ratio(F.col("positives"), F.col("n"))
    return bins.select(
        *by, "decile", "n", "positives",
        (F.col("score_sum") / F.col("n")).alias("mean_p"),
        rate.alias("response_rate"),
        ratio(rate, overall).alias("lift"),
    )


def calibration_bins(table: DataFrame, n_bins: int = 10, by: Sequence[str] = ("set",)) -> DataFrame:
    """Mean score and positive share per score-quantile bin; empty bins do not appear.

    Bin borders are quantiles with linear interpolation, and a score's bin is the
    number of inner borders below it. A border below a score is one whose lower
    neighbour among the sorted rows lies below that score, so the positions in the
    score table decide and the borders themselves are not needed.
    """
    shares = [float(s) for s in np.linspace(0, 1, n_bins + 1)[1:-1] * 100 / 100]
    rows_below = F.col("total_n") - F.col("cum_n")
    lower = lambda share: F.floor(F.lit(share) * (_d("total_n") - 1))
    bin_id = reduce(add, [(lower(s) < rows_below).cast("int") for s in shares])
    return table.groupBy(*by, bin_id.alias("bin")).agg(
        F.sum("n").alias("n"),
        (F.sum(_d("n") * F.col("score")) / F.sum("n")).alias("mean_predicted"),
        ratio(F.sum("pos"), F.sum("n")).alias("positive_fraction"),
    )
