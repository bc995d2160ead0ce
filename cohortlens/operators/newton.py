"""Logistic fits of nested samples, all of them in the same passes over the rows.

Each row belongs to a group and a sample holds all groups up to its own, so counts and
spreads of every sample follow from one aggregation per group by running sums. A Newton
pass then adds up loss, gradient and curvature of all samples at once: executors reduce
their rows to one short list of sums per sample, and the driver solves systems of the
size of the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PASSES = 60
TOLERANCE = 1e-9


@dataclass
class NestedFit:
    """One sample's fit: ``coefficients`` belong to the features as they are, ``scaled`` to those times ``scale``."""

    rows: int
    intercept: float
    coefficients: np.ndarray
    scaled: np.ndarray
    scale: np.ndarray


def _group_statistics(rows: DataFrame, names: Sequence[str], groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positives and population deviations of the features, a line for each sample."""
    found = {
        r["group"]: r for r in rows.groupBy("group").agg(
            F.count("*").alias("n"), F.sum("label").alias("pos"),
            *[f(c).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("mean", F.avg), ("var", F.var_pop))],
        ).collect()  # a row for each group
    }
    n = pos = 0.0
    mean, spread = np.zeros(len(names)), np.zeros(len(names))
    lines = []
    for g in range(groups):
        if (r := found.get(g)) is not None:
            m = float(r["n"])
            new = np.array([r[f"mean_{i}"] for i in range(len(names))], float)
            gap = new - mean
            spread += np.array([r[f"var_{i}"] for i in range(len(names))], float) * m + gap * gap * n * m / (n + m)
            mean, n, pos = mean + gap * m / (n + m), n + m, pos + r["pos"]
        lines.append((n, pos, np.sqrt(spread / max(n, 1.0))))
    return tuple(np.array(x) for x in zip(*lines))


def _pass(rows: DataFrame, names: Sequence[str], beta: np.ndarray, weights: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums over each sample: weighted loss, gradient and curvature, as one line of numbers."""
    samples, d = len(beta), len(names) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((samples, 1 + d + d * d))
        for batch in batches:
            group, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.stack([batch.column(2 + i).to_numpy() for i in range(d - 1)] + [np.ones(len(y))], axis=1)
            for s in range(samples):
                inside = group <= s
                xs, ys = x[inside] * np.append(scale[s], 1.0), y[inside]
                margin, w = xs @ beta[s], weights[s][ys.astype(int)]
                p = 1 / (1 + np.exp(-margin))
                sums[s, 0] += (w * (np.logaddexp(0, margin) - ys * margin)).sum()
                sums[s, 1:1 + d] += xs.T @ (w * (p - ys))
                sums[s, 1 + d:] += ((xs * (w * p * (1 - p))[:, None]).T @ xs).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(samples), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["sample", "sums"]
        )

    parts = rows.select("group", "label", *names).mapInArrow(add, "sample int, sums array<double>")
    total = np.zeros((samples, 1 + d + d * d))
    for r in parts.select("sample", F.posexplode("sums").alias("at", "value")).groupBy("sample", "at").agg(F.sum("value").alias("value")).collect():
        total[r["sample"], r["at"]] = r["value"]
    return total


def _descend(beta: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, ridge: float, lasso: float) -> np.ndarray:
    """The least point of the quadratic model around ``beta`` with the penalties, which spare the intercept."""
    d = len(beta)
    penalty = np.append(np.full(d - 1, ridge), 0.0)
    hessian = curvature + np.diag(penalty)
    pull = gradient + penalty * beta
    if not lasso:
        return beta - np.linalg.solve(hessian, pull)
    out = beta.copy()
    for _ in range(1000):
        before = out.copy()
        for i in range(d):
            slope = pull[i] + hessian[i] @ (out - beta)
            free = out[i] - slope / hessian[i, i]
            shrink = lasso / hessian[i, i] if i < d - 1 else 0.0
            out[i] = np.sign(free) * max(abs(free) - shrink, 0.0)
        if np.abs(out - before).max() < 1e-12:
            break
    return out


def fit_nested(
    rows: DataFrame,
    names: Sequence[str],
    groups: int,
    ridge_share: float = 1.0,
    C: float = 1.0,
    max_passes: int = MAX_PASSES,
) -> list[NestedFit]:
    """Class-balanced logistic fits of the samples ``group <= 0``, ``<= 1`` and so on.

    ``rows`` has group (from 0), label (0 or 1) and the features, all without NULLs. Features are
    divided by their deviation in the sample, a constant one keeps its scale; the penalty weighs
    against the summed loss, ``ridge_share`` of it as a square and the rest as absolute values. A
    step that makes the loss worse is halved. A sample without rows of both classes is refused.
    """
    n, pos, deviation = _group_statistics(rows, names, groups)
    if ((pos == 0) | (pos == n)).any():
        raise ValueError("Every sample needs rows of both classes")
    scale = np.divide(1.0, deviation, out=np.ones_like(deviation), where=deviation > 0)
    weights = np.stack([n / (2 * (n - pos)), n / (2 * pos)], axis=1)
    d = len(names) + 1
    strength = 1.0 / (C * n)
    ridge, lasso = strength * ridge_share, strength * (1 - ridge_share)
    beta = np.zeros((groups, d))
    kept, least = beta.copy(), np.full(groups, np.inf)
    done = np.zeros(groups, bool)
    for _ in range(max_passes):
        sums = _pass(rows, names, beta, weights, scale)
        for s in np.flatnonzero(~done):
            slopes = beta[s, :-1]
            loss = sums[s, 0] / n[s] + ridge[s] / 2 * (slopes @ slopes) + lasso[s] * np.abs(slopes).sum()
            if loss > least[s] + 1e-12 * abs(least[s]):
                beta[s] = (beta[s] + kept[s]) / 2
                continue
            kept[s], least[s] = beta[s], loss
            gradient, curvature = sums[s, 1:1 + d] / n[s], sums[s, 1 + d:].reshape(d, d) / n[s]
            beta[s] = _descend(beta[s], gradient, curvature, ridge[s], lasso[s])
            done[s] = np.abs(beta[s] - kept[s]).max() < TOLERANCE
        if done.all():
            break
    return [NestedFit(int(n[s]), float(beta[s, -1]), beta[s, :-1] * scale[s], beta[s, :-1], scale[s]) for s in range(groups)]
