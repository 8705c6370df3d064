"""Logistic regressions of many penalties and folds at once, for wide vectors: L-BFGS on gradients summed as a tree.

One pass over the rows evaluates the loss and gradient of every model that is still moving, at the point it asks for. A task gives
one row per block of models; these are added in buckets of tasks first, then over the buckets, so no group takes a row of every
task. What reaches the driver is a gradient per model: models x (width + 1) doubles, never second derivatives. The driver holds a
few steps of history of each model.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the first sums, models of a block, steps of history.
BUCKETS, BLOCK, MEMORY = 64, 50, 8
#: Every so many penalties of a path are fitted first; the others start from the nearest of those.
STRIDE = 8
SHAPE = "model int, values array<double>"


class NotConverged(UserWarning):
    """A fit stopped at its last step before its gradient was small."""


def warn_unless(converged: bool, what: str) -> None:
    if not converged:
        warnings.warn(f"{what} has not converged; its gradient is not yet small", NotConverged, stacklevel=3)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"model": pdf["model"].iloc[:1], "values": [np.sum(np.stack(pdf["values"].to_numpy()), axis=0)]})


def summed(rows: DataFrame, per_task) -> dict[int, np.ndarray]:
    """per_task gives rows (model, values); their sums by model, added in buckets of tasks before they are added up."""
    parts = rows.mapInPandas(per_task, SHAPE).withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(BUCKETS)))
    some = parts.groupBy("model", "bucket").applyInPandas(_add, SHAPE)
    return {r.model: np.array(r.values) for r in some.groupBy("model").applyInPandas(_add, SHAPE).collect()}


def rows_of(batches: Iterator[pd.DataFrame]):
    """Batches of (vector, label, fold, weight) as arrays, the vectors with a last component of 1."""
    for pdf in batches:
        if len(pdf):
            x = np.stack(pdf["vector"].to_numpy()).astype(float)
            yield np.concatenate([x, np.ones((len(x), 1))], axis=1), pdf["label"].to_numpy(float), pdf["fold"].to_numpy(int), pdf["weight"].to_numpy(float)


def _evaluate(rows: DataFrame, points: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weighted loss and its gradient of each model at its point, over the rows outside of the fold it leaves out."""

    def sums(batches):
        blocks = [slice(k, k + BLOCK) for k in range(0, len(points), BLOCK)]
        total = [np.zeros((len(points[b]), points.shape[1] + 2)) for b in blocks]
        for x, y, fold, c in rows_of(batches):
            for b, into in zip(blocks, total, strict=True):
                weight = c[:, None] * (fold[:, None] != left_out[b])
                z = x @ points[b].T
                into[:, 0] += weight.sum(axis=0)
                into[:, 1] += (weight * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
                into[:, 2:] += (weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[:, None])).T @ x
        yield pd.DataFrame({"model": np.arange(len(blocks), dtype=np.int32), "values": [t.reshape(-1) for t in total]})

    found = summed(rows, sums)
    values = np.concatenate([found[k].reshape(-1, points.shape[1] + 2) for k in sorted(found)])
    return values[:, 1] / values[:, 0], values[:, 2:] / values[:, :1]


def minimise(
    rows: DataFrame, pulls: np.ndarray, left_out: np.ndarray, begin: np.ndarray, anchor: np.ndarray | None = None, steps: int = 400, tolerance: float = 1e-6
) -> tuple[np.ndarray, np.ndarray]:
    """(points, converged) of models that minimise mean weighted logistic loss + pull / 2 |w - anchor|^2, the last component (the
    intercept) left free. rows: vector, label (0 or 1), fold, weight; each model leaves a fold out (-1: none)."""
    count, size = begin.shape
    pull = pulls[:, None] * np.append(np.ones(size - 1), 0.0)
    anchor = np.zeros(size) if anchor is None else anchor

    def at(points: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, slope = _evaluate(rows, points, left_out[who])
        off = points - anchor
        return loss + 0.5 * (pull[who] * off * off).sum(axis=1), slope + pull[who] * off

    w = begin.astype(float).copy()
    f, g = at(w, np.arange(count))
    s, y, rho = np.zeros((MEMORY, count, size)), np.zeros((MEMORY, count, size)), np.zeros((MEMORY, count))
    gamma = 1 / np.maximum(np.linalg.norm(g, axis=1), 1e-12)
    step, way = np.ones(count), -g * gamma[:, None]
    moving = np.abs(g).max(axis=1) >= tolerance
    stuck = np.zeros(count, bool)
    for _ in range(steps):
        who = np.flatnonzero(moving & ~stuck)
        if not len(who):
            break
        tried = w[who] + step[who, None] * way[who]
        f_new, g_new = at(tried, who)
        down = f_new <= f[who] + 1e-4 * step[who] * (g[who] * way[who]).sum(axis=1) + 1e-15 * np.abs(f[who])
        step[who[~down]] *= 0.5
        stuck |= step < 1e-12
        who, tried, f_new, g_new = who[down], tried[down], f_new[down], g_new[down]
        moved, change = tried - w[who], g_new - g[who]
        bend = (moved * change).sum(axis=1)
        good = bend > 1e-14 * (change * change).sum(axis=1)
        k = who[good]
        for history, new in ((s, moved[good]), (y, change[good])):
            history[:, k] = np.roll(history[:, k], 1, axis=0)
            history[0, k] = new
        rho[:, k] = np.roll(rho[:, k], 1, axis=0)
        rho[0, k] = 1 / bend[good]
        gamma[k] = bend[good] / (change[good] * change[good]).sum(axis=1)
        w[who], f[who], g[who], step[who] = tried, f_new, g_new, 1.0
        q, part = g[who].copy(), np.zeros((MEMORY, len(who)))
        for m in range(MEMORY):
            part[m] = rho[m, who] * (s[m, who] * q).sum(axis=1)
            q -= part[m][:, None] * y[m, who]
        q *= gamma[who, None]
        for m in range(MEMORY - 1, -1, -1):
            q += s[m, who] * (part[m] - rho[m, who] * (y[m, who] * q).sum(axis=1))[:, None]
        way[who] = -q
        moving[who] = np.abs(g[who]).max(axis=1) >= tolerance
    return w, ~moving


def fit_path(rows: DataFrame, width: int, models: list[tuple[float, int]], steps: int = 400, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, the last one the intercept; converged) of each model (pull, left out fold): some penalties of the path are
    fitted first, all others start from the nearest of them."""
    pulls, folds = (np.array(x) for x in zip(*models, strict=True))
    path = np.unique(pulls)
    some = np.isin(pulls, path[::STRIDE]) if len(path) > 2 * STRIDE else np.ones(len(models), bool)
    w, converged = np.zeros((len(models), width + 1)), np.zeros(len(models), bool)
    w[some], converged[some] = minimise(rows, pulls[some], folds[some], w[some], None, steps, tolerance)
    rest = np.flatnonzero(~some)
    if len(rest):
        known = np.flatnonzero(some)
        for m in rest:
            own = known[folds[known] == folds[m]]
            w[m] = w[own[np.argmin(np.abs(np.log(pulls[own]) - np.log(pulls[m])))]]
        w[rest], converged[rest] = minimise(rows, pulls[rest], folds[rest], w[rest], None, steps, tolerance)
    return w, converged
