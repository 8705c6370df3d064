"""Refine searches from labelled examples: a probe near an anchor, a linear classifier, a quality scorer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.vectors import affine, l2_normalize
from lodestar.operators.descent import fit_path, minimise, rows_of, summed, warn_unless
from lodestar.session import stored

PENALTY = 0.05
#: Ids named in an error.
MOST_NAMED = 20
#: Rows of a training set that one task takes: a set of a few thousand is one task, so that hundreds of fits are quick.
ROWS_PER_TASK = 50_000
#: Second derivatives of models that are fitted at a time.
GRID_BYTES = 32 << 20
#: Vectors of more components are fitted by gradients, without second derivatives.
WIDE = 256
#: The grid of inverse penalties (fixed values).
GRID = tuple(float(c) for c in np.logspace(-5, 5, 100))


def anchor_max(vectors: DataFrame) -> DataFrame:
    """The element-wise maximum of a column of vectors, one row."""
    tops = vectors.select(F.posexplode("vector").alias("place", "x")).groupBy("place").agg(F.max("x").alias("x"))
    return tops.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("anchor"))


def labelled_vectors(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """labels (id, label) with their vectors (inner)."""
    return labels.join(vectors, "id")


def missing_labels(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """Labelled ids that are not stored."""
    return labels.join(vectors, "id", "left_anti")


def require_labelled(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """labels with their vectors; a labelled id that is not stored is an error."""
    missing = missing_labels(labels, vectors).select("id").limit(MOST_NAMED + 1).collect()
    if missing:
        raise ValueError(f"labelled ids are not stored: {[r.id for r in missing[:MOST_NAMED]]}{' and more' if len(missing) > MOST_NAMED else ''}")
    return labelled_vectors(labels, vectors)


def label_balance(labels: DataFrame) -> DataFrame:
    """Positives, negatives, and whether there are two of each to train on."""
    n = labels.agg(F.count_if(F.col("label")).alias("positives"), F.count_if(~F.col("label")).alias("negatives"))
    return n.withColumn("trainable", (F.col("positives") >= 2) & (F.col("negatives") >= 2))


def _derivatives(w: np.ndarray, b: float):
    """Per task, one row: loss, rows, gradient and Hessian of the logistic loss, packed."""

    def run(batches):
        total = 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vector"].to_numpy()).astype(float)
            y = pdf["label"].to_numpy(float)
            x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            z = x @ w + b
            loss = (np.logaddexp(0, z) - y * z).sum()
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            hess = (x1 * (p * (1 - p))[:, None]).T @ x1
            total = total + np.concatenate([[loss, len(y)], x1.T @ (p - y), hess.reshape(-1)])
        if not np.isscalar(total):
            yield pd.DataFrame({"values": [total]})

    return run


def _newton(rows: DataFrame, dim: int, anchor: np.ndarray, penalty: float, steps: int, tolerance: float):
    """Minimise mean loss + penalty |w - anchor|^2; each step is one aggregation of one row per task."""
    w, b = anchor.astype(float).copy(), 0.0
    for _ in range(steps):
        parts = rows.mapInPandas(_derivatives(w, b), "values array<double>")
        size = 2 + (dim + 1) + (dim + 1) ** 2
        summed = parts.select(F.posexplode("values").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(size)
        flat[summed.k.to_numpy(int)] = summed.v.to_numpy()
        n = flat[1]
        grad = flat[2 : 3 + dim] / n
        hess = flat[3 + dim :].reshape(dim + 1, dim + 1) / n
        grad[:dim] += 2 * penalty * (w - anchor)
        hess[np.arange(dim), np.arange(dim)] += 2 * penalty
        hess[dim, dim] += 1e-12
        move = np.linalg.solve(hess, grad)
        scale = min(1.0, 10.0 / max(1e-12, np.abs(move).max()))
        w, b = w - scale * move[:dim], b - scale * move[dim]
        if np.abs(grad).max() < tolerance:
            break
    else:
        warn_unless(False, "the probe")
    return w, b


def linear_probe(grounding: DataFrame, labelled: DataFrame, penalty: float = PENALTY, steps: int = 50, tolerance: float = 1e-8) -> tuple[np.ndarray, float] | None:
    """(w, b) that minimises mean cross-entropy of labelled (vector, label) + penalty |w - anchor|^2, where the anchor is
    the element-wise maximum of grounding (vector). Without labels w is the anchor; without both, None.

    Up to WIDE components Newton's method: a step aggregates a (d+1)^2 matrix over the rows, so what reaches the driver does not
    grow with them. Wider vectors take L-BFGS, which aggregates gradients only. A fit that has not converged gives a warning.
    """
    anchor = anchor_max(grounding).first().anchor
    has_labels = labelled.limit(1).count() > 0
    if not anchor:
        if has_labels:
            raise ValueError("labels need grounding vectors")
        return None
    anchor = np.array(anchor, float)
    if not has_labels:
        return anchor, 0.0
    rows = labelled.select("vector", "label")
    if len(anchor) <= WIDE:
        return _newton(rows, len(anchor), anchor, penalty, steps, tolerance)
    rows = stored(rows.select("vector", F.col("label").cast("double").alias("label"), F.lit(0).alias("fold"), F.lit(1.0).alias("weight")))
    begin = np.append(anchor, 0.0)
    found, converged = minimise(rows, np.array([2 * penalty]), np.array([-1]), begin[None], begin, tolerance=tolerance)
    warn_unless(bool(converged[0]), "the probe")
    return found[0, :-1], float(found[0, -1])


def _fit_grid(rows: DataFrame, dim: int, models: list[tuple[float, int]], steps: int = 40, tolerance: float = 1e-6) -> np.ndarray:
    """Coefficients (the last one: the intercept) of each model (penalty, left out fold): weighted mean logistic loss +
    penalty / 2 |w|^2. One step of Newton's method of all models together is one pass over the rows."""
    w = np.zeros((len(models), dim + 1))
    todo = np.arange(len(models))
    size, free = dim + 1, np.diag([1.0] * dim + [0.0])
    for _ in range(steps):
        now, left_out = w[todo].copy(), np.array([models[m][1] for m in todo])

        def derivatives(batches, now=now, left_out=left_out, todo=todo):
            total = np.zeros((len(todo), 1 + size + size * size))
            for x, y, fold, c in rows_of(batches):
                weight = c[:, None] * (fold[:, None] != left_out)
                p = 1 / (1 + np.exp(-np.clip(x @ now.T, -500, 500)))
                total[:, 0] += weight.sum(axis=0)
                total[:, 1 : 1 + size] += (x.T @ (weight * (p - y[:, None]))).T
                for m, d in enumerate((weight * p * (1 - p)).T):
                    total[m, 1 + size :] += ((x * d[:, None]).T @ x).reshape(-1)
            yield pd.DataFrame({"model": todo.astype(np.int32), "values": list(total)})

        moved = []
        for m, values in summed(rows, derivatives).items():
            pull = models[m][0] * free
            grad = values[1 : 1 + size] / values[0] + pull @ w[m]
            hess = values[1 + size :].reshape(size, size) / values[0] + pull
            move = np.linalg.solve(hess + 1e-12 * np.eye(size), grad)
            w[m] -= min(1.0, 10.0 / max(1e-12, np.abs(move).max())) * move
            if np.abs(grad).max() >= tolerance:
                moved.append(m)
        todo = np.array(sorted(moved), int)
        if not len(todo):
            break
    warn_unless(not len(todo), f"{len(todo)} of {len(models)} classifiers")
    return w


def linear_classifier(labelled: DataFrame, grid: tuple[float, ...] = GRID, folds: int = 5) -> tuple[np.ndarray, float, float]:
    """(coef, intercept, c) of an L2 logistic regression with balanced classes: c is the inverse penalty of the grid with
    the best mean F1 of the true class over stratified folds (the smallest of equals), the rest MLlib's fit of it on all rows.

    labelled: id, vector, label (boolean). The intercept is not penalised. Each label needs as many rows as there are folds.
    All penalties and folds are fitted together, by Newton's method as many at a time as have GRID_BYTES of second derivatives, or
    for vectors of more than WIDE components all by L-BFGS. Models that have not converged give a warning.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from lodestar.operators.sampling import stratified_folds

    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < folds:
        raise ValueError(f"each of two classes needs {folds} rows, not {counts}")
    total = sum(counts.values())
    weight = F.when(F.col("label"), total / (2 * counts[True])).otherwise(total / (2 * counts[False]))
    rows = stratified_folds(labelled, "label", [F.xxhash64("id"), F.col("id")], folds)
    rows = rows.select("vector", F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"), weight.alias("weight"))
    rows = stored(rows.coalesce(1 + total // ROWS_PER_TASK))
    best = float(grid[0])
    if len(grid) > 1:
        dim = len(rows.first().vector)
        # Mean loss + penalty / 2 |w|^2 here, c * sum of losses + 1/2 |w|^2 where c comes from.
        models = [(1 / (c * (1 - 1 / folds) * total), k) for c in sorted(grid) for k in range(folds)]
        if dim <= WIDE:
            step = max(1, GRID_BYTES // (8 * (dim + 1) ** 2))
            w = np.concatenate([_fit_grid(rows, dim, models[k : k + step]) for k in range(0, len(models), step)])
        else:
            w, converged = fit_path(rows, dim, models)
            warn_unless(bool(converged.all()), f"{int((~converged).sum())} of {len(models)} classifiers")
        held = np.array([k for _, k in models])

        def outcomes(batches):
            counts = np.zeros((len(w), 3))
            for x, y, fold, _ in rows_of(batches):
                said, own, true = x @ w.T > 0, fold[:, None] == held, y[:, None] > 0
                counts += np.stack([(said & own & true).sum(axis=0), (said & own & ~true).sum(axis=0), (~said & own & true).sum(axis=0)], axis=1)
            yield pd.DataFrame({"model": np.arange(len(w), dtype=np.int32), "values": list(counts)})

        found = summed(rows, outcomes)
        f1 = np.array([2 * found[m][0] / max(1.0, 2 * found[m][0] + found[m][1] + found[m][2]) for m in range(len(models))])
        best = sorted(grid)[int(np.argmax(f1.reshape(-1, folds).mean(axis=1).round(12)))]
    fit = LogisticRegression(weightCol="weight", standardization=False, maxIter=1000, tol=1e-8, regParam=1 / (best * total))
    fit = fit.fit(rows.select(array_to_vector("vector").alias("features"), "label", "weight"))
    return np.array(fit.coefficients.toArray()), float(fit.intercept), float(best)


def keep_by_classifier(docs: DataFrame, coef: list[float] | None, intercept: float = 0.0) -> DataFrame:
    """Rows with vector . coef + intercept > 0; all rows without a classifier."""
    if coef is None:
        return docs
    return docs.where(affine(F.col("vector"), coef, intercept) > 0)


def fit_quality_scorer(scored: DataFrame, regularization: float = 0.0) -> tuple[list[float], float]:
    """(coef, intercept) of a linear regression of label / 10 on the unit vector. scored: vector, label."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rows = scored.select(array_to_vector(l2_normalize(F.col("vector"), 1e-6)).alias("features"), (F.col("label") / 10.0).alias("label"))
    fit = LinearRegression(regParam=regularization, solver="normal").fit(rows)
    return [float(c) for c in fit.coefficients], float(fit.intercept)


def quality_score(vector: Column, coef: list[float], intercept: float) -> Column:
    return affine(l2_normalize(vector, 1e-6), coef, intercept)


def regression_quality(rows: DataFrame) -> DataFrame:
    """R2 and mean absolute percentage error of rows (y, said)."""
    mean = rows.agg(F.avg("y").alias("m"))
    both = rows.crossJoin(F.broadcast(mean))
    return both.agg(
        (1 - F.sum((F.col("y") - F.col("said")) ** 2) / F.sum((F.col("y") - F.col("m")) ** 2)).alias("r2"),
        F.avg(F.abs(F.col("y") - F.col("said")) / F.greatest(F.abs("y"), F.lit(1.17e-6))).alias("mape"),
    )


def f1_positive(rows: DataFrame) -> DataFrame:
    """F1 of the positive class of rows (label, said), booleans."""
    n = rows.agg(F.count_if(F.expr("label and said")).alias("tp"), F.count_if(F.expr("not label and said")).alias("fp"), F.count_if(F.expr("label and not said")).alias("fn"))
    return n.select("tp", "fp", "fn", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))
