"""L-BFGS on summed gradients against Newton's method."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import descent, refine
from lodestar.session import stored


def table(spark, n, width, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = x[:, 0] + 0.5 * x[:, 1] + 0.5 * rng.normal(size=n) > 0.2
    return spark.createDataFrame([(k, v.tolist(), bool(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id long, vector array<double>, label boolean")


def weighted(df, folds=3):
    return stored(df.select("vector", F.col("label").cast("double").alias("label"), (F.col("id") % folds).cast("int").alias("fold"), (1.0 + F.col("id") % 2).alias("weight")).repartition(5))


def test_models_are_those_of_newtons_method(spark):
    rows = weighted(table(spark, 400, 12))
    models = [(float(p), k) for p in np.logspace(-4, 1, 20) for k in range(3)]
    got, converged = descent.fit_path(rows, 12, models, tolerance=1e-8)
    assert converged.all()
    assert np.abs(got - refine._fit_grid(rows, 12, models, tolerance=1e-10)).max() < 1e-4


def test_probe_of_wide_vectors(spark, monkeypatch):
    df = table(spark, 300, 10)
    ground = df.limit(3).select("vector")
    want = refine.linear_probe(ground, df)
    monkeypatch.setattr(refine, "WIDE", 4)
    got = refine.linear_probe(ground, df)
    assert np.abs(got[0] - want[0]).max() < 1e-5 and abs(got[1] - want[1]) < 1e-5


def test_classifier_of_wide_vectors(spark, monkeypatch):
    df = table(spark, 250, 8)
    grid = (1e-3, 1e-1, 1.0, 10.0)
    want = refine.linear_classifier(df, grid)
    monkeypatch.setattr(refine, "WIDE", 4)
    got = refine.linear_classifier(df, grid)
    assert got[2] == want[2] and np.abs(got[0] - want[0]).max() < 1e-6


def test_a_fit_that_has_not_converged_says_so(spark):
    rows = weighted(table(spark, 200, 6))
    _, converged = descent.minimise(rows, np.array([1e-3, 10.0]), np.array([0, -1]), np.zeros((2, 7)), steps=2)
    assert converged.tolist() == [False, False] or not converged[0]
    with pytest.warns(descent.NotConverged):
        refine._fit_grid(rows, 6, [(1e-4, 0)], steps=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", descent.NotConverged)
        refine._fit_grid(rows, 6, [(1e-4, 0)])


def test_many_models_of_1536_components(spark):
    """500 gradients of 1537 doubles at a time: 6 MB a pass; the driver's history is 8 steps of it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 1536)).astype(np.float32)
    rows = spark.createDataFrame([(v.tolist(), float(v[0] > 0), k % 5, 1.0) for k, v in enumerate(x)], "vector array<float>, label double, fold int, weight double")
    models = [(float(p), k) for p in np.logspace(-1, 2, 100) for k in range(5)]
    w, converged = descent.fit_path(stored(rows.coalesce(2)), 1536, models, tolerance=1e-5)
    assert w.shape == (500, 1537) and converged.all()
