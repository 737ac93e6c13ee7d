"""Dual coordinate ascent: certificate, optimality conditions and agreement with other solvers."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidelab.ml import dual
from tidelab.ml.dual import DualSVC, DualSVR


def table(spark, x, y):
    rows = [(i, Vectors.dense(r.tolist()), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["id", "features", "label"])


def primal(w, x, y, C, epsilon=None):
    margin = np.hstack([x, np.ones((len(x), 1))]) @ w
    loss = np.maximum(0, 1 - y * margin) if epsilon is None else np.maximum(0, np.abs(y - margin) - epsilon)
    return 0.5 * w @ w + C * loss.sum()


def descend(x, y, C, epsilon=None, steps=40_000):
    """The best value of a plain sub-gradient descent."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]) / C, z.T @ y)
    best = primal(w, x, y, C, epsilon)
    for t in range(1, steps):
        m = z @ w
        s = -y * (y * m < 1) if epsilon is None else -np.sign(y - m) * (np.abs(y - m) > epsilon)
        w = w - (w + C * z.T @ s) / (t + 10 * C)
        best = min(best, primal(w, x, y, C, epsilon))
    return best


@pytest.mark.parametrize("block_numbers", [1 << 20, 200 * 5])
@pytest.mark.parametrize("kind", ["svc", "svr"])
def test_gap_box_and_optimality(spark, monkeypatch, kind, block_numbers):
    monkeypatch.setattr(dual, "BLOCK_NUMBERS", block_numbers)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4))
    signal = x @ np.array([2.0, -1.0, 0.5, 0.0]) + 0.3
    if kind == "svc":
        label = (signal + rng.normal(size=400) > 0).astype(float)
        y, est, epsilon = 2 * label - 1, DualSVC(C=0.5, keyCol="id", tol=0.02, epochs=10, maxIter=12), None
    else:
        label = y = signal + 0.3 * rng.normal(size=400)
        est, epsilon = DualSVR(C=0.5, epsilon=0.2, keyCol="id", tol=0.02, epochs=10, maxIter=12), 0.2
    model = est.fit(table(spark, x, label).coalesce(1))
    assert model.facts["converged"] or block_numbers < 1 << 20  # two blocks of 200 rows take more rounds
    got = primal(model.weights, x, y, 0.5, epsilon)
    assert got == pytest.approx(model.facts["primal"], rel=1e-9)
    assert got - model.facts["gap"] <= descend(x, y, 0.5, epsilon) + 1e-9  # the dual value is below every primal value
    a = {r["key"]: r for r in model.duals.collect()}
    assert len(a) == 400
    low = 0 if kind == "svc" else -0.5
    assert all(low <= r["a"] <= 0.5 for r in a.values())
    z = np.hstack([x, np.ones((400, 1))])
    weight = np.array([a[i]["a"] * (y[i] if kind == "svc" else 1) for i in range(400)])
    assert np.allclose(z.T @ weight, model.weights)


def test_accuracy_and_odd_inputs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    df = table(spark, x, (x[:, 0] > 0.2).astype(float))
    model = DualSVC(tol=0.02, epochs=10).fit(df)
    assert model.transform(df).where(F.col("prediction") == F.col("label")).count() >= 280
    assert model.duals is None
    empty = DualSVR().fit(df.where("false"))
    assert not empty.weights.any() and empty.facts["converged"]
    some = df.withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")))
    assert DualSVC(keyCol="id", maxIter=3).fit(some).duals.count() == 150


def test_a_model_out_of_rounds_says_so(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    model = DualSVR(C=100.0, maxIter=1, epochs=1).fit(table(spark, x, rng.normal(size=200)))
    assert not model.facts["converged"] and model.facts["gap"] > 0 and model.facts["rounds"] == 1


def test_benchmark_models_by_the_dual_solver(spark):
    from tidelab.ml.pipeline import build_estimator

    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 2))
    df = table(spark, x, (x[:, 0] > 0).astype(float))
    params = {"solver": "dual", "kernel": "linear", "C": 0.01}
    fits = [build_estimator("classification", "SVM", params, n_train=200).fit(df), build_estimator("regression", "SVR", params).fit(df)]
    assert all("prediction" in f.transform(df).columns for f in fits)


@pytest.mark.parametrize("kind", ["svc", "svr"])
def test_rounds_do_not_grow_with_the_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(dual, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 2))
    signal = x @ np.array([1.0, -0.5]) + 0.2 + rng.normal(size=4000)
    if kind == "svc":
        label = (signal > 0).astype(float)
        y, est, epsilon = 2 * label - 1, DualSVC(keyCol="id", tol=0.02, epochs=3, maxIter=40), None
    else:
        label = y = signal
        est, epsilon = DualSVR(keyCol="id", epsilon=0.2, tol=0.02, epochs=3, maxIter=40), 0.2
    model = est.fit(table(spark, x, label))
    assert model.facts["converged"] and model.facts["rounds"] < 40
    assert primal(model.weights, x, y, 1.0, epsilon) == pytest.approx(model.facts["primal"], rel=1e-9)
    a = {r["key"]: r["a"] for r in model.duals.collect()}
    assert len(a) == 4000 and all((0 if kind == "svc" else -1) <= v <= 1 for v in a.values())
    weight = np.array([a[i] * (y[i] if kind == "svc" else 1) for i in range(4000)])
    assert np.allclose(np.hstack([x, np.ones((4000, 1))]).T @ weight, model.weights, atol=1e-6)
