"""Cross-validation from additive sums: equal to refitting each fold, whatever the partitions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelab.ml.folds import cross_validate_linear, lasso_from_products
from tidelab.ml.runner import cross_validate


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        a = None if i % 11 == 0 else float(1e6 + rng.normal())
        b = float(rng.normal()) * 3
        c = [None, "x", "y", "z"][i % 4] if i % 60 else "rare"
        y = 2 * ((a or 1e6) - 1e6) - b + {"x": 1.0, "y": 5.0}.get(c, 0.0) + float(rng.normal()) * 0.3
        rows.append((i, a, b, c, y))
    return rows


SCHEMA = "id long, a double, b double, c string, y double"


def refit(rows, model, alpha, folds):
    """Plain refits, fold by fold."""
    fold = lambda i: int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:15], 16) % folds
    out = {}
    for k in range(folds):
        train = [r for r in rows if fold(r[0]) != k]
        test = [r for r in rows if fold(r[0]) == k]
        mean = [np.mean([r[j] for r in train if r[j] is not None]) for j in (1, 2)]
        sd = [np.std([mean[j - 1] if r[j] is None else r[j] for r in train], ddof=1) for j in (1, 2)]
        levels = sorted({r[3] or "__missing__" for r in train})[1:]

        def block(part):
            return np.array([[((mean[j - 1] if r[j] is None else r[j]) - mean[j - 1]) / sd[j - 1] for j in (1, 2)]
                             + [float((r[3] or "__missing__") == lv) for lv in levels] for r in part])

        x, y = block(train), np.array([r[4] for r in train])
        xm, ym = x.mean(0), y.mean()
        g, c = (x - xm).T @ (x - xm), (x - xm).T @ (y - ym)
        w = np.linalg.solve(g + (alpha if model == "Ridge" else 0) * np.eye(len(c)), c)
        yt = np.array([r[4] for r in test])
        sse = ((yt - ym - (block(test) - xm) @ w) ** 2).sum()
        out[k] = (len(train), len(test), sse / len(test), 1 - sse / ((yt - yt.mean()) ** 2).sum())
    return out


@pytest.mark.parametrize("model,alphas", [("Linear Regression", [0.0]), ("Ridge", [0.5, 40.0])])
def test_equals_refitting(spark, table, model, alphas):
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    got = cross_validate_linear(df, "y", model, alphas, folds=3, key="id").collect()
    for a in alphas:
        want = refit(table, model, a, 3)
        for k in range(3):
            r = next(r for r in got if r["fold"] == k and r["alpha"] == a)
            assert (r["n_train"], r["n_test"]) == want[k][:2]
            assert r["mse"] == pytest.approx(want[k][2], rel=1e-6) and r["r2"] == pytest.approx(want[k][3], rel=1e-6)
        mean = next(r for r in got if r["fold"] == -1 and r["alpha"] == a)
        assert mean["r2"] == pytest.approx(np.mean([want[k][3] for k in range(3)]))


def test_lasso_equals_the_models_own_fits(spark, table):
    df = spark.createDataFrame(table, SCHEMA)
    got = {r["fold"]: r["r2"] for r in cross_validate_linear(df, "y", "Lasso", [0.2], folds=2, key="id").collect()}
    want = cross_validate(df, "y", "Lasso", "regression", folds=2, params={"alpha": 0.2}, key="id").collect()
    for r in want:
        assert got[r["fold"]] == pytest.approx(r["score"], abs=1e-3)


def test_lasso_optimality():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    g, c = x.T @ x / 60, x.T @ (x @ np.array([3, -2, 0, 0, 0.1, 0, 0, 1.0])) / 60
    w = lasso_from_products(g, c, 0.3)
    slope = c - g @ w
    assert np.all(np.abs(slope) <= 0.3 + 1e-9) and np.allclose(slope[w != 0], 0.3 * np.sign(w[w != 0]))
    assert not lasso_from_products(g, c, 1e9).any()


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows = cross_validate_linear(empty, "y", "Ridge", [1.0], folds=2, key="id").collect()
    assert [(r["fold"], r["n_test"], r["r2"]) for r in rows] == [(0, 0, None), (1, 0, None), (-1, 0, None)]
    odd = spark.createDataFrame(
        [(None, float("nan"), 1.0, "q", 1.0), (1, float("inf"), 1.0, "q", 2.0), (2, 3.0, None, None, None),
         (3, None, 1.0, "q", float("nan")), *[(i, 1.0, float(i), "q", 2.0 * i) for i in range(4, 30)]], SCHEMA)
    rows = cross_validate_linear(odd, "y", "Linear Regression", folds=2, key="id").where("fold >= 0").collect()
    assert sum(r["n_test"] for r in rows) == 28 and all(np.isfinite(r["mse"]) for r in rows)
    with pytest.raises(ValueError, match="does not follow"):
        cross_validate_linear(odd, "y", "SVR")
    many = odd.withColumn("c", F.col("id").cast("string"))
    with pytest.raises(ValueError, match="levels"):
        cross_validate_linear(many, "y", key="id", max_levels=5)
