"""Second-order boosting against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelab.ml.boosting import SecondOrderBoosting, gradients


def grow_brute(x, g, h, thresholds, depth, reg, gamma, least, node=1):
    """Tree over all (feature, threshold, side of missing) by direct sums: {node: (j, t, missing left)}."""
    best = None
    if depth:
        for j, cuts in enumerate(thresholds):
            gone = np.isnan(x[:, j])
            for t in cuts:
                for left_gone in (True, False) if gone.any() else (False,):
                    left = np.where(gone, left_gone, x[:, j] <= t)
                    hl, hr = h[left].sum(), h[~left].sum()
                    if hl < least or hr < least or hl <= 0 or hr <= 0:
                        continue
                    gain = 0.5 * (g[left].sum() ** 2 / (hl + reg) + g[~left].sum() ** 2 / (hr + reg) - g.sum() ** 2 / (h.sum() + reg)) - gamma
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, j, t, left_gone, left)
    if best is None:
        return {}, {node: -g.sum() / (h.sum() + reg)}
    gain, j, t, left_gone, left = best
    splits, leaves = {node: (j, t, left_gone)}, {}
    for side, rows in ((2 * node, left), (2 * node + 1, ~left)):
        s, v = grow_brute(x[rows], g[rows], h[rows], thresholds, depth - 1, reg, gamma, least, side)
        splits |= s
        leaves |= v
    return splits, leaves


def table(spark, x, y):
    rows = [([None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "features array<double>, label double").repartition(3)


@pytest.mark.parametrize("loss", ["logistic", "softmax", "squared"])
def test_first_round_against_direct_sums(spark, loss):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 8, (240, 3)).astype(float)
    y = {"logistic": (x[:, 0] + rng.normal(size=240) > 4).astype(float), "softmax": np.digitize(x[:, 1] + x[:, 2], [5, 9]).astype(float),
         "squared": x[:, 0] * 2 + rng.integers(0, 3, 240)}[loss]
    x[rng.random((240, 3)) < 0.15] = np.nan
    cuts = [[0.0, 2.0, 3.0, 5.0, 6.0]] * 3
    model = SecondOrderBoosting(loss=loss, rounds=1, maxDepth=3, learningRate=1.0, gamma=0.01, minChildWeight=2.0, numClasses=3, thresholds=cuts).fit(table(spark, x, y))
    start = y.mean() if loss == "squared" else 0.0
    g, h = gradients(loss, np.full((240, 3 if loss == "softmax" else 1), start), y)
    for k, tree in enumerate(model.rounds[0]):
        splits, leaves = grow_brute(x, g[:, k], h[:, k], cuts, 3, 1.0, 0.01, 2.0)
        assert {n: (s[0], s[3], s[2]) for n, s in tree.splits.items()} == splits
        assert tree.leaves.keys() == leaves.keys() and np.allclose([tree.leaves[n] for n in leaves], list(leaves.values()))


def test_missing_values_go_where_they_gain(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] > 0).astype(float)
    x[y == 1, 0] = np.where(rng.random((y == 1).sum()) < 0.5, np.nan, x[y == 1, 0])  # only high values are missing
    df = table(spark, x, y)
    model = SecondOrderBoosting(rounds=5, maxDepth=2).fit(df)
    assert model.rounds[0][0].splits[1][2] is False
    assert model.transform(df).where(F.col("prediction") == F.col("label")).count() >= 392  # thresholds are approximate quantiles


def test_refreshed_margins_equal_recomputed_ones(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = np.digitize(x[:, 0] + 0.3 * rng.normal(size=300), [-0.5, 0.5]).astype(float)
    df = table(spark, x, y)
    est = SecondOrderBoosting(loss="softmax", numClasses=3, rounds=5, maxDepth=2)
    once = est.fit(df)
    est.REFRESH = 2
    often = est.fit(df)
    for a, b in zip(once.rounds, often.rounds, strict=True):
        for s, t in zip(a, b, strict=True):
            assert s.splits.keys() == t.splits.keys() and np.allclose(list(s.leaves.values()), list(t.leaves.values()))
    got = once.transform(df).select("label", "prediction", "probability").toPandas()
    assert (got["label"] == got["prediction"]).mean() > 0.85
    assert np.allclose([p.toArray().sum() for p in got["probability"]], 1)


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], "features array<double>, label double")
    assert SecondOrderBoosting(rounds=2).fit(empty).rounds == []
    one = spark.createDataFrame([([1.0], 1.0), ([1.0], 0.0), (None, 1.0), ([None], 0.0), ([2.0], None)], "features array<double>, label double")
    assert SecondOrderBoosting(rounds=2, minChildWeight=0.0).fit(one).transform(one).count() == 5
    ragged = spark.createDataFrame([([1.0], 1.0), ([1.0, 2.0], 0.0)], "features array<double>, label double")
    with pytest.raises(ValueError):
        SecondOrderBoosting().fit(ragged)
