"""Model lab: splits, metrics against brute force, exact KNN, estimators on a planted signal,
benchmark persistence and experiment analytics over the saved logs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelab.ml.knn import knn_predict, knn_search
from tidelab.ml.metrics import class_report, classification_metrics, confusion_matrix, regression_metrics, roc_auc
from tidelab.ml.registry import default_models, merge_params, model_registry, normalise_kernel
from tidelab.ml.runner import benchmark, cross_validate, rank_runs, save_benchmark
from tidelab.ml.split import exact_split, hash_split, stratified_split
from tidelab.operators.experiments import experiment_details, leaderboard, list_experiments, metrics_long
from tidelab.plans.ranking import rank_within
from tidelab.sources.catalog import Catalog

SF001 = "/root/testdata/sf0.001"


def test_registry(spark):
    assert default_models("regression")[0] == "Linear Regression"
    assert merge_params("Ridge", {"alpha": 3}) == {"alpha": 3}
    assert merge_params("XGBoost", {"max_depth": 2})["n_estimators"] == 100
    assert normalise_kernel(0) == "linear" and normalise_kernel("RBF") == "rbf" and normalise_kernel(2) == "poly"
    assert model_registry(spark).count() == 12


def test_splits(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_orderstatus")
    n = o.count()
    hs = hash_split(o, "o_orderkey", 80).groupBy("is_train").count().collect()
    assert sum(r["count"] for r in hs) == n
    ex = exact_split(o, "o_orderkey", 75, 7)
    assert ex.where("is_train").count() == (n * 75) // 100
    st = stratified_split(o, "o_orderstatus", "o_orderkey", 80).groupBy("o_orderstatus").agg(
        F.count_if("is_train").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    for r in st:
        assert r["t"] == (r["n"] * 80) // 100
    # deterministic
    a = sorted(r[0] for r in hash_split(o, "o_orderkey", 80, 1).where("is_train").select("o_orderkey").collect())
    b = sorted(r[0] for r in hash_split(o, "o_orderkey", 80, 1).where("is_train").select("o_orderkey").collect())
    assert a == b


def test_rank_within_skewed(spark):
    # One group holds ~half the rows; ranks must equal a plain window's.
    df = spark.range(0, 5000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 7).alias("g"), "id",
                                     (F.col("id") * 7919 % 1000).alias("v"))
    got = rank_within(df, ["g"], [F.col("v").desc(), "id"]).select("g", "id", "_rank", "_group_n")
    from pyspark.sql.window import Window

    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    bad = got.join(ref, ["g", "id"]).where(F.col("_rank") != F.col("r")).count()
    assert bad == 0 and got.count() == 5000


def test_metrics_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)  # ties
    yh = (s > 0.5).astype(int)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(y, yh, s)], "label int, prediction int, score double")
    m = classification_metrics(df).collect()[0]
    tp = int(((y == 1) & (yh == 1)).sum()); fp = int(((y == 0) & (yh == 1)).sum()); fn = int(((y == 1) & (yh == 0)).sum())
    p, r = tp / (tp + fp), tp / (tp + fn)
    assert m["precision"] == pytest.approx(round(p, 4), abs=1e-4) and m["recall"] == pytest.approx(round(r, 4), abs=1e-4)
    assert m["f1"] == pytest.approx(2 * p * r / (p + r), abs=1e-4)
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert roc_auc(df).collect()[0]["roc_auc"] == pytest.approx(auc, abs=1e-4)
    cm = {r["label"]: (r["pred_0"], r["pred_1"]) for r in confusion_matrix(df, classes=[0, 1]).collect()}
    assert cm[1][1] == tp and cm[0][1] == fp
    rep = {r["class"]: r for r in class_report(df).collect()}
    assert rep[1]["support"] == int((y == 1).sum())
    w = classification_metrics(df, average="weighted").collect()[0]
    assert 0 <= w["f1"] <= 1 and w["accuracy"] == m["accuracy"]
    reg = spark.createDataFrame([(1.0, 1.5), (2.0, 1.0), (3.0, 3.5)], "label double, prediction double")
    rm = regression_metrics(reg).collect()[0]
    e = np.array([0.5, -1.0, 0.5])
    assert rm["rmse"] == pytest.approx(np.sqrt((e ** 2).mean()), abs=1e-4)
    assert rm["r2"] == pytest.approx(1 - (e ** 2).sum() / 2.0, abs=1e-4)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    X = np.round(rng.normal(size=(400, 5)), 1)
    X[10] = X[11]  # duplicate point
    Q = np.round(rng.normal(size=(60, 5)), 1)
    train = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, f array<double>")
    qs = spark.createDataFrame([(1000 + i, [float(v) for v in x]) for i, x in enumerate(Q)], "id long, f array<double>")
    got = knn_search(train, qs, k=4, features="f", block_bytes=7000).collect()
    res = {}
    for r in got:
        res.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"]))
    for i, q in enumerate(Q):
        d = np.sqrt(((X - q) ** 2).sum(axis=1))
        order = sorted(range(len(X)), key=lambda j: (d[j], j))[:4]
        assert [n for _, n in sorted(res[1000 + i])] == order


def test_knn_keeps_the_tables_off_the_driver(spark, monkeypatch):
    """Blocks and groups of a few rows each; no rows are collected while the plan is built."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    with monkeypatch.context() as m:
        m.setattr(type(df), "toArrow", lambda self: pytest.fail("a table on the driver"))
        found = knn_search(df, df, k=3, features="f", exclude_self=True, block_bytes=2000, group_bytes=2000)
    got = {(r["query_id"], r["rank"]): r["neighbor_id"] for r in found.collect()}
    far = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(len(x), np.inf))
    assert got == {(i, n + 1): int(j) for i in range(len(x)) for n, j in enumerate(np.argsort(far[i])[:3])}


@pytest.mark.parametrize("block_bytes", [1 << 20, 1000])
def test_knn_ties_go_by_id(spark, block_bytes):
    same = spark.createDataFrame([(i, [1.0, 2.0], i % 2) for i in range(200)], "id long, f array<double>, y int").repartition(7)
    ask = spark.createDataFrame([(0, [1.0, 2.0]), (500, [3.0, 2.0])], "id long, f array<double>")
    got = knn_search(same, ask, k=5, features="f", block_bytes=block_bytes, exclude_self=True).collect()
    near = {q: [r["neighbor_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 500)}
    assert near == {0: [1, 2, 3, 4, 5], 500: [0, 1, 2, 3, 4]}
    votes = {r["query_id"]: r["prediction"] for r in knn_predict(same, ask, k=4, features="f", label="y", block_bytes=block_bytes).collect()}
    assert votes == {0: 0, 500: 0}  # two against two: the smaller label


def _signal_frame(spark):
    rng = np.random.default_rng(2)
    x1, x2 = rng.normal(size=600), rng.normal(size=600)
    cat = rng.choice(["a", "b", "c"], 600)
    y = (x1 + 0.5 * x2 + (cat == "a") > 0.3).astype(int)
    yr = 3 * x1 - 2 * x2 + rng.normal(scale=0.1, size=600)
    return spark.createDataFrame([(float(a), float(b), str(c), int(d), float(e)) for a, b, c, d, e in zip(x1, x2, cat, y, yr)],
                                 "x1 double, x2 double, cat string, y int, yr double")


def test_models_beat_baseline(spark):
    df = _signal_frame(spark)
    cls = benchmark(df.drop("yr"), "y", "classification",
                    models=["Logistic Regression", "Naive Bayes", "Random Forest", "SVM", "KNN", "AdaBoost"],
                    params_by_model={"Random Forest": {"n_estimators": 10}, "AdaBoost": {"n_estimators": 10}})
    base = max(df.where("y = 1").count(), df.where("y = 0").count()) / df.count()
    for r in cls.runs:
        assert r.status == "completed", (r.model_name, r.error)
        assert r.metrics["accuracy"] > base, r.model_name
    reg = benchmark(df.drop("y"), "yr", "regression", models=["Linear Regression", "Ridge", "Lasso", "Decision Tree", "SVR"],
                    params_by_model={"Lasso": {"alpha": 0.01}, "SVR": {"kernel": "linear"}})
    for r in reg.runs:
        assert r.status == "completed", (r.model_name, r.error)
        assert r.metrics["r2"] > 0.5, (r.model_name, r.metrics)
    lin = {r.model_name: r.metrics["r2"] for r in reg.runs}
    assert lin["Linear Regression"] > 0.99


def test_failure_isolation_and_persistence(spark):
    df = _signal_frame(spark).drop("yr")
    res = benchmark(df, "y", "classification", models=["Logistic Regression", "No Such Model"])
    assert [r.status for r in res.ranking()] == ["completed", "failed"]
    cat = Catalog(spark)
    exp = save_benchmark(cat, res, dataset_id=1)
    runs = cat.log("model_runs").read()
    metrics = cat.log("metrics").read()
    lb = leaderboard(runs, metrics).orderBy("rank").collect()
    assert [r["model_name"] for r in lb] == ["Logistic Regression", "No Such Model"]
    ex = list_experiments(cat.log("experiments").read(), runs, metrics).collect()[0]
    assert ex["id"] == exp and ex["run_count"] == 2 and ex["failed_runs"] == 1 and ex["best_model"] == "Logistic Regression"
    det = experiment_details(runs, cat.log("model_configs").read(), metrics, cat.log("artifacts").read()).collect()
    assert {len(r["metrics"]) > 0 for r in det} == {True, False}
    assert metrics_long(runs, metrics).count() == metrics.count()
    ranked = rank_runs(res.runs_df(spark)).orderBy("rank").collect()
    assert ranked[0]["model_name"] == "Logistic Regression"


def test_cross_validate(spark):
    df = _signal_frame(spark).drop("yr")
    cv = cross_validate(df, "y", "Logistic Regression", "classification", folds=3).collect()
    assert len(cv) == 4 and all(r["score"] > 0.5 for r in cv)


def test_ridge_lasso_closed_form(spark):
    from pyspark.ml.feature import VectorAssembler

    from tidelab.ml.pipeline import build_estimator

    rng = np.random.default_rng(5)
    x = rng.normal(2.0, 1.5, 400)
    y = 3.0 * x + 1.0 + rng.normal(0, 0.5, 400)
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, label double"))
    n = len(x)
    xc, yc = x - x.mean(), y - y.mean()
    sxx, sxy = (xc * xc).sum(), (xc * yc).sum()
    alpha = 50.0
    ridge = build_estimator("regression", "Ridge", {"alpha": alpha}, n_train=n, label_std=float(np.std(y, ddof=1))).fit(df)
    assert ridge.coefficients[0] == pytest.approx(sxy / (sxx + alpha), rel=1e-4)
    lam = 0.3
    lasso = build_estimator("regression", "Lasso", {"alpha": lam}, n_train=n).fit(df)
    expected = np.sign(sxy / n) * max(abs(sxy / n) - lam, 0.0) / (sxx / n)
    assert lasso.coefficients[0] == pytest.approx(expected, rel=1e-3)


def test_tabular_features(spark):
    from tidelab.ml.features import TabularFeatures

    rows = [(1.0, "b", "x", True), (3.0, "a", "y", True), (None, "c", "x", True), (5.0, None, "y", True), (7.0, "z", "x", False)]
    df = spark.createDataFrame(rows, "v double, c string, y string, t boolean")
    m = TabularFeatures(featureCols=["v", "c"], labelCol="y", task="classification", trainCol="t").fit(df)
    out = {i: r for i, r in enumerate(m.transform(df).select("features", "label").collect())}
    vals = np.array([1.0, 3.0, 3.0, 5.0])  # training rows, null imputed with the mean 3
    sd = vals.std(ddof=1)
    # levels desc: c, b, a, __missing__ → index 3 (alphabetically first: "__missing__") is dropped
    assert m.levels["c"] == ["c", "b", "a", "__missing__"]
    f0 = out[0]["features"].toArray()
    assert f0[0] == pytest.approx((1.0 - 3.0) / sd) and list(f0[1:]) == [0.0, 1.0, 0.0]
    assert list(out[3]["features"].toArray()[1:]) == [0.0, 0.0, 0.0]  # missing → baseline
    assert list(out[4]["features"].toArray()[1:]) == [0.0, 0.0, 0.0]  # unseen "z" → baseline
    assert [out[i]["label"] for i in range(5)] == [0.0, 1.0, 0.0, 1.0, 0.0]


def test_tabular_features_hashes_wide_columns(spark):
    from tidelab.ml.features import TabularFeatures

    df = spark.range(0, 300).selectExpr("cast(id as string) as key", "cast(id % 3 as string) as small", "id % 2 as y")
    m = TabularFeatures(featureCols=["key", "small"], labelCol="y", task="classification", maxLevels=50, hashCols=["key"], hashFeatures=64).fit(df)
    with pytest.raises(ValueError, match="more than 50 levels"):
        TabularFeatures(featureCols=["key", "small"], labelCol="y", task="classification", maxLevels=50).fit(df)
    assert m.cat == ["small"] and m.hashed == ["key"]
    r = m.transform(df).select("features").first()["features"]
    assert r.size == 2 + 64  # one-hot of 3 levels minus the dropped one, plus hashed slots


def test_benchmark_data_hashes_columns_with_too_many_levels(spark):
    from tidelab.ml.runner import prepare_benchmark_data

    df = spark.range(0, 14_000).selectExpr("id", "cast(id as string) as key", "cast(id % 7 as double) as v", "cast(id % 2 as string) as y")
    with pytest.raises(ValueError, match="hash_cols"):
        prepare_benchmark_data(df, "y", ["key", "v"], "classification", key="id")
    train, _, stats = prepare_benchmark_data(df, "y", ["key", "v"], "classification", key="id", hash_cols=["key"])
    row = train.first()["features"]
    assert row.size == 1 + (1 << 18) and row.numNonzeros() <= 2 and stats["n_train"] + stats["n_test"] == 14_000


def test_leaderboard_is_a_permutation(spark):
    import __spark_entry__ as e

    lb = e.queries()["leaderboard"](spark, SF001)
    runs = spark.read.parquet(f"{SF001}/orders.parquet")
    assert lb.count() == runs.count()
    per = lb.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
                                          F.countDistinct("rank").alias("d"))
    assert per.where("lo != 1 OR hi != n OR d != n").count() == 0
    # usable runs come first inside each experiment
    from pyspark.sql.window import Window

    w = Window.partitionBy("experiment_id").orderBy("rank")
    bad = lb.withColumn("prev_ok", F.lag("ok").over(w)).where("prev_ok = 0 AND ok = 1").count()
    assert bad == 0


def test_benchmark_stratified(spark):
    df = _signal_frame(spark).drop("yr")
    res = benchmark(df, "y", "classification", models=["Naive Bayes"], stratify=True)
    n1 = df.where("y = 1").count()
    n0 = df.count() - n1
    assert res.train_rows == (n1 * 80) // 100 + (n0 * 80) // 100
    assert res.runs[0].status == "completed"


def test_adaboost_stumps(spark):
    from pyspark.ml.feature import VectorAssembler

    from tidelab.ml.custom import AdaBoostClassifier

    rng = np.random.default_rng(3)
    X = rng.uniform(-1, 1, size=(800, 2))
    y = ((X[:, 0] + X[:, 1]) > 0.1).astype(int)  # a diagonal boundary: many stumps needed
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(X, y)], "a double, b double, label int"))
    m1 = AdaBoostClassifier(numRounds=1).fit(df)
    m = AdaBoostClassifier(numRounds=40).fit(df)
    acc1 = m1.transform(df).where("prediction = label").count() / 800
    acc = m.transform(df).where("prediction = label").count() / 800
    assert len(m1.stumps) == 1 and acc1 < 0.8
    assert acc > 0.9 and len(m.stumps) > 3
