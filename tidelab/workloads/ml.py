"""Model-lab workloads (G15, G16, G25–G29, G33) with exact oracles, and model runs (rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelab.functions.hashing import fnv1a_unit
from tidelab.ml.split import exact_split, hash_split, split_threshold, stratified_split
from tidelab.session import read_table
from tidelab.workloads import register

_MD5 = "('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 15))::BIGINT"


@register(
    "stable_noise",
    """
SELECT o_orderkey,
       list_reduce(list_transform(string_split(o_orderpriority || '|' || CAST(o_orderkey AS VARCHAR), ''),
                                  lambda c: ascii(c)::BIGINT),
                   lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) / 4294967295.0 AS noise
FROM orders""",
)
def stable_noise_q(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", fnv1a_unit("o_orderpriority", "o_orderkey").alias("noise"))


@register(
    "hash_split",
    f"SELECT o_orderkey, {_MD5.format(seed=42, key='o_orderkey')} < {split_threshold(80)} AS is_train FROM orders",
)
def hash_split_q(spark, sf_dir):
    return hash_split(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 80, 42)


@register(
    "exact_split",
    f"""
SELECT o_orderkey,
       row_number() OVER (ORDER BY {_MD5.format(seed=7, key='o_orderkey')}, o_orderkey)
         <= floor(count(*) OVER () * 7500 / 10000) AS is_train
FROM orders""",
)
def exact_split_q(spark, sf_dir):
    return exact_split(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 75, 7)


@register(
    "stratified_split",
    f"""
SELECT o_orderkey, o_orderstatus,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5.format(seed=42, key='o_orderkey')}, o_orderkey)
         <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 8000 / 10000) AS is_train
FROM orders""",
)
def stratified_split_q(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return stratified_split(o, "o_orderstatus", "o_orderkey", 80, 42)


from tidelab.ml.metrics import class_report, classification_metrics, confusion_matrix, regression_metrics, roc_auc  # noqa: E402

_CLS_SQL = """SELECT l.doc_id, l.quality AS label, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS prediction,
       d.n_chars / (d.n_chars + 1000.0) AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def _cls_pred(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("label"),
        F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("prediction"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score"),
    )


def _r4(x):
    return f"ROUND(({x}) * 10000) / 10000"


@register(
    "metrics_classification",
    f"""
WITH p AS ({_CLS_SQL}),
c AS (SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label <> 1 AND prediction = 1) AS fp,
             count_if(label = 1 AND prediction <> 1) AS fn, count_if(label <> 1 AND prediction <> 1) AS tn FROM p),
m AS (SELECT tp, fp, fn, tn,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS pr,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rc FROM c)
SELECT {_r4("CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END")} AS accuracy,
       {_r4("pr")} AS precision, {_r4("rc")} AS recall,
       {_r4("CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2.0 * pr * rc / (pr + rc) END")} AS f1,
       {_r4("CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2.0 * pr * rc / (pr + rc) END")} AS score
FROM m""",
)
def metrics_classification_q(spark, sf_dir):
    return classification_metrics(_cls_pred(spark, sf_dir))


@register(
    "roc_auc",
    f"""
WITH p AS ({_CLS_SQL}),
r AS (SELECT label, rank() OVER (ORDER BY score) AS rk, count(*) OVER (PARTITION BY score) AS ties FROM p),
t AS (SELECT sum(CASE WHEN label = 1 THEN rk + (ties - 1) / 2.0 ELSE 0 END) AS rsum,
             count_if(label = 1) AS np, count_if(label <> 1) AS nn FROM r)
SELECT CASE WHEN np = 0 OR nn = 0 THEN NULL ELSE {_r4("(rsum - np * (np + 1) / 2.0) / (np * nn)")} END AS roc_auc FROM t""",
)
def roc_auc_q(spark, sf_dir):
    return roc_auc(_cls_pred(spark, sf_dir))


@register(
    "confusion_matrix",
    f"""
WITH p AS ({_CLS_SQL})
SELECT label, CAST(count_if(prediction = 0) AS BIGINT) AS pred_0, CAST(count_if(prediction = 1) AS BIGINT) AS pred_1
FROM p GROUP BY label""",
)
def confusion_matrix_q(spark, sf_dir):
    return confusion_matrix(_cls_pred(spark, sf_dir), classes=[0, 1])


@register(
    "class_report",
    f"""
WITH p AS ({_CLS_SQL}),
bl AS (SELECT label AS class, count(*) AS support, count_if(label = prediction) AS tp FROM p GROUP BY label),
bp AS (SELECT prediction AS class, count(*) AS predicted FROM p GROUP BY prediction),
j AS (SELECT COALESCE(bl.class, bp.class) AS class, COALESCE(support, 0) AS support, COALESCE(tp, 0) AS tp,
             COALESCE(predicted, 0) AS predicted FROM bl FULL OUTER JOIN bp ON bl.class = bp.class),
m AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS pr,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM j)
SELECT class, {_r4("pr")} AS precision, {_r4("rc")} AS recall,
       {_r4("CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2.0 * pr * rc / (pr + rc) END")} AS f1, support FROM m""",
)
def class_report_q(spark, sf_dir):
    return class_report(_cls_pred(spark, sf_dir))


@register(
    "metrics_regression",
    f"""
WITH p AS (SELECT l_extendedprice AS label, l_quantity * 1500.0 AS prediction FROM lineitem),
a AS (SELECT avg((prediction - label) * (prediction - label)) AS mse, avg(abs(prediction - label)) AS mae,
             sum((prediction - label) * (prediction - label)) AS sse, var_pop(label) * count(*) AS sst FROM p)
SELECT {_r4("sqrt(mse)")} AS rmse, {_r4("mae")} AS mae,
       {_r4("CASE WHEN sst = 0 THEN 0.0 ELSE 1.0 - sse / sst END")} AS r2,
       {_r4("CASE WHEN sst = 0 THEN 0.0 ELSE 1.0 - sse / sst END")} AS score FROM a""",
)
def metrics_regression_q(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return regression_metrics(li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction")))


from tidelab.ml.knn import knn_predict  # noqa: E402


@register(
    "knn_exact",
    """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.vec_id AS q, b.vec_id AS n, b.label AS label, list_distance(a.v, b.v) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY dist, n) AS rk FROM d),
v AS (SELECT q, label, count(*) AS c FROM r WHERE rk <= 5 GROUP BY q, label),
m AS (SELECT q, label, c, max(c) OVER (PARTITION BY q) AS mc FROM v)
SELECT q AS query_id, min(label) AS prediction FROM m WHERE c = mc GROUP BY q""",
)
def knn_exact_q(spark, sf_dir):
    """Leave-one-out 5-NN label vote over all embeddings."""
    e = read_table(spark, sf_dir, "embeddings")
    return knn_predict(e, e, k=5, train_id="vec_id", query_id="vec_id", features="embedding", label="label",
                       exclude_self=True)


from tidelab.ml.pipeline import build_estimator  # noqa: E402
from tidelab.ml.runner import benchmark, cross_validate  # noqa: E402

# One frame per task, with signal: the label follows from the features, so a fit that does not beat
# the baseline by far is broken. Rows are split by the md5 of the customer key, which DuckDB has too.
_FRAME_SQL = """SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment,
       CASE WHEN c_acctbal + 200 * c_nationkey > 6500 THEN 1 ELSE 0 END AS rich,
       0.5 * c_acctbal + 100 * c_nationkey AS worth FROM customer"""
_TARGETS = {"classification": "rich", "regression": "worth"}


def _customer_frame(spark, sf_dir, task: str):
    c = read_table(spark, sf_dir, "customer")
    rich = F.when(F.col("c_acctbal") + 200 * F.col("c_nationkey") > 6500, 1).otherwise(0)
    worth = 0.5 * F.col("c_acctbal") + 100 * F.col("c_nationkey")
    target = rich.alias("rich") if task == "classification" else worth.alias("worth")
    return c.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", target)


def _clearly_better(task: str, metrics: dict, majority: float) -> bool:
    """Far above the baseline: half of what the majority class leaves, or half of the variance."""
    return metrics["accuracy"] >= (1 + majority) / 2 if task == "classification" else metrics["r2"] >= 0.5


def _facts_sql(model: str, task: str) -> str:
    majority = "ROUND(GREATEST(AVG(rich), 1 - AVG(rich)) * 10000) / 10000" if task == "classification" else "0.0"
    return f"""
WITH f AS ({_FRAME_SQL}),
s AS (SELECT *, {_MD5.format(seed=42, key='c_custkey')} < {split_threshold(80)} AS is_train FROM f)
SELECT '{model}' AS model_name, 'completed' AS status, count_if(is_train)::BIGINT AS n_train, count_if(NOT is_train)::BIGINT AS n_test,
       (SELECT CAST(max(b) AS DOUBLE) FROM (SELECT {majority} AS b FROM s WHERE NOT is_train)) AS baseline, TRUE AS clearly_better FROM s"""


def _model_workload(key: str, model: str, task: str, params: dict | None = None):
    def run(spark, sf_dir):
        frame, target = _customer_frame(spark, sf_dir, task), _TARGETS[task]
        res = benchmark(frame, target, task, [model], {model: params or {}}, key="c_custkey")
        got = res.runs[0]
        if got.status != "completed":
            raise RuntimeError(f"{model}: {got.error}")
        baseline = 0.0
        if task == "classification":
            share = hash_split(frame, "c_custkey", 80, 42).where(~F.col("is_train")).agg(F.avg("rich").alias("p")).first()["p"]
            baseline = int(max(share, 1 - share) * 10000 + 0.5) / 10000
        row = (model, got.status, res.train_rows, res.test_rows, baseline, _clearly_better(task, got.metrics, baseline))
        return spark.createDataFrame(
            [row], "model_name string, status string, n_train long, n_test long, baseline double, clearly_better boolean"
        )

    run.__name__ = key
    register(key, _facts_sql(model, task))(run)


for _key, _model, _task, _params in [
    ("model_linear_regression", "Linear Regression", "regression", None),
    ("model_ridge", "Ridge", "regression", None),
    ("model_lasso", "Lasso", "regression", None),
    ("model_svr", "SVR", "regression", {"C": 1000.0}),
    ("model_decision_tree", "Decision Tree", "regression", None),
    ("model_logistic_regression", "Logistic Regression", "classification", None),
    ("model_knn", "KNN", "classification", None),
    ("model_svm_linear", "SVM", "classification", {"kernel": 0}),
    ("model_svm_rbf", "SVM", "classification", {"kernel": "rbf"}),
    ("model_svm_poly", "SVM", "classification", {"kernel": 2}),
    ("model_naive_bayes", "Naive Bayes", "classification", None),
    ("model_random_forest", "Random Forest", "classification", None),
    ("model_gradient_boosting", "XGBoost", "classification", {"n_estimators": 20}),
    ("model_adaboost", "AdaBoost", "classification", None),
]:
    _model_workload(_key, _model, _task, _params)


@register(
    "cross_validate",
    f"""
WITH f AS ({_FRAME_SQL}), s AS (SELECT *, {_MD5.format(seed=42, key='c_custkey')} % 3 AS fold FROM f)
SELECT CAST(fold AS INTEGER) AS fold, 'completed' AS status, (SELECT count(*) FROM s) - count(*) AS n_train, count(*) AS n_test,
       TRUE AS clearly_better FROM s GROUP BY fold""",
)
def cross_validate_q(spark, sf_dir):
    frame = _customer_frame(spark, sf_dir, "classification")
    folds = cross_validate(frame, "rich", "Logistic Regression", "classification", folds=3, key="c_custkey").where("fold >= 0")
    return folds.select("fold", "status", "n_train", "n_test", (F.col("score") > 0.9).alias("clearly_better"))


def _one_feature_sql(slope: str) -> str:
    return f"""
WITH a AS (SELECT regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_sxx(l_extendedprice, l_quantity) AS sxx,
                  avg(l_extendedprice) AS my, avg(l_quantity) AS mx, count(*) AS n FROM lineitem),
b AS (SELECT {slope} AS w, my, mx FROM a)
SELECT ROUND(w * 10) / 10 AS slope, ROUND((my - w * mx) * 10) / 10 AS intercept FROM b"""


def _one_feature(spark, sf_dir, model: str, params: dict | None = None):
    """One-feature fit through ``build_estimator`` against its closed form."""
    from pyspark.ml.feature import VectorAssembler

    from tidelab.functions.text import round_value

    li = read_table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li).select("features", "label")
    st = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("label").alias("sd")).first()
    m = build_estimator("regression", model, params, n_train=st["n"], label_std=st["sd"]).fit(data)
    row = spark.range(1).select(F.lit(float(m.coefficients[0])).alias("slope"), F.lit(float(m.intercept)).alias("intercept"))
    return row.select(round_value(F.col("slope"), 1).alias("slope"), round_value(F.col("intercept"), 1).alias("intercept"))


@register("linreg_1d", _one_feature_sql("sxy / sxx"))
def linreg_1d_q(spark, sf_dir):
    return _one_feature(spark, sf_dir, "Linear Regression")


@register("ridge_1d", _one_feature_sql("sxy / (sxx + 500000)"))
def ridge_1d_q(spark, sf_dir):
    return _one_feature(spark, sf_dir, "Ridge", {"alpha": 500000})


@register("lasso_1d", _one_feature_sql("sign(sxy) * greatest(abs(sxy) / n - 20, 0) / (sxx / n)"))
def lasso_1d_q(spark, sf_dir):
    return _one_feature(spark, sf_dir, "Lasso", {"alpha": 20})


_MULTI_SQL = """SELECT o_orderpriority AS label,
       CASE WHEN o_totalprice >= 300000 THEN '1-URGENT' WHEN o_totalprice >= 200000 THEN '2-HIGH'
            WHEN o_totalprice >= 100000 THEN '3-MEDIUM' ELSE '5-LOW' END AS prediction FROM orders"""


def _multi_pred(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    pred = (F.when(p >= 300000, "1-URGENT").when(p >= 200000, "2-HIGH").when(p >= 100000, "3-MEDIUM").otherwise("5-LOW"))
    return o.select(F.col("o_orderpriority").alias("label"), pred.alias("prediction"))


@register(
    "metrics_multiclass",
    f"""
WITH p AS ({_MULTI_SQL}),
bl AS (SELECT label AS class, count(*) AS support, count_if(label = prediction) AS tp FROM p GROUP BY label),
bp AS (SELECT prediction AS class, count(*) AS predicted FROM p GROUP BY prediction),
j AS (SELECT COALESCE(bl.class, bp.class) AS class, COALESCE(support, 0) AS support, COALESCE(tp, 0) AS tp,
             COALESCE(predicted, 0) AS predicted FROM bl FULL OUTER JOIN bp ON bl.class = bp.class),
m AS (SELECT support, tp, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS pr,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc FROM j),
f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2.0 * pr * rc / (pr + rc) END AS f1 FROM m)
SELECT {_r4("sum(tp) / sum(support)")} AS accuracy,
       {_r4("sum(pr * support) / sum(support)")} AS precision,
       {_r4("sum(rc * support) / sum(support)")} AS recall,
       {_r4("sum(f1 * support) / sum(support)")} AS f1,
       {_r4("sum(f1 * support) / sum(support)")} AS score
FROM f""",
)
def metrics_multiclass_q(spark, sf_dir):
    """Support-weighted multi-class metrics (5 order priorities predicted from the price)."""
    return classification_metrics(_multi_pred(spark, sf_dir), average="weighted")
