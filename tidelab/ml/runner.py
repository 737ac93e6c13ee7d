"""Training and benchmarking.

A benchmark splits once (hash split on a content key), fits the preprocessing on the training rows,
writes the prepared train/test frames as Parquet into the shared checkpoint folder (one lineage cut; every
model then reads the same frozen rows, and a lost executor re-reads the checkpoint instead of
recomputing the split), and fits each model in turn. A failing model becomes a ``failed`` run and
the rest continue. Metrics are Spark aggregates; the only driver-side data are the per-run metric
values (a handful of numbers per model).
"""

from __future__ import annotations

import datetime as dt
import json
import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelab.functions.hashing import md5_key
from tidelab.ml.knn import knn_predict, votes
from tidelab.ml.metrics import class_report, classification_metrics, confusion_long, regression_metrics, roc_auc
from tidelab.ml.neighbours import indexed_hits
from tidelab.ml.pipeline import build_estimator, build_preprocessing
from tidelab.ml.split import hash_split, stratified_split
from tidelab.ml.registry import default_models, merge_params, normalise_kernel
from tidelab.sources.catalog import now
from tidelab.operators.schema import infer_problem_type
from tidelab.session import materialize

RUN_SCHEMA = "run_id long, model_name string, status string, duration_ms long, error_message string, score double, rank int, params_json string"


@dataclass
class RunResult:
    model_name: str
    status: str
    params: dict
    metrics: dict = field(default_factory=dict)
    duration_ms: int = 0
    error: str | None = None
    predictions: DataFrame | None = None

    @property
    def score(self):
        return self.metrics.get("score")


@dataclass
class BenchmarkResult:
    task: str
    target: str
    features: list[str]
    train_split: float
    random_state: int
    train_rows: int
    test_rows: int
    runs: list[RunResult]

    def ranking(self) -> list[RunResult]:
        """Score descending, failed runs and runs without a score last."""
        ok = [r for r in self.runs if r.status != "failed" and r.score is not None]
        bad = [r for r in self.runs if not (r.status != "failed" and r.score is not None)]
        return sorted(ok, key=lambda r: -r.score) + bad

    def runs_df(self, spark) -> DataFrame:
        ranked = {id(r): i + 1 for i, r in enumerate(self.ranking())}
        rows = [(i + 1, r.model_name, r.status, r.duration_ms, r.error, r.score, ranked[id(r)], json.dumps(r.params, sort_keys=True))
                for i, r in enumerate(self.runs)]
        return spark.createDataFrame(rows, RUN_SCHEMA)

    def metrics_df(self, spark) -> DataFrame:
        rows = [(i + 1, k, float(v)) for i, r in enumerate(self.runs) for k, v in r.metrics.items() if v is not None]
        return spark.createDataFrame(rows, "run_id long, metric_name string, metric_value double")


def content_key(df: DataFrame, columns: list[str]) -> F.Column:
    """Deterministic per-row key from the row's values (identical rows share a split side)."""
    return F.xxhash64(*[F.col(c) for c in columns])


def _evaluate(pred: DataFrame, task: str, num_classes: int, has_score: bool) -> dict:
    if task == "regression":
        return regression_metrics(pred).collect()[0].asDict()
    avg = "binary" if num_classes <= 2 else "weighted"
    m = classification_metrics(pred, average=avg).collect()[0].asDict()
    if has_score and num_classes <= 2:
        m["roc_auc"] = roc_auc(pred, score="_score").collect()[0]["roc_auc"]
    return m


def _with_score(pred: DataFrame) -> tuple[DataFrame, bool]:
    for col in ("probability", "rawPrediction"):
        if col in pred.columns:
            from pyspark.ml.functions import vector_to_array

            arr = vector_to_array(F.col(col))
            return pred.withColumn("_score", F.when(F.size(arr) > 1, arr[1]).otherwise(arr[0])), True
    return pred, False


def prepare_benchmark_data(df: DataFrame, target: str, features: list[str], task: str, train_split: float = 80,
                           random_state: int = 42, stratify: bool = False, key: str | None = None,
                           hash_cols: list[str] | None = None):
    """Split, fit preprocessing on train, return materialised (train, test, stats).

    Feature statistics take one pass over the training rows; the transformed frame is written once
    as Parquet into the shared checkpoint folder, so every model reads the same frozen rows and a
    lost executor re-reads files instead of refitting anything."""
    labelled = df.where(F.col(target).isNotNull())
    labelled = labelled.withColumn("_key", F.col(key) if key else content_key(labelled, features + [target]))
    if stratify and task == "classification":
        # Exact per-class shares (skew-safe ranking; its result is already materialised).
        keyed = stratified_split(labelled, target, "_key", train_split, random_state).withColumnRenamed("is_train", "_is_train")
    else:
        keyed = hash_split(labelled, "_key", train_split, random_state).withColumnRenamed("is_train", "_is_train")
    # One statistics pass (training rows; label classes over all rows), then one transform pass.
    pre = build_preprocessing(keyed, features, target, task, "_is_train", hash_cols).fit(keyed)
    prepared = materialize(
        pre.transform(keyed).select("features", "label", "_is_train", "_key").withColumn("_rid", F.monotonically_increasing_id()),
        "benchmark-data",
    )
    stats = prepared.agg(
        F.count_if("_is_train").alias("n_train"), F.count_if(~F.col("_is_train")).alias("n_test"),
        F.stddev_samp(F.when(F.col("_is_train"), F.col("label"))).alias("std"),
        F.max("label").alias("max_label"),
    ).collect()[0]
    train = dealt(prepared.where("_is_train").drop("_is_train"), stats["n_train"])
    test = dealt(prepared.where(~F.col("_is_train")).drop("_is_train"), stats["n_test"])
    return train, test, stats


PART_ROWS = 1 << 15
#: Distances above which neighbours are found through the index, and features up to which it is built.
MOST_DISTANCES = 1_000_000_000
INDEX_WIDTH = 512


def neighbour_predictions(train: DataFrame, test: DataFrame, k: int, task: str, pairs: int) -> DataFrame:
    """``(query_id, prediction)`` by the ``k`` nearest training rows, ties by the key, which does not change with
    the partitioning. Both ways are exact; the index scores the rows in cells near a query alone."""
    first = train.select("features").first()
    if pairs <= MOST_DISTANCES or first is None or first["features"].size > INDEX_WIDTH:
        return knn_predict(train, test, k=k, train_id="_key", query_id="_rid", features="features", label="label", task=task)
    hits = indexed_hits(train, test, k, "_key", "_rid", "features", "label")
    return votes(hits, task, train.schema["label"].dataType)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions of about ``PART_ROWS`` rows. Files of few bytes are read as one partition however
    many rows they hold, and kernel features, cached blocks or trees' points of a row are far larger than its
    bytes there."""
    parts = -(-int(rows) // PART_ROWS)
    return df.repartition(parts) if parts > 1 else df


MOST_TERMS = 200_000  # of a polynomial expansion


def refuse_wide_expansion(name: str, params: dict, train: DataFrame) -> None:
    """A polynomial kernel expands d features to (d + degree choose degree) terms a row."""
    if name != "SVM" or normalise_kernel(params.get("kernel")) != "poly":
        return
    first = train.select("features").first()
    degree = int(params.get("degree", 3))
    if first and math.comb(first["features"].size + degree, degree) > MOST_TERMS:
        raise ValueError(f"degree {degree} over {first['features'].size} features: more than {MOST_TERMS} terms a row")


def failure_text(e: Exception) -> str:
    """What went wrong, in one line: the error's type and the last line of each cause that says
    something (a worker's traceback ends with the error itself)."""
    said = [x.strip() for x in str(e).splitlines() if x.strip() and not x.lstrip().startswith(("at ", "File ", "Traceback", "JVM stacktrace"))]
    lines = said[:1] + [x for x in said[1:] if "Error" in x or "Exception" in x][-1:]
    return f"{type(e).__name__}: {' | '.join(lines)}"[:1000]


def run_model(name: str, task: str, params: dict | None, train: DataFrame, test: DataFrame, stats) -> RunResult:
    merged = merge_params(name, params)
    num_classes = int(stats["max_label"] or 0) + 1 if task == "classification" else 0
    t0 = time.time()
    try:
        if name == "KNN":
            test_rows = test.count()
            nb = neighbour_predictions(train, test, int(merged.get("n_neighbors", 5)), task, int(stats["n_train"]) * test_rows)
            nb = materialize(nb, "neighbours")  # asked for by every metric
            pred = test.join(nb.withColumnRenamed("query_id", "_rid"), "_rid", "left")
            if pred.where(F.col("prediction").isNull()).limit(1).count():
                raise ValueError("test rows without a neighbour: the training split is empty")
            pred = pred.withColumn("prediction", F.col("prediction").cast("double"))
            has_score = False
        else:
            refuse_wide_expansion(name, merged, train)
            est = build_estimator(task, name, merged, n_train=stats["n_train"], label_std=stats["std"] or 1.0, num_classes=num_classes)
            model = est.fit(train)
            pred, has_score = _with_score(model.transform(test))
        metrics = _evaluate(pred, task, num_classes, has_score)
        status, err = "completed", None
    except Exception as e:  # noqa: BLE001 - failure isolation: the run is recorded as failed
        pred, metrics, status, err = None, {}, "failed", failure_text(e)
    return RunResult(name, status, merged, metrics, int((time.time() - t0) * 1000), err, pred)


def benchmark(
    df: DataFrame,
    target: str,
    task: str | None = None,
    models: list[str] | None = None,
    params_by_model: dict | None = None,
    features: list[str] | None = None,
    train_split: float = 80,
    random_state: int = 42,
    stratify: bool = False,
    key: str | None = None,
    hash_cols: list[str] | None = None,
) -> BenchmarkResult:
    """Fit and score every model of the task (or the given list) on one shared split
    (``stratify=True``: exact per-class train shares for classification). The split goes by the
    integer column ``key``, which is no feature then, or else by the rows' content. Columns with more
    levels than one-hot encoding takes are named in ``hash_cols``."""
    task = task or infer_problem_type(df, target)
    features = features or [c for c in df.columns if c not in (target, key)]
    train, test, stats = prepare_benchmark_data(df, target, features, task, train_split, random_state, stratify, key, hash_cols)
    runs = [run_model(m, task, (params_by_model or {}).get(m), train, test, stats) for m in (models or default_models(task))]
    return BenchmarkResult(task, target, features, train_split, random_state, int(stats["n_train"]), int(stats["n_test"]), runs)


def resolve_inputs(catalog, dataset_id: int, target: str | None = None, features: list[str] | None = None,
                   task: str | None = None) -> tuple[DataFrame, str, list[str], str]:
    """(G19, G20) target: request → latest preparation → dataset → last column; features: request →
    latest preparation (selected and derived) → every non-target column; task: request → profile rule."""
    df = catalog.load(dataset_id)
    meta = catalog.dataset(dataset_id) or {}
    prep = catalog.latest_preparation(dataset_id)
    tgt = target or (prep or {}).get("target_column") or meta.get("target_column") or df.columns[-1]
    if tgt not in df.columns:
        raise ValueError(f"target {tgt!r} not in dataset {dataset_id}")
    feats = features
    if not feats and prep and prep.get("dataset_id") == dataset_id:
        try:
            feats = [f for f in json.loads(prep.get("selected_features_json") or "[]") if f in df.columns]
        except ValueError:
            feats = None
    feats = feats or [c for c in df.columns if c != tgt]
    return df, tgt, feats, task or infer_problem_type(df, tgt)


def train(df: DataFrame, target: str, model: str, task: str | None = None, params: dict | None = None, **kwargs) -> BenchmarkResult:
    """Train one model (a one-model benchmark)."""
    return benchmark(df, target, task, [model], {model: params or {}}, **kwargs)


def cross_validate(df: DataFrame, target: str, model: str, task: str | None = None, folds: int = 3,
                   params: dict | None = None, features: list[str] | None = None, seed: int = 42,
                   key: str | None = None, hash_cols: list[str] | None = None) -> DataFrame:
    """k-fold CV; a row's fold is the md5 of its key (the column ``key``, else its content) modulo
    ``folds``. One row per fold with its counts and scores, plus the mean (``fold = -1``)."""
    spark = df.sparkSession
    task = task or infer_problem_type(df, target)
    features = features or [c for c in df.columns if c not in (target, key)]
    labelled = df.where(F.col(target).isNotNull())
    labelled = labelled.withColumn("_key", F.col(key) if key else content_key(labelled, features + [target]))
    keyed = materialize(labelled.withColumn("_fold", F.pmod(md5_key(seed, "_key"), F.lit(folds))), "cv-folds")
    rows = []
    for k in range(folds):
        fold = keyed.withColumn("_is_train", F.col("_fold") != k)
        pre = build_preprocessing(fold, features, target, task, "_is_train", hash_cols).fit(fold)
        ptr, pte = pre.transform(fold.where("_is_train")), pre.transform(fold.where(~F.col("_is_train")))
        ptr = ptr.select("features", "label", "_key")
        pte = materialize(pte.select("features", "label", "_key").withColumn("_rid", F.monotonically_increasing_id()), "cv-test")
        st = ptr.agg(F.count(F.lit(1)).alias("n_train"), F.stddev_samp("label").alias("std"), F.max("label").alias("max_label")).collect()[0]
        r = run_model(model, task, params, dealt(ptr, st["n_train"]), dealt(pte, (pte_rows := pte.count())), st)
        rows.append((k, r.status, int(st["n_train"]), pte_rows, r.score, json.dumps(r.metrics, sort_keys=True)))
    out = spark.createDataFrame(rows, "fold int, status string, n_train long, n_test long, score double, metrics_json string")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    mean = out.agg(F.lit(-1).alias("fold"), F.lit("mean").alias("status"), none("long", "n_train"), none("long", "n_test"),
                   F.avg("score").alias("score"), none("string", "metrics_json"))
    return out.unionByName(mean)


def save_benchmark(catalog, result: BenchmarkResult, dataset_id: int | None = None, experiment_name: str | None = None) -> int:
    """Persist experiment, runs, configs, metrics and artifacts (G32) — one append per log."""
    spark = catalog.spark
    exp_id = catalog.log("experiments").max_id() + 1
    ranking = result.ranking()
    results = [{"model_name": r.model_name, "status": r.status, "score": r.score} for r in ranking]
    ts = now()
    catalog.log("experiments").append(spark.createDataFrame([(
        exp_id, dataset_id, experiment_name or f"Benchmark {result.task}", result.task, result.target,
        result.train_split / 100, 1 - result.train_split / 100, result.random_state, result.task, float(result.train_split),
        json.dumps(results), json.dumps({r.model_name: r.params for r in result.runs}, sort_keys=True),
        json.dumps(result.features), ts)], catalog.schema("experiments")))
    base_run = catalog.log("model_runs").max_id()
    catalog.log("model_runs").append(spark.createDataFrame(
        [(base_run + i + 1, exp_id, r.model_name, r.status, ts - dt.timedelta(milliseconds=r.duration_ms), ts, r.duration_ms, r.error)
         for i, r in enumerate(result.runs)],
        catalog.schema("model_runs")))
    catalog.log("model_configs").append(spark.createDataFrame(
        [(None, base_run + i + 1, json.dumps(r.params, sort_keys=True)) for i, r in enumerate(result.runs)], catalog.schema("model_configs")))
    metric_rows = [(None, base_run + i + 1, k, float(v)) for i, r in enumerate(result.runs) for k, v in r.metrics.items() if v is not None]
    if metric_rows:
        catalog.log("metrics").append(spark.createDataFrame(metric_rows, catalog.schema("metrics")))
    art_rows = []
    for i, r in enumerate(result.runs):
        if r.predictions is None:
            continue
        run_id = base_run + i + 1
        key = f"experiments/{exp_id}/run_{run_id}_predictions"
        r.predictions.select("_rid", "label", "prediction").write.mode("overwrite").parquet(catalog.table_path(key))
        art_rows.append((None, run_id, "predictions", key, ts))
        if result.task == "classification":
            ckey = f"experiments/{exp_id}/run_{run_id}_confusion"
            confusion_long(r.predictions).write.mode("overwrite").parquet(catalog.table_path(ckey))
            art_rows.append((None, run_id, "confusion_matrix", ckey, ts))
    if art_rows:
        catalog.log("artifacts").append(spark.createDataFrame(art_rows, catalog.schema("artifacts")))
    return exp_id


def rank_runs(runs: DataFrame) -> DataFrame:
    """Leaderboard order over a runs frame with ``status`` and ``score``: usable first, score desc,
    id asc; adds ``rank``. A benchmark has one row per model, so one ordered window is fine."""
    ok = (F.col("status") != "failed") & F.col("score").isNotNull()
    w = Window.orderBy(ok.desc(), F.col("score").desc_nulls_last(), F.col("run_id"))
    return runs.withColumn("rank", F.row_number().over(w))


__all__ = ["benchmark", "train", "cross_validate", "save_benchmark", "rank_runs", "class_report"]
