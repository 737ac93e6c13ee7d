"""Experiment analytics (H1–H15) over the run/metric/config/artifact logs.

Every operator is a join or a partial aggregate keyed by run or experiment — no per-experiment
loops (the N+1 lookups of a request/response backend become one job). Leaderboard ranks use the
skew-safe ``rank_within`` (an experiment may hold a large share of all runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.plans.ranking import rank_within

# Score precedence (first present wins).
SCORE_PRECEDENCE = ["score", "f1", "r2", "accuracy", "roc_auc"]


def _dedup_ids(metrics: DataFrame) -> DataFrame:
    """One row per (run, metric, id): rows sharing an id keep the largest value, so "latest wins"
    stays deterministic when ids repeat. A hash aggregate with map-side combine."""
    return metrics.groupBy("run_id", "metric_name", "id").agg(F.max("metric_value").alias("metric_value"))


def _latest(metric: str):
    """Value of ``metric`` with the highest metric id. ``max_by`` over primitive value and ordering
    keeps the aggregate hash-based (no sort), partial per task."""
    return F.max_by(F.col("metric_value"), F.when(F.col("metric_name") == metric, F.col("id")))


def run_scores(metrics: DataFrame, precedence: list[str] | None = None) -> DataFrame:
    """``(run_id, score)`` — first present of score, f1, r2, accuracy, roc_auc (the latest of each)."""
    names = precedence or SCORE_PRECEDENCE
    m = _dedup_ids(metrics.where(F.col("metric_name").isin(names)))
    agg = m.groupBy("run_id").agg(*[_latest(n).alias(f"_m_{i}") for i, n in enumerate(names)])
    return agg.select("run_id", F.coalesce(*[F.col(f"_m_{i}") for i in range(len(names))]).alias("score"))


def _usable():
    return ((F.col("status") != F.lit("failed")) | F.col("status").isNull()) & F.col("score").isNotNull()


def scored_runs(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    return runs.join(run_scores(metrics), runs["id"] == F.col("run_id"), "left").drop("run_id")


def leaderboard(runs: DataFrame, metrics: DataFrame, experiment_id: int | None = None) -> DataFrame:
    """Runs with ``score`` and ``rank`` inside their experiment: usable runs first, then score
    descending, then id."""
    if experiment_id is not None:
        runs = runs.where(F.col("experiment_id") == F.lit(experiment_id))
    s = scored_runs(runs, metrics).withColumn("ok", _usable().cast("int"))
    ranked = rank_within(s, ["experiment_id"], [F.col("ok").desc(), F.col("score").desc_nulls_last(), F.col("id")], rank_col="rank", size_col=None)
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def ranked_scores(runs: DataFrame, metrics: DataFrame, experiment_id: int | None = None) -> DataFrame:
    """Leaderboard rows that have a score (what a score chart plots)."""
    return leaderboard(runs, metrics, experiment_id).where(F.col("score").isNotNull())


def list_experiments(experiments: DataFrame, runs: DataFrame, metrics: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """Experiments newest first with ``run_count, failed_runs, successful_runs, avg_duration_ms,
    best_model, best_score`` — one group-by over runs instead of one detail query per experiment."""
    if dataset_id is not None:
        experiments = experiments.where(F.col("dataset_id") == F.lit(dataset_id))
    per = runs.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.round(F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms")))).alias("avg_duration_ms"),
    )
    # Best run: the highest score among usable runs, of those the smallest id. Two aggregates with
    # map-side combine; no run is ranked.
    usable = scored_runs(runs, metrics).where(_usable()).select("experiment_id", "id", "model_name", "score")
    top = usable.groupBy("experiment_id").agg(F.max("score").alias("best_score"))
    at_top = usable.join(top, "experiment_id").where(F.col("score") == F.col("best_score"))
    best = at_top.groupBy(F.col("experiment_id").alias("_bx")).agg(
        F.min_by("model_name", "id").alias("best_model"), F.max("best_score").alias("best_score"))
    e = experiments.alias("e")
    j = e.join(per, F.col("e.id") == per.experiment_id, "left").join(best, F.col("e.id") == F.col("_bx"), "left")
    return j.select(
        "e.*",
        F.coalesce("run_count", F.lit(0)).alias("run_count"),
        F.coalesce("failed_runs", F.lit(0)).alias("failed_runs"),
        (F.coalesce("run_count", F.lit(0)) - F.coalesce("failed_runs", F.lit(0))).alias("successful_runs"),
        F.col("avg_duration_ms"),
        "best_model",
        "best_score",
    ).orderBy(F.col("e.id").desc())


def list_created(rows: DataFrame) -> DataFrame:
    """Any log newest first by its creation time, of equal times the larger id first."""
    return rows.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())


def list_runs(runs: DataFrame, experiment_id: int | None = None) -> DataFrame:
    if experiment_id is not None:
        runs = runs.where(F.col("experiment_id") == F.lit(experiment_id))
    return runs.orderBy(F.col("id").desc())


def metrics_long(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(run_id, model_name, metric_name, metric_value)``."""
    r = runs.select(F.col("id").alias("run_id"), "model_name", "experiment_id")
    return metrics.join(r, "run_id").select("experiment_id", "run_id", "model_name", "metric_name", "metric_value")


def metrics_map(metrics: DataFrame) -> DataFrame:
    """``(run_id, metrics map<string,double>)`` — the latest value per name. Pre-aggregated per
    (run, name) first, so each run's map holds one entry per distinct metric name."""
    latest = _dedup_ids(metrics).groupBy("run_id", "metric_name").agg(F.max_by("metric_value", "id").alias("v"))
    return latest.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("metric_name", "v"))).alias("metrics"))


def experiment_details(runs: DataFrame, configs: DataFrame, metrics: DataFrame, artifacts: DataFrame, experiment_id: int | None = None) -> DataFrame:
    """Runs nested with their config, metric list and artifact list (missing → null / empty list).
    Children are pre-aggregated per run (one list per run, built map-side), then left-joined. The
    lists hold what one model run wrote (its metrics and artifacts), bounded by the metric catalogue
    rather than by data size; ``metrics_long`` / ``run_artifacts`` are the flat forms."""
    if experiment_id is not None:
        runs = runs.where(F.col("experiment_id") == F.lit(experiment_id))
        # Children of the selected runs only, pruned before they are aggregated (H2).
        ids = runs.select(F.col("id").alias("run_id"))
        configs, metrics, artifacts = (t.join(ids, "run_id", "left_semi") for t in (configs, metrics, artifacts))
    last_cfg = configs.groupBy("run_id").agg(F.max("id").alias("id"))
    cfg = configs.join(last_cfg, ["run_id", "id"], "left_semi").select("run_id", F.struct("id", "params_json").alias("config"))
    met = metrics.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "metric_name", "metric_value"))).alias("metrics"))
    art = artifacts.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "artifact_type", "artifact_key"))).alias("artifacts"))
    empty_m = F.array().cast("array<struct<id:bigint,metric_name:string,metric_value:double>>")
    empty_a = F.array().cast("array<struct<id:bigint,artifact_type:string,artifact_key:string>>")
    out = runs.alias("r").join(cfg, F.col("r.id") == cfg.run_id, "left").drop("run_id")
    out = out.join(met, F.col("r.id") == met.run_id, "left").drop("run_id")
    out = out.join(art, F.col("r.id") == art.run_id, "left").drop("run_id")
    return out.withColumn("metrics", F.coalesce("metrics", empty_m)).withColumn("artifacts", F.coalesce("artifacts", empty_a))


def run_artifacts(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts flattened with the run's model name."""
    r = runs.select(F.col("id").alias("run_id"), "model_name")
    return artifacts.join(r, "run_id").select(F.col("id").alias("artifact_id"), "run_id", "model_name", "artifact_type", "artifact_key")


def compare_runs(runs: DataFrame, metrics: DataFrame, metric_names: list[str], configs: DataFrame | None = None,
                 experiment_ids: list[int] | None = None) -> DataFrame:
    """One row per run, one column per metric (latest value), plus duration and params;
    ``experiment_ids`` restricts the comparison to some experiments."""
    if experiment_ids is not None:
        runs = runs.where(F.col("experiment_id").isin(list(experiment_ids)))
        ids = runs.select(F.col("id").alias("run_id"))
        metrics = metrics.join(ids, "run_id", "left_semi")
    m = _dedup_ids(metrics.where(F.col("metric_name").isin(metric_names)))
    pv = m.groupBy("run_id").agg(*[_latest(n).alias(n) for n in metric_names])
    out = runs.select(F.col("id").alias("run_id"), "experiment_id", "model_name", "status", "duration_ms").join(pv, "run_id", "left")
    if configs is not None:
        last = configs.groupBy("run_id").agg(F.max("id").alias("id"))
        latest_cfg = configs.join(last, ["run_id", "id"], "left_semi").select("run_id", "params_json")
        out = out.join(latest_cfg, "run_id", "left")
    return out


def run_params(configs: DataFrame) -> DataFrame:
    """``(run_id, param, value)`` from the JSON params (invalid JSON → no rows)."""
    m = F.from_json(F.col("params_json"), "map<string,string>")
    return configs.select("run_id", F.explode_outer(m).alias("param", "value")).where(F.col("param").isNotNull())


def workspace_summary(datasets: DataFrame, queries: DataFrame, experiments: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(name, value)``: dataset, saved-query and experiment counts and the best accuracy."""
    parts = [
        datasets.agg(F.lit("datasets").alias("name"), F.count(F.lit(1)).cast("double").alias("value")),
        queries.agg(F.lit("saved_queries").alias("name"), F.count(F.lit(1)).cast("double").alias("value")),
        experiments.agg(F.lit("experiments").alias("name"), F.count(F.lit(1)).cast("double").alias("value")),
        metrics.where(F.col("metric_name") == "accuracy").agg(F.lit("best_accuracy").alias("name"), F.max("metric_value").cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
