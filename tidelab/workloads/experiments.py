"""Experiment-analytics workloads (H1, H3–H6, H9, H11, H12, H14, H15) over run/metric logs derived
from the supplied tables: one run per order (experiment = customer, model = order priority,
status failed when the order is pending), one metric and one artifact per line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelab.operators.experiments import (
    compare_runs,
    experiment_details,
    leaderboard,
    list_experiments,
    list_runs,
    metrics_long,
    run_artifacts,
    run_params,
    run_scores,
    workspace_summary,
)
from tidelab.session import read_table
from tidelab.workloads import register

_METRIC_NAME = "CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN 'roc_auc' ELSE CASE l_linenumber WHEN 1 THEN 'accuracy' WHEN 2 THEN 'r2' WHEN 3 THEN 'f1' WHEN 4 THEN 'score' WHEN 5 THEN 'accuracy' ELSE 'rmse' END END"

LOG_SQL = {
    "runs": """SELECT o_orderkey AS id, o_custkey AS experiment_id, o_orderpriority AS model_name,
       CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status,
       CAST(floor(o_totalprice) AS BIGINT) - 150000 AS duration_ms FROM orders""",
    "metrics": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS run_id, {_METRIC_NAME} AS metric_name,
       l_discount * 10 AS metric_value FROM lineitem""",
    "configs": """SELECT o_orderkey AS id, o_orderkey AS run_id,
       '{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS params_json FROM orders""",
    "artifacts": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS run_id,
       CASE WHEN l_linenumber % 2 = 1 THEN 'predictions' ELSE 'confusion_matrix' END AS artifact_type,
       'runs/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS artifact_key FROM lineitem""",
    "experiments": """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS dataset_id, c_name AS experiment_name,
       CASE WHEN c_acctbal > 0 THEN 'classification' ELSE 'regression' END AS problem_type FROM customer""",
    "datasets": "SELECT p_partkey AS id, p_name AS name FROM part",
    "queries": "SELECT o_orderkey AS id, o_orderpriority AS query_name FROM orders",
}


def _logs(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    c = read_table(spark, sf_dir, "customer")
    p = read_table(spark, sf_dir, "part")
    runs = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("experiment_id"), F.col("o_orderpriority").alias("model_name"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        (F.floor("o_totalprice").cast("long") - 150000).alias("duration_ms"),
    )
    ln = F.col("l_linenumber")
    name = (F.when((ln == 1) & (F.col("l_orderkey") % 5 == 0), "roc_auc").when(ln == 1, "accuracy").when(ln == 2, "r2").when(ln == 3, "f1").when(ln == 4, "score")
            .when(ln == 5, "accuracy").otherwise("rmse"))
    metrics = li.select(
        (F.col("l_orderkey") * 10 + ln).alias("id"), F.col("l_orderkey").alias("run_id"), name.alias("metric_name"),
        (F.col("l_discount") * 10).alias("metric_value"),
    )
    configs = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit('{"priority":"'), F.col("o_orderpriority"), F.lit('","status":"'), F.col("o_orderstatus"), F.lit('"}')).alias("params_json"),
    )
    artifacts = li.select(
        (F.col("l_orderkey") * 10 + ln).alias("id"), F.col("l_orderkey").alias("run_id"),
        F.when(ln % 2 == 1, "predictions").otherwise("confusion_matrix").alias("artifact_type"),
        F.concat(F.lit("runs/"), F.col("l_orderkey").cast("string"), F.lit("/"), ln.cast("string")).alias("artifact_key"),
    )
    experiments = c.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("dataset_id"), F.col("c_name").alias("experiment_name"),
        F.when(F.col("c_acctbal") > 0, "classification").otherwise("regression").alias("problem_type"),
    )
    datasets = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    queries = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("query_name"))
    return dict(runs=runs, metrics=metrics, configs=configs, artifacts=artifacts, experiments=experiments, datasets=datasets, queries=queries)


def _with(sql_body: str) -> str:
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in LOG_SQL.items())
    return f"WITH {ctes},\n{sql_body}"


_SCORES = """scores AS (
  SELECT run_id, COALESCE(max_by(metric_value, CASE WHEN metric_name = 'score' THEN {'i': id, 'v': metric_value} END),
                          max_by(metric_value, CASE WHEN metric_name = 'f1' THEN {'i': id, 'v': metric_value} END),
                          max_by(metric_value, CASE WHEN metric_name = 'r2' THEN {'i': id, 'v': metric_value} END),
                          max_by(metric_value, CASE WHEN metric_name = 'accuracy' THEN {'i': id, 'v': metric_value} END),
                          max_by(metric_value, CASE WHEN metric_name = 'roc_auc' THEN {'i': id, 'v': metric_value} END)) AS score
  FROM metrics WHERE metric_name IN ('score', 'f1', 'r2', 'accuracy', 'roc_auc') GROUP BY run_id),
scored AS (
  SELECT r.*, s.score, CASE WHEN r.status <> 'failed' AND s.score IS NOT NULL THEN 1 ELSE 0 END AS ok
  FROM runs r LEFT JOIN scores s ON r.id = s.run_id)"""


@register("run_scores", _with(_SCORES.split(",\nscored AS")[0] + "\nSELECT run_id, score FROM scores"))
def run_scores_q(spark, sf_dir):
    return run_scores(_logs(spark, sf_dir)["metrics"])


@register(
    "leaderboard",
    _with(_SCORES + """
SELECT *, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY ok DESC, score DESC NULLS LAST, id) AS INTEGER) AS rank
FROM scored"""),
)
def leaderboard_q(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    return leaderboard(lg["runs"], lg["metrics"])


@register(
    "list_experiments",
    _with(_SCORES + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY ok DESC, score DESC NULLS LAST, id) AS rk FROM scored),
per AS (
  SELECT experiment_id, count(*) AS run_count, CAST(count_if(status = 'failed') AS BIGINT) AS failed_runs,
         ROUND(AVG(CASE WHEN duration_ms > 0 THEN duration_ms END)) AS avg_duration_ms,
         max(ok) AS any_ok,
         max(CASE WHEN rk = 1 THEN model_name END) AS best_model0, max(CASE WHEN rk = 1 THEN score END) AS best_score0
  FROM ranked GROUP BY experiment_id)
SELECT e.*, COALESCE(run_count, 0) AS run_count, COALESCE(failed_runs, 0) AS failed_runs,
       COALESCE(run_count, 0) - COALESCE(failed_runs, 0) AS successful_runs, avg_duration_ms,
       CASE WHEN any_ok = 1 THEN best_model0 END AS best_model, CASE WHEN any_ok = 1 THEN best_score0 END AS best_score
FROM experiments e LEFT JOIN per ON e.id = per.experiment_id ORDER BY e.id DESC"""),
)
def list_experiments_q(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    return list_experiments(lg["experiments"], lg["runs"], lg["metrics"])


@register("list_runs", _with("x AS (SELECT 1)\nSELECT * FROM runs ORDER BY id DESC"))
def list_runs_q(spark, sf_dir):
    return list_runs(_logs(spark, sf_dir)["runs"])


@register(
    "metrics_long",
    _with("x AS (SELECT 1)\nSELECT r.experiment_id, m.run_id, r.model_name, m.metric_name, m.metric_value FROM metrics m JOIN runs r ON m.run_id = r.id"),
)
def metrics_long_q(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    return metrics_long(lg["runs"], lg["metrics"])


@register(
    "experiment_details",
    _with("""x AS (SELECT 1)
SELECT r.id AS run_id, c.params_json,
       CAST((SELECT count(*) FROM metrics m WHERE m.run_id = r.id) AS INTEGER) AS n_metrics,
       COALESCE((SELECT string_agg(metric_name, ',' ORDER BY id) FROM metrics m WHERE m.run_id = r.id), '') AS metric_names,
       CAST((SELECT count(*) FROM artifacts a WHERE a.run_id = r.id) AS INTEGER) AS n_artifacts
FROM runs r LEFT JOIN configs c ON c.run_id = r.id"""),
)
def experiment_details_q(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    d = experiment_details(lg["runs"], lg["configs"], lg["metrics"], lg["artifacts"])
    return d.select(
        F.col("id").alias("run_id"), F.col("config.params_json").alias("params_json"),
        F.size("metrics").alias("n_metrics"),
        F.array_join(F.transform("metrics", lambda m: m["metric_name"]), ",").alias("metric_names"),
        F.size("artifacts").alias("n_artifacts"),
    )


@register(
    "compare_runs",
    _with("""x AS (SELECT 1),
pv AS (SELECT run_id,
  max_by(metric_value, CASE WHEN metric_name = 'accuracy' THEN {'i': id, 'v': metric_value} END) AS accuracy,
  max_by(metric_value, CASE WHEN metric_name = 'f1' THEN {'i': id, 'v': metric_value} END) AS f1,
  max_by(metric_value, CASE WHEN metric_name = 'r2' THEN {'i': id, 'v': metric_value} END) AS r2,
  max_by(metric_value, CASE WHEN metric_name = 'rmse' THEN {'i': id, 'v': metric_value} END) AS rmse,
  max_by(metric_value, CASE WHEN metric_name = 'score' THEN {'i': id, 'v': metric_value} END) AS score
  FROM metrics GROUP BY run_id),
cfg AS (SELECT run_id, max_by(params_json, id) AS params_json FROM configs GROUP BY run_id)
SELECT r.id AS run_id, r.experiment_id, r.model_name, r.status, r.duration_ms,
       pv.accuracy, pv.f1, pv.r2, pv.rmse, pv.score, cfg.params_json
FROM runs r LEFT JOIN pv ON pv.run_id = r.id LEFT JOIN cfg ON cfg.run_id = r.id"""),
)
def compare_runs_q(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    return compare_runs(lg["runs"], lg["metrics"], ["accuracy", "f1", "r2", "rmse", "score"], lg["configs"])


@register(
    "run_artifacts",
    _with("""x AS (SELECT 1)
SELECT a.id AS artifact_id, a.run_id, r.model_name, a.artifact_type, a.artifact_key FROM artifacts a JOIN runs r ON a.run_id = r.id"""),
)
def run_artifacts_q(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    return run_artifacts(lg["runs"], lg["artifacts"])


@register(
    "run_params",
    _with("""x AS (SELECT 1)
SELECT run_id, k AS param, json_extract_string(params_json, '$."' || k || '"') AS value
FROM configs, unnest(json_keys(params_json)) AS t(k)"""),
)
def run_params_q(spark, sf_dir):
    return run_params(_logs(spark, sf_dir)["configs"])


@register(
    "workspace_summary",
    _with("""x AS (SELECT 1)
SELECT 'datasets' AS name, CAST(count(*) AS DOUBLE) AS value FROM datasets
UNION ALL SELECT 'saved_queries', CAST(count(*) AS DOUBLE) FROM queries
UNION ALL SELECT 'experiments', CAST(count(*) AS DOUBLE) FROM experiments
UNION ALL SELECT 'best_accuracy', CAST(max(metric_value) AS DOUBLE) FROM metrics WHERE metric_name = 'accuracy'"""),
)
def workspace_summary_q(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    return workspace_summary(lg["datasets"], lg["queries"], lg["experiments"], lg["metrics"])


from tidelab.operators.experiments import ranked_scores  # noqa: E402


@register(
    "ranked_scores",
    _with(_SCORES + """,
lb AS (SELECT *, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY ok DESC, score DESC NULLS LAST, id) AS INTEGER) AS rank
       FROM scored)
SELECT * FROM lb WHERE score IS NOT NULL"""),
)
def ranked_scores_q(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    return ranked_scores(lg["runs"], lg["metrics"])


from tidelab.operators.experiments import metrics_map  # noqa: E402


@register(
    "metrics_map",
    _with("""x AS (SELECT 1)
SELECT run_id, metric_name, max_by(metric_value, {'i': id, 'v': metric_value}) AS metric_value
FROM metrics GROUP BY run_id, metric_name"""),
)
def metrics_map_q(spark, sf_dir):
    """One metric map per run (latest value per name), flattened for comparison."""
    m = metrics_map(_logs(spark, sf_dir)["metrics"])
    return m.select("run_id", F.explode("metrics").alias("metric_name", "metric_value"))
