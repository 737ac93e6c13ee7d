"""One object with the workbench's user-level operations, each delegating to the Spark operators:

=====================  ==============================================================
list_datasets()        datasets with table name and inferred problem type (A7)
import_csv(...)        typed CSV ingest + column metadata (A1, A2)
profile(id)            columns, preview, target statistics, problem type (C9)
prepare(id, ...)       prepared version with lineage (D1–D15)
preparations(id)       preparations newest first (D13)
run_sql(q, ...)        guarded read-only SQL with history (F1–F5)
sql_history(id)        query history newest first (F4)
chart(id, ...)         chart points, logged as a query (E, F8); suggest_chart(id) a preset (E10)
models()               model registry (G13)
train(id, model, ...)  one model; train_all(id, ...) every model of the task (G21, G22)
experiments(id)        experiment list with run counts and best model (H5)
experiment(exp_id)     experiment row, nested runs and leaderboard (H1, H4)
=====================  ==============================================================

Datasets, tables and logs live under one root folder (by default a fresh folder under the shared
checkpoint directory).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelab.ml.registry import model_registry
from tidelab.ml.runner import benchmark, resolve_inputs, save_benchmark
from tidelab.operators.charts import ChartPreset, chart_data, suggest_chart
from tidelab.operators.experiments import experiment_details, leaderboard, list_experiments
from tidelab.operators.prep import list_preparations
from tidelab.operators.profile import Profile, profile
from tidelab.plans.sqllab import SqlLab, SqlResult
from tidelab.sources.catalog import Catalog
from tidelab.sources.ingest import IngestResult, ingest_csv, ingest_csv_text


@dataclass
class Experiment:
    experiment: DataFrame
    runs: DataFrame
    leaderboard: DataFrame


class Workbench:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, root)
        self.lab = SqlLab(spark, history_path=f"{self.catalog.root}/_logs/sql_queries")

    # datasets -----------------------------------------------------------------------------
    def list_datasets(self) -> DataFrame:
        return self.catalog.list_datasets()

    def import_csv(self, path: str | None = None, csv_text: str | None = None, name: str | None = None,
                   target: str | None = None, description: str | None = None, **kwargs) -> IngestResult:
        """Text wins over a path, as in the original upload form."""
        if csv_text is not None:
            res = ingest_csv_text(self.spark, csv_text, name=name, target=target, catalog=self.catalog, description=description, **kwargs)
        else:
            res = ingest_csv(self.spark, path, name=name, target=target, catalog=self.catalog, description=description, **kwargs)
        self._register_view(res.dataset_id)
        return res

    def _register_view(self, dataset_id: int) -> None:
        meta = self.catalog.dataset(dataset_id)
        self.lab.register(self.catalog.table_name(dataset_id, meta["storage_key"]), self.catalog.load(dataset_id))

    def profile(self, dataset_id: int) -> Profile:
        meta = self.catalog.dataset(dataset_id) or {}
        return profile(self.catalog.load(dataset_id), meta.get("target_column"))

    def prepare(self, dataset_id: int, **kwargs) -> dict:
        out = self.catalog.prepare(dataset_id, **kwargs)
        self._register_view(out["dataset_id"])
        return out

    def preparations(self, dataset_id: int) -> DataFrame:
        return list_preparations(self.catalog.log("dataset_preparations").read(), dataset_id)

    # SQL ----------------------------------------------------------------------------------
    def run_sql(self, query: str, dataset_id: int | None = None, name: str | None = None) -> SqlResult:
        return self.lab.run(query, dataset_id, name)

    def sql_history(self, dataset_id: int | None = None) -> DataFrame:
        return self.lab.history(dataset_id)

    # charts -------------------------------------------------------------------------------
    def suggest_chart(self, dataset_id: int) -> ChartPreset:
        return suggest_chart(self.catalog.load(dataset_id))

    def chart(self, dataset_id: int, chart_type: str, x: str, y: str | None = None, aggregation: str = "sum",
              limit: int = 12) -> DataFrame:
        """Chart points of a dataset; the equivalent SQL goes to the query history."""
        out = chart_data(self.catalog.load(dataset_id), chart_type, x, y, aggregation, limit)
        meta = self.catalog.dataset(dataset_id)
        table = self.catalog.table_name(dataset_id, meta["storage_key"])
        self.lab.log_chart(table, chart_type, x, y, aggregation, limit, dataset_id)
        return out

    # models -------------------------------------------------------------------------------
    def models(self) -> DataFrame:
        return model_registry(self.spark)

    def train_all(self, dataset_id: int, models: list[str] | None = None, target: str | None = None,
                  features: list[str] | None = None, task: str | None = None, params_by_model: dict | None = None,
                  train_split: float = 80, random_state: int = 42, experiment_name: str | None = None,
                  hash_cols: list[str] | None = None) -> int:
        df, tgt, feats, task = resolve_inputs(self.catalog, dataset_id, target, features, task)
        res = benchmark(df, tgt, task, models, params_by_model, feats, train_split, random_state, hash_cols=hash_cols)
        return save_benchmark(self.catalog, res, dataset_id, experiment_name)

    def train(self, dataset_id: int, model: str, params: dict | None = None, **kwargs) -> int:
        return self.train_all(dataset_id, [model], params_by_model={model: params or {}}, **kwargs)

    # experiments --------------------------------------------------------------------------
    def _logs(self):
        c = self.catalog
        return (c.log("experiments").read(), c.log("model_runs").read(), c.log("metrics").read(),
                c.log("model_configs").read(), c.log("artifacts").read())

    def experiments(self, dataset_id: int | None = None) -> DataFrame:
        exps, runs, metrics, _, _ = self._logs()
        return list_experiments(exps, runs, metrics, dataset_id)

    def experiment(self, experiment_id: int) -> Experiment:
        exps, runs, metrics, configs, artifacts = self._logs()
        return Experiment(
            experiment=exps.where(F.col("id") == F.lit(experiment_id)),
            runs=experiment_details(runs, configs, metrics, artifacts, experiment_id).orderBy("id"),
            leaderboard=leaderboard(runs, metrics, experiment_id).orderBy("rank"),
        )
