"""Dataset catalog and append-only logs.

Every log is a Parquet folder appended to by one writer (Parquet appends are not transactional, so
concurrent writers to one log are not supported). Log batches are metadata rows — a query, a
preparation, a benchmark's runs — not data, so they are small by construction.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelab.session import scratch_dir

# Log table schemas.
LOG_SCHEMAS = {
    "datasets": "id long, name string, description string, source_type string, storage_key string, "
    "preview_key string, parent_dataset_id long, version_name string, prep_config_json string, "
    "row_count long, column_count int, target_column string, created_at timestamp",
    "dataset_columns": "id long, dataset_id long, column_name string, data_type string, is_target int, "
    "has_nulls int, null_count long, unique_count long",
    "column_sketches": "id long, dataset_id long, ordinal int, column_name string, cells long, missing long, "
    "distinct_sketch binary, heavy_sketch struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>, "
    "quantile_sketch binary",
    "sql_queries": "id long, dataset_id long, query_name string, query_text string, created_at timestamp",
    "experiments": "id long, dataset_id long, experiment_name string, problem_type string, target_column string, "
    "train_size double, test_size double, random_state int, task_type string, train_split double, "
    "results_json string, hyperparams_json string, feature_columns_json string, created_at timestamp",
    "model_runs": "id long, experiment_id long, model_name string, status string, started_at timestamp, "
    "finished_at timestamp, duration_ms long, error_message string",
    "model_configs": "id long, run_id long, params_json string",
    "metrics": "id long, run_id long, metric_name string, metric_value double",
    "artifacts": "id long, run_id long, artifact_type string, artifact_key string, created_at timestamp",
    "dataset_preparations": "id long, dataset_id long, source_dataset_id long, version_name string, source_table string, "
    "prepared_table string, target_column string, selected_features_json string, rename_map_json string, "
    "derived_columns_json string, prep_config_json string, created_at timestamp",
    "feature_selections": "id long, dataset_id long, preparation_id long, target_column string, "
    "selected_features_json string, dropped_features_json string, task_type string, created_at timestamp",
    "dataset_transformations": "id long, dataset_id long, preparation_id long, transformation_type string, "
    "transformation_json string, created_at timestamp",
}


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def ensure_columns(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Schema evolution: add every missing column of ``schema`` as a typed null, keep extra columns,
    and order the known ones first."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields]
    extra = [c for c in df.columns if c not in {f.name for f in st.fields}]
    return df.select(*cols, *extra)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row (``value`` string column)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


class AppendLog:
    """Append-only Parquet log with ``id`` assigned per batch as ``max(id) + row_number``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._st = T._parse_datatype_string(schema)

    def read(self) -> DataFrame:
        try:
            return ensure_columns(self.spark.read.schema(self._st).parquet(self.path), self._st)
        except Exception as e:  # noqa: BLE001 - an unwritten log reads as empty
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return self.spark.createDataFrame([], self._st)
            raise

    def max_id(self) -> int:
        row = self.read().agg(F.max("id").alias("m")).collect()[0]
        return int(row["m"] or 0)

    def append(self, batch: DataFrame) -> DataFrame:
        """Append a metadata batch. Given ids stay; rows without one get consecutive ids after the
        largest of the log and the batch."""
        if "id" not in batch.columns:
            batch = batch.withColumn("id", F.lit(None).cast("long"))
        # Read twice, for the ids and for the rows: an aggregate over a table is computed once.
        mine = not batch.is_cached
        batch = held = batch.persist()
        try:
            given = batch.agg(F.max("id").alias("m"), F.count_if(F.col("id").isNull()).alias("n")).collect()[0]
            if given["n"]:
                base = max(self.max_id(), int(given["m"] or 0))
                # A metadata batch is small; a single ordered window over it is fine.
                order = Window.partitionBy(F.col("id").isNull()).orderBy(F.monotonically_increasing_id())
                batch = batch.withColumn("id", F.coalesce("id", F.lit(base) + F.row_number().over(order)))
            out = ensure_columns(batch, self._st).select(*[f.name for f in self._st.fields])
            out.write.mode("append").parquet(self.path)
        finally:
            if mine:
                held.unpersist()
        return out


class Catalog:
    """Datasets as Parquet tables plus metadata logs under one root folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or scratch_dir(spark, "catalog")).rstrip("/")
        self.logs = {name: AppendLog(spark, f"{self.root}/_logs/{name}", schema) for name, schema in LOG_SCHEMAS.items()}

    def log(self, name: str) -> AppendLog:
        return self.logs[name]

    def schema(self, name: str) -> str:
        return LOG_SCHEMAS[name]

    def table_name(self, dataset_id: int, storage_key: str | None = None) -> str:
        if storage_key and storage_key.replace("_", "a").isalnum() and not storage_key[0].isdigit():
            return storage_key
        return f"dataset_{dataset_id}"

    def table_path(self, table: str) -> str:
        return f"{self.root}/tables/{table}"

    def write_table(self, df: DataFrame, table: str) -> str:
        """Table sink (A10): parallel Parquet write, replacing any previous content."""
        path = self.table_path(table)
        df.write.mode("overwrite").parquet(path)
        return path

    def register_dataset(
        self,
        df: DataFrame,
        name: str,
        source_type: str = "upload",
        description: str | None = None,
        target_column: str | None = None,
        parent_dataset_id: int | None = None,
        version_name: str | None = None,
        prep_config: dict | None = None,
        columns_meta: DataFrame | None = None,
        table: str | None = None,
    ) -> int:
        """Write the table, then its ``datasets`` row and column metadata rows. Returns the new id."""
        from tidelab.operators.profile import profile_columns

        ds_id = self.logs["datasets"].max_id() + 1
        table = table or f"dataset_{ds_id}"
        self.write_table(df, table)
        stored = self.spark.read.parquet(self.table_path(table))
        row_count = stored.count()
        meta = columns_meta if columns_meta is not None else profile_columns(stored, target_column)
        row = [(ds_id, name, description, source_type, table, None, parent_dataset_id, version_name,
                json.dumps(prep_config) if prep_config is not None else None, row_count, len(stored.columns),
                target_column, now())]
        self.logs["datasets"].append(self.spark.createDataFrame(row, LOG_SCHEMAS["datasets"]))
        cols = meta.select(
            F.lit(ds_id).cast("long").alias("dataset_id"), "column_name", "data_type", "is_target", "has_nulls",
            "null_count", "unique_count", F.col("ordinal") if "ordinal" in meta.columns else F.lit(0).alias("ordinal"),
        ).orderBy("ordinal").drop("ordinal")
        self.logs["dataset_columns"].append(cols)
        return ds_id

    def dataset(self, dataset_id: int) -> dict | None:
        rows = self.logs["datasets"].read().where(F.col("id") == F.lit(dataset_id)).collect()
        return rows[0].asDict() if rows else None

    def load(self, dataset_id: int) -> DataFrame:
        """Table scan by dataset id (A3)."""
        meta = self.dataset(dataset_id)
        if meta is None:
            raise KeyError(f"dataset {dataset_id} not found")
        return self.spark.read.parquet(self.table_path(self.table_name(dataset_id, meta["storage_key"])))

    def append_rows(self, dataset_id: int, rows: DataFrame) -> None:
        """Add rows to a dataset's table and their column sketches to the log. The rows already there are
        sketched once, before the first append; later appends read their own rows only. Rows need the
        table's columns by name; what the log of datasets says of the table stays as of its import."""
        from tidelab.operators.sketches import column_sketches

        table = self.load(dataset_id)
        if set(rows.columns) != set(table.columns):
            raise ValueError(f"columns {sorted(rows.columns)} are not those of dataset {dataset_id}: {sorted(table.columns)}")
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
        parts = [rows]
        if self._sketches(dataset_id).isEmpty():
            parts.insert(0, table)
        for part in parts:
            self.logs["column_sketches"].append(column_sketches(part).withColumn("dataset_id", F.lit(dataset_id).cast("long")))
        meta = self.dataset(dataset_id)
        rows.write.mode("append").parquet(self.table_path(self.table_name(dataset_id, meta["storage_key"])))

    def _sketches(self, dataset_id: int) -> DataFrame:
        return self.logs["column_sketches"].read().where(F.col("dataset_id") == F.lit(dataset_id))

    def column_estimates(self, dataset_id: int, **kwargs) -> DataFrame:
        """Approximate profile of a dataset with appended rows, from its sketches alone."""
        from tidelab.operators.sketches import sketch_estimates

        return sketch_estimates(self._sketches(dataset_id), **kwargs).orderBy("ordinal")

    def list_datasets(self) -> DataFrame:
        return list_datasets(self.logs["datasets"].read(), self.logs["dataset_columns"].read())

    def columns(self, dataset_id: int) -> DataFrame:
        return self.logs["dataset_columns"].read().where(F.col("dataset_id") == F.lit(dataset_id)).orderBy("id")

    def prepare(
        self,
        dataset_id: int,
        target: str | None = None,
        features: list[str] | None = None,
        rename: dict | None = None,
        derived: list | None = None,
        version_name: str | None = None,
        task_type: str | None = None,
        exact_ratio: bool = False,
        allow_target: bool = False,
    ) -> dict:
        """Prepared version (D1–D15): one select written as a new table, a child dataset row with
        parent id and version, and lineage rows (preparation, feature selection, transformations)."""
        from tidelab.operators.prep import DEFAULT_VERSION, dropped_features, prepare
        from tidelab.operators.schema import infer_problem_type

        meta = self.dataset(dataset_id)
        if meta is None:
            raise KeyError(f"dataset {dataset_id} not found")
        src = self.load(dataset_id)
        target = (target or meta.get("target_column") or "").strip()
        out, plan = prepare(src, target, features, rename, derived, exact_ratio=exact_ratio, allow_target=allow_target)
        version = (version_name or DEFAULT_VERSION).strip()
        cfg = json.loads(plan.to_json())
        new_id = self.register_dataset(
            out, f"{meta['name']} · {version}", source_type="prepared", description=meta.get("description"),
            target_column=plan.target_output, parent_dataset_id=dataset_id, version_name=version, prep_config=cfg,
            table=f"prepared_{dataset_id}_{int(now().timestamp() * 1000)}",
        )
        new_meta = self.dataset(new_id)
        ts = now()
        prep_id = self.logs["dataset_preparations"].max_id() + 1
        self.logs["dataset_preparations"].append(self.spark.createDataFrame([(
            prep_id, new_id, dataset_id, version, self.table_name(dataset_id, meta["storage_key"]), new_meta["storage_key"],
            plan.target_output, json.dumps(plan.feature_outputs + [d.name for d in plan.derived]), json.dumps(plan.rename),
            json.dumps([d.__dict__ for d in plan.derived]), plan.to_json(), ts)], LOG_SCHEMAS["dataset_preparations"]))
        dropped = dropped_features(src.columns, plan.features, plan.target)
        self.logs["feature_selections"].append(self.spark.createDataFrame([(
            None, new_id, prep_id, plan.target_output, json.dumps(plan.feature_outputs), json.dumps(dropped),
            task_type or infer_problem_type(self.load(new_id), plan.target_output), ts)], LOG_SCHEMAS["feature_selections"]))
        trans = [(None, new_id, prep_id, "feature_selection", json.dumps({"selected": plan.features, "dropped": dropped}), ts)]
        if plan.rename:
            trans.append((None, new_id, prep_id, "rename", json.dumps(plan.rename), ts))
        for d in plan.derived:
            trans.append((None, new_id, prep_id, "derived_column", json.dumps(d.__dict__), ts))
        self.logs["dataset_transformations"].append(self.spark.createDataFrame(trans, LOG_SCHEMAS["dataset_transformations"]))
        return {"dataset_id": new_id, "preparation_id": prep_id, "plan": plan, "dropped": dropped}

    def latest_preparation(self, dataset_id: int) -> dict | None:
        """Latest preparation whose source or result is ``dataset_id``."""
        from tidelab.operators.prep import list_preparations

        rows = list_preparations(self.logs["dataset_preparations"].read(), dataset_id).limit(1).collect()
        return rows[0].asDict() if rows else None


def list_datasets(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Datasets ordered by id, each with its table name and inferred problem type — one join with
    the target-column metadata instead of one profile per dataset.

    The target is the flagged column, else the dataset's ``target_column``. TEXT target →
    classification; numeric with ≤ 2 distinct values → classification; otherwise regression.
    """
    target_rows = columns.where(F.col("is_target") == 1)
    last = target_rows.groupBy("dataset_id").agg(F.max("id").alias("id"))  # hash aggregate, no sort
    flagged = target_rows.join(last, ["dataset_id", "id"], "left_semi").select(
        "dataset_id", F.struct("column_name", "data_type", "unique_count").alias("t"))
    by_name = columns.select(
        F.col("dataset_id").alias("n_dataset_id"), F.col("column_name").alias("n_column_name"),
        F.col("data_type").alias("n_data_type"), F.col("unique_count").alias("n_unique_count"),
    )
    d = datasets.alias("d")
    joined = d.join(flagged, F.col("d.id") == flagged.dataset_id, "left").join(
        by_name,
        (F.col("d.id") == F.col("n_dataset_id")) & (F.col("d.target_column") == F.col("n_column_name")),
        "left",
    )
    dtype = F.coalesce(F.col("t.data_type"), F.col("n_data_type"))
    uniq = F.coalesce(F.col("t.unique_count"), F.col("n_unique_count"), F.lit(0))
    problem = (
        F.when(F.upper(dtype) == "TEXT", F.lit("classification"))
        .when(F.upper(dtype).isin("INTEGER", "REAL") & (uniq <= 2), F.lit("classification"))
        .otherwise(F.lit("regression"))
    )
    table = F.when(
        F.coalesce(F.col("d.storage_key"), F.lit("")).rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("d.storage_key")
    ).otherwise(F.concat(F.lit("dataset_"), F.col("d.id").cast("string")))
    return joined.select(
        "d.*",
        F.coalesce(F.col("t.column_name"), F.col("d.target_column")).alias("resolved_target"),
        table.alias("table_name"),
        problem.alias("inferred_problem_type"),
    ).orderBy(F.col("d.id"))
