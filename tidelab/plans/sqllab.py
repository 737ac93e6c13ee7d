"""SQL lab (F1–F8): guarded read-only SQL over registered views, with an append-only history.

Queries run through ``spark.sql`` — Catalyst plans them like any DataFrame job (pushdown, pruning,
join selection, AQE). The history is a Parquet log under the shared checkpoint folder; a query is
logged once it has parsed, passed the guard and been analysed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelab.plans.guard import SqlGuardError, check_read_only
from tidelab.sources.catalog import AppendLog

HISTORY_SCHEMA = "id long, dataset_id long, query_name string, query_text string, created_at timestamp"
# Default history name length.
DEFAULT_NAME_CHARS = 80

# The saved example queries.
EXAMPLES = {
    "Retail - revenue by region": "SELECT region, ROUND(SUM(revenue), 2) AS total_revenue FROM retail_sales GROUP BY region ORDER BY total_revenue DESC",
    "Retail - average units by category": "SELECT product_category, ROUND(AVG(units_sold), 2) AS avg_units FROM retail_sales GROUP BY product_category ORDER BY avg_units DESC",
    "SaaS - churn rate by plan": "SELECT plan, ROUND(AVG(churn) * 100, 2) AS churn_rate_pct FROM saas_churn GROUP BY plan ORDER BY churn_rate_pct DESC",
    "SaaS - average MRR by region": "SELECT region, ROUND(AVG(mrr_usd), 2) AS avg_mrr FROM saas_churn GROUP BY region ORDER BY avg_mrr DESC",
}


@dataclass
class SqlResult:
    ok: bool
    df: DataFrame | None = None
    error: str | None = None


def default_query_name(query: str) -> str:
    return query.strip()[:DEFAULT_NAME_CHARS]


class SqlLab:
    """Guarded SQL over temp views. ``history_path`` (optional) enables the query log."""

    def __init__(self, spark: SparkSession, history_path: str | None = None):
        self.spark = spark
        self.history_log = AppendLog(spark, history_path, HISTORY_SCHEMA) if history_path else None

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def register_tables(self, sf_dir: str, names: list[str]) -> None:
        for n in names:
            self.spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet").createOrReplaceTempView(n)

    def check(self, query: str) -> None:
        check_read_only(self.spark, query)

    def run(self, query: str, dataset_id: int | None = None, name: str | None = None) -> SqlResult:
        """Guard, analyse and return the lazy result; errors come back as a result, not raised."""
        try:
            self.check(query)
            df = self.spark.sql(query.strip().rstrip(";"))
        except (SqlGuardError, AnalysisException, ParseException) as e:
            return SqlResult(ok=False, error=str(e).split("\n", 1)[0])
        if self.history_log is not None:
            self.log(query, dataset_id, name)
        return SqlResult(ok=True, df=df)

    def log(self, query: str, dataset_id: int | None = None, name: str | None = None) -> None:
        row = (dataset_id, name or default_query_name(query), query, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        batch = self.spark.createDataFrame([row], "dataset_id long, query_name string, query_text string, created_at timestamp")
        self.history_log.append(batch)

    def log_chart(self, table: str, chart_type: str, x: str, y: str | None = None, aggregation: str = "sum",
                  limit: int = 12, dataset_id: int | None = None) -> None:
        """Chart queries are logged too, under ``DataViz <type> - <x> / <y>`` (F8)."""
        from tidelab.operators.charts import chart_query_name, chart_sql

        self.log(chart_sql(table, chart_type, x, y, aggregation, limit), dataset_id, chart_query_name(chart_type, x, y))

    def history(self, dataset_id: int | None = None) -> DataFrame:
        return query_history(self.history_log.read(), dataset_id)


def query_history(log: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """History listing, newest first, optionally for one dataset."""
    if dataset_id is not None:
        log = log.where(F.col("dataset_id") == F.lit(dataset_id))
    return log.orderBy(F.col("id").desc())
