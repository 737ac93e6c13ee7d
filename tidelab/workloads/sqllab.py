"""SQL-lab workloads (F2, F4, F6 and the SQL-text categories of §2.K). The same text runs on Spark
through the guarded lab and on DuckDB as the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelab.plans.sqllab import SqlLab, query_history
from tidelab.session import read_table
from tidelab.workloads import register

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "labels", "documents", "events"]

SQL = {
    "sql_revenue_by_region": """
SELECT r_name AS region, ROUND(SUM(l_extendedprice * (1 - l_discount)) * 100) / 100 AS total_revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
ORDER BY total_revenue DESC""",
    "sql_avg_by_category": """
SELECT p_type AS product_category, ROUND(AVG(p_size) * 100) / 100 AS avg_units
FROM part GROUP BY p_type ORDER BY avg_units DESC""",
    "sql_rate_by_plan": """
SELECT d.lang AS plan, ROUND(AVG(l.quality) * 100 * 100) / 100 AS churn_rate_pct
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
GROUP BY d.lang ORDER BY churn_rate_pct DESC""",
    "sql_avg_mrr_by_region": """
SELECT c_mktsegment AS region, ROUND(AVG(c_acctbal) * 100) / 100 AS avg_mrr
FROM customer GROUP BY c_mktsegment ORDER BY avg_mrr DESC""",
    "sql_cte": """
WITH per_customer AS (
  SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey
)
SELECT n_orders AS orders_per_customer, COUNT(*) AS customers
FROM per_customer GROUP BY n_orders""",
    "sql_window": """
SELECT o_orderkey, o_custkey,
       CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn,
       ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100) / 100 AS running_total
FROM orders""",
    "sql_setop": """
(SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'
 INTERSECT
 SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION
(SELECT c_custkey FROM customer WHERE c_nationkey = 0
 EXCEPT
 SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
    "sql_join_star": """
SELECT n_name AS nation, COUNT(*) AS order_count, COUNT(DISTINCT o_custkey) AS customer_count,
       ROUND(SUM(o_totalprice) * 100) / 100 AS total_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""",
    "sql_rollup": """
SELECT l_returnflag, l_linestatus, COUNT(*) AS line_count, ROUND(SUM(l_quantity) * 100) / 100 AS sum_qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_semi_anti": """
SELECT c_mktsegment AS segment,
       COUNT(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders,
       COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_orders
FROM customer GROUP BY c_mktsegment""",
    "sql_having": """
SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10""",
}


_LABS: dict[tuple[str, str], SqlLab] = {}


def _lab(spark, sf_dir) -> SqlLab:
    """Lab over the supplied tables in a child session (same SparkContext, own temp views), so the
    caller's views are never replaced; one child per folder, views registered once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    lab = _LABS.get(key)
    if lab is None:
        lab = SqlLab(spark.newSession())
        lab.register_tables(sf_dir, TABLES)
        _LABS[key] = lab
    own = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")}
    for k, v in own.items():  # the caller's settings hold in the lab's session too
        if lab.spark.conf.isModifiable(k) and lab.spark.conf.get(k, None) != v:
            lab.spark.conf.set(k, v)
    return lab


def _make(name: str, text: str):
    def run(spark, sf_dir):
        res = _lab(spark, sf_dir).run(text, name=name)
        if not res.ok:
            raise RuntimeError(res.error)
        return res.df

    run.__name__ = name
    return run


for _name, _text in SQL.items():
    register(_name, _text)(_make(_name, _text))


@register(
    "sql_history",
    """
SELECT o_orderkey AS id, o_custkey AS dataset_id, o_orderpriority AS query_name, o_orderstatus AS query_text,
       o_orderdate AS created_at
FROM orders ORDER BY id DESC""",
)
def sql_history(spark, sf_dir):
    """History listing over a log derived from ``orders`` (one entry per order)."""
    o = read_table(spark, sf_dir, "orders")
    log = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderpriority").alias("query_name"), F.col("o_orderstatus").alias("query_text"),
        F.col("o_orderdate").alias("created_at"),
    )
    return query_history(log)
