"""Chart workloads (E1–E9) over the supplied tables."""

from __future__ import annotations

from tidelab.operators.charts import chart_data
from tidelab.session import read_table
from tidelab.workloads import register


def _grouped_sql(table, x, agg_sql, limit, order="value DESC, label ASC"):
    return f"""
SELECT CAST({x} AS VARCHAR) AS label, COALESCE(ROUND(CAST({agg_sql} AS DOUBLE) * 100) / 100, 0.0) AS value
FROM {table} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY {order} LIMIT {limit}"""


@register("chart_bar_sum", _grouped_sql("orders", "o_orderpriority", "SUM(o_totalprice)", 12))
def chart_bar_sum(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "orders"), "bar", "o_orderpriority", "o_totalprice", "sum", 12)


@register("chart_bar_avg", _grouped_sql("part", "p_brand", "AVG(p_retailprice)", 12))
def chart_bar_avg(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "part"), "bar", "p_brand", "p_retailprice", "avg", 12)


@register("chart_bar_count", _grouped_sql("events", "event_type", "COUNT(*)", 12))
def chart_bar_count(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "events"), "bar", "event_type", "value", "count", 12)


@register("chart_bar_min", _grouped_sql("customer", "c_mktsegment", "MIN(c_acctbal)", 12))
def chart_bar_min(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "customer"), "bar", "c_mktsegment", "c_acctbal", "min", 12)


@register("chart_bar_max", _grouped_sql("supplier", "s_nationkey", "MAX(s_acctbal)", 12))
def chart_bar_max(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "supplier"), "bar", "s_nationkey", "s_acctbal", "max", 12)


@register("chart_line", _grouped_sql("orders", "o_orderdate", "AVG(o_totalprice)", 24, "value ASC, label ASC"))
def chart_line(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "orders"), "line", "o_orderdate", "o_totalprice", "avg", 24)


@register("chart_line_by_label", _grouped_sql("lineitem", "l_shipdate", "AVG(l_quantity)", 24, "label ASC"))
def chart_line_by_label(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "lineitem"), "line", "l_shipdate", "l_quantity", "avg", 24, order_by="label")


@register(
    "chart_pie_share",
    f"""
WITH top AS ({_grouped_sql("lineitem", "l_returnflag", "SUM(l_extendedprice)", 8)})
SELECT label, value, ROUND(value / SUM(value) OVER () * 10000) / 10000 AS share FROM top""",
)
def chart_pie_share(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "lineitem"), "pie", "l_returnflag", "l_extendedprice", "sum", 8)


@register(
    "chart_scatter",
    """
SELECT TRY_CAST(l_quantity AS DOUBLE) AS x, TRY_CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
ORDER BY l_orderkey, l_linenumber LIMIT 200""",
)
def chart_scatter(spark, sf_dir):
    return chart_data(
        read_table(spark, sf_dir, "lineitem"), "scatter", "l_quantity", "l_extendedprice",
        limit=200, scatter_order=["l_orderkey", "l_linenumber"],
    )


@register("chart_no_y", _grouped_sql("part", "p_type", "COUNT(*)", 30))
def chart_no_y(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "part"), "bar", "p_type", None, "sum", 30)
