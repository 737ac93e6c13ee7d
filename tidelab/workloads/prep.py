"""Data-preparation workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelab.operators.prep import Derived, latest_preparation, list_preparations, prepare
from tidelab.session import read_table
from tidelab.workloads import register


@register(
    "prepare_select_rename",
    "SELECT l_quantity AS qty, l_discount, l_extendedprice AS price, l_tax, l_returnflag AS flag FROM lineitem",
)
def prepare_select_rename(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    out, _ = prepare(
        li, "l_returnflag", ["l_quantity", " l_discount ", "l_extendedprice", "l_quantity", "l_tax", "l_returnflag"],
        rename={"l_quantity": "qty", "l_extendedprice": "price", "l_returnflag": "flag", "l_tax": "  "},
    )
    return out


@register(
    "derived_concat",
    """
SELECT c_name, c_mktsegment,
       COALESCE(CAST(c_name AS VARCHAR), '') || ' / ' || COALESCE(CAST(c_nationkey AS VARCHAR), '') AS name_nation,
       COALESCE(CAST(c_mktsegment AS VARCHAR), '') AS segment_text
FROM customer""",
)
def derived_concat(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    out, _ = prepare(
        c, "c_mktsegment", ["c_name"],
        derived=[Derived("name_nation", "concat", "c_name", "c_nationkey", " / "), {"name": "segment_text", "op": "concat", "left": "c_mktsegment"}],
        allow_target=True,
    )
    return out


def _arith(name, op, left, right, sql_expr):
    @register(
        f"derived_{name}",
        f"SELECT l_orderkey, l_linenumber, CAST({sql_expr} AS DOUBLE) AS {name}_col FROM lineitem",
    )
    def run(spark, sf_dir):
        li = read_table(spark, sf_dir, "lineitem")
        out, _ = prepare(li, "l_linenumber", ["l_orderkey"], derived=[Derived(f"{name}_col", op, left, right)])
        return out

    return run


_arith("sum", "sum", "l_extendedprice", "l_tax", "l_extendedprice + l_tax")
_arith("difference", "difference", "l_extendedprice", "l_discount", "l_extendedprice - l_discount")
_arith("product", "product", "l_quantity", "l_extendedprice", "l_quantity * l_extendedprice")
_arith("ratio_real", "ratio", "l_extendedprice", "l_discount", "l_extendedprice / NULLIF(l_discount, 0)")
_arith("ratio_int", "ratio", "l_orderkey", "l_partkey", "l_orderkey // NULLIF(l_partkey, 0)")


def _prep_log(spark, sf_dir):
    """A preparation log derived from ``orders``: one preparation per order, customer as dataset."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderpriority").alias("version_name"), F.col("o_orderstatus").alias("target_column"),
        F.col("o_orderdate").alias("created_at"),
    )


@register(
    "latest_preparation",
    """
SELECT dataset_id, max_by(id, id) AS id, max_by(version_name, id) AS version_name,
       max_by(target_column, id) AS target_column, max_by(created_at, id) AS created_at
FROM (SELECT o_orderkey AS id, o_custkey AS dataset_id, o_orderpriority AS version_name,
             o_orderstatus AS target_column, o_orderdate AS created_at FROM orders)
GROUP BY dataset_id""",
)
def latest_preparation_q(spark, sf_dir):
    return latest_preparation(_prep_log(spark, sf_dir))


@register(
    "list_preparations",
    """
SELECT o_orderkey AS id, o_custkey AS dataset_id, o_orderpriority AS version_name,
       o_orderstatus AS target_column, o_orderdate AS created_at FROM orders ORDER BY id DESC""",
)
def list_preparations_q(spark, sf_dir):
    return list_preparations(_prep_log(spark, sf_dir))
