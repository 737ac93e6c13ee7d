"""Typing workloads (B3, B4, B6, B9) on text fixtures derived from ``customer``/``orders``/``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelab.functions.text import to_number
from tidelab.operators.schema import coerce, drop_blank_rows, infer_types
from tidelab.session import read_table
from tidelab.workloads import register
from tidelab.workloads.fixtures import CUSTOMER_TEXT, DUCK_TRIM_PATTERN, customer_text, duck_trim, customer_text_sql

# Types the oracle must find for the fixture columns (also asserted in tests).
EXPECTED_TYPES = {
    "cust_id": "INTEGER",
    "name": "TEXT",
    "nation_code": "INTEGER",
    "balance": "REAL",
    "segment": "TEXT",
    "mixed_num": "REAL",
    "expo": "TEXT",
    "empty_col": "TEXT",
}
_SPARK_TYPE = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}


def _infer_sql() -> str:
    parts = []
    for i, name in enumerate(CUSTOMER_TEXT):
        t = duck_trim(name)
        nb = f"count_if({t} <> '')"
        il = f"count_if(regexp_full_match({t}, '-?[0-9]+'))"
        rl = f"count_if(regexp_full_match({t}, '-?[0-9]+(\\.[0-9]+)?'))"
        dtype = f"CASE WHEN {nb} = 0 THEN 'TEXT' WHEN {il} = {nb} THEN 'INTEGER' WHEN {rl} = {nb} THEN 'REAL' ELSE 'TEXT' END"
        parts.append(
            f"SELECT {i} AS ordinal, '{name}' AS column_name, {dtype} AS data_type, "
            f"CASE {dtype} WHEN 'INTEGER' THEN 'bigint' WHEN 'REAL' THEN 'double' ELSE 'string' END AS spark_type FROM fx"
        )
    return f"WITH fx AS ({customer_text_sql()})\n" + "\nUNION ALL\n".join(parts)


@register("infer_types", _infer_sql())
def infer_types_q(spark, sf_dir):
    return infer_types(customer_text(spark, sf_dir))


def _coerce_sql() -> str:
    cols = []
    for name, dtype in EXPECTED_TYPES.items():
        t = duck_trim(name)
        if dtype == "TEXT":
            cols.append(f"CASE WHEN {name} IS NULL OR {t} = '' THEN NULL ELSE {name} END AS {name}")
        else:
            cols.append(f"CASE WHEN {t} = '' THEN NULL ELSE TRY_CAST({t} AS {_SPARK_TYPE[dtype].upper()}) END AS {name}")
    return f"WITH fx AS ({customer_text_sql()})\nSELECT " + ",\n  ".join(cols) + " FROM fx"


@register("coerce_types", _coerce_sql())
def coerce_types_q(spark, sf_dir):
    fx = customer_text(spark, sf_dir)
    types = {r["column_name"]: r["spark_type"] for r in infer_types(fx).collect()}
    return coerce(fx, types)


@register(
    "drop_blank_rows",
    """
WITH fx AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status,
         CASE WHEN o_orderkey % 2 = 0 THEN chr(9) || ' ' ELSE o_orderpriority END AS priority
  FROM orders)
SELECT status, priority FROM fx
WHERE NOT (regexp_replace(status, '{p}', '', 'g') = '' AND regexp_replace(priority, '{p}', '', 'g') = '')""".replace("{p}", DUCK_TRIM_PATTERN),
)
def drop_blank_rows_q(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    fx = o.select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("\t ")).otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    return drop_blank_rows(fx)


@register(
    "to_number",
    """
SELECT l_orderkey, l_linenumber,
       TRY_CAST(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS VARCHAR) ELSE l_returnflag END AS DOUBLE) AS num
FROM lineitem""",
)
def to_number_q(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    txt = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("string")).otherwise(F.col("l_returnflag"))
    return li.select("l_orderkey", "l_linenumber", to_number(txt).alias("num"))
