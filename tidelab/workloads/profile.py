"""Profiling workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelab.operators.profile import distinct_counts, problem_types, profile_columns, profile_summary, table_shape, target_stats
from tidelab.operators.sketches import column_sketches, sketch_estimates
from tidelab.session import read_table, scratch_dir
from tidelab.sources.catalog import LOG_SCHEMAS, AppendLog
from tidelab.workloads import register
from tidelab.workloads.fixtures import CUSTOMER_TEXT, DUCK_TRIM_PATTERN, customer_text, duck_trim, customer_text_sql


def _profile_sql(table_sql: str, columns: list[tuple[str, str, bool]], target: str) -> str:
    """columns: (name, data_type, is_string)."""
    parts = []
    for i, (c, dtype, is_str) in enumerate(columns):
        if is_str:
            t = duck_trim(c)
            nulls = f"CAST(count_if({c} IS NULL OR {t} = '') AS BIGINT)"
            uniq = f"count(DISTINCT CASE WHEN {t} <> '' THEN {t} END)"
        else:
            nulls = f"CAST(count_if({c} IS NULL) AS BIGINT)"
            uniq = f"count(DISTINCT {c})"
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, '{dtype}' AS data_type, "
            f"{1 if c == target else 0} AS is_target, CASE WHEN {nulls} > 0 THEN 1 ELSE 0 END AS has_nulls, "
            f"{nulls} AS null_count, {uniq} AS unique_count FROM t"
        )
    return f"WITH t AS ({table_sql})\n" + "\nUNION ALL\n".join(parts)


CUSTOMER_COLS = [
    ("c_custkey", "INTEGER", False),
    ("c_name", "TEXT", True),
    ("c_nationkey", "INTEGER", False),
    ("c_acctbal", "REAL", False),
    ("c_mktsegment", "TEXT", True),
]


@register("profile_columns", _profile_sql("SELECT * FROM customer", CUSTOMER_COLS, "c_mktsegment"))
def profile_columns_q(spark, sf_dir):
    return profile_columns(read_table(spark, sf_dir, "customer"), target="c_mktsegment")


@register(
    "profile_columns_text",
    _profile_sql(customer_text_sql(), [(c, "TEXT", True) for c in CUSTOMER_TEXT], "segment"),
)
def profile_columns_text_q(spark, sf_dir):
    return profile_columns(customer_text(spark, sf_dir), target="segment")


ORDERS_COLS = [
    ("o_orderkey", "INTEGER", False),
    ("o_custkey", "INTEGER", False),
    ("o_orderstatus", "TEXT", True),
    ("o_totalprice", "REAL", False),
    ("o_orderdate", "TEXT", False),
    ("o_orderpriority", "TEXT", True),
]


@register(
    "profile_summary",
    f"""
WITH p AS ({_profile_sql("SELECT * FROM orders", ORDERS_COLS, "o_orderstatus")})
SELECT CAST(sum(null_count) AS BIGINT) AS total_nulls,
       CAST(count_if(data_type IN ('INTEGER','REAL')) AS BIGINT) AS numeric_count,
       CAST(count_if(data_type NOT IN ('INTEGER','REAL')) AS BIGINT) AS categorical_count,
       count(*) AS column_count
FROM p""",
)
def profile_summary_q(spark, sf_dir):
    return profile_summary(profile_columns(read_table(spark, sf_dir, "orders"), target="o_orderstatus"))


@register("table_shape", "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem")
def table_shape_q(spark, sf_dir):
    return table_shape(read_table(spark, sf_dir, "lineitem"))


@register(
    "target_stats_text",
    "SELECT count(*) AS total_rows, count(DISTINCT o_orderstatus) AS class_count FROM orders",
)
def target_stats_text_q(spark, sf_dir):
    return target_stats(read_table(spark, sf_dir, "orders"), "o_orderstatus")


@register(
    "target_stats_binary",
    "SELECT count(*) AS total_rows, ROUND(AVG(quality) * 100 * 100) / 100 AS target_positive_rate_pct FROM labels",
)
def target_stats_binary_q(spark, sf_dir):
    return target_stats(read_table(spark, sf_dir, "labels"), "quality")


@register(
    "target_stats_numeric",
    "SELECT count(*) AS total_rows, ROUND(AVG(l_quantity) * 100) / 100 AS avg_target FROM lineitem",
)
def target_stats_numeric_q(spark, sf_dir):
    return target_stats(read_table(spark, sf_dir, "lineitem"), "l_quantity")


LABEL_COLS = [("doc_id", "INTEGER", False), ("quality", "INTEGER", False), ("toxic", "INTEGER", False)]


@register(
    "problem_types",
    f"""
WITH p AS ({_profile_sql("SELECT * FROM labels", LABEL_COLS, "quality")})
SELECT column_name, data_type,
       CASE WHEN data_type = 'TEXT' THEN 'classification' WHEN unique_count <= 2 THEN 'classification'
            ELSE 'regression' END AS problem_type
FROM p""",
)
def problem_types_q(spark, sf_dir):
    return problem_types(profile_columns(read_table(spark, sf_dir, "labels"), target="quality"))


from tidelab.operators.profile import preview  # noqa: E402
from tidelab.sources.catalog import ensure_columns  # noqa: E402


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_q(spark, sf_dir):
    """First 10 rows (A4), made deterministic by the key order."""
    return preview(read_table(spark, sf_dir, "orders"), 10, order_by=["o_orderkey"])


@register(
    "schema_evolution",
    """
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_comment,
       CAST(NULL AS INTEGER) AS o_shippriority
FROM orders""",
)
def schema_evolution_q(spark, sf_dir):
    """Older rows read against a newer schema: missing columns appear as typed nulls."""
    old = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ensure_columns(old, "o_orderkey long, o_custkey long, o_totalprice double, o_comment string, o_shippriority int")


from tidelab.operators.profile import text_profile  # noqa: E402
from tidelab.workloads.schema import _infer_sql  # noqa: E402


@register(
    "text_profile",
    f"""
WITH p AS ({_profile_sql(customer_text_sql(), [(c, "TEXT", True) for c in CUSTOMER_TEXT], "segment")}),
i AS ({_infer_sql()})
SELECT p.ordinal, p.column_name, i.data_type, i.spark_type, p.is_target, p.has_nulls, p.null_count, p.unique_count
FROM p JOIN i ON p.column_name = i.column_name""",
)
def text_profile_q(spark, sf_dir):
    """Type inference and profile of raw text in one scan (what CSV ingest uses)."""
    return text_profile(customer_text(spark, sf_dir), target="segment")


_SKETCHED = ("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")


def _sketch_sql(c: str) -> str:
    numeric = "NULL::BOOLEAN" if c in ("l_returnflag", "l_linestatus") else "TRUE"
    return f"""
SELECT '{c}' AS column_name, count(*)::BIGINT AS cells, count_if({c} IS NULL)::BIGINT AS missing, count(DISTINCT {c})::BIGINT AS distinct_count,
       TRUE AS distinct_within, TRUE AS same_as_whole, {numeric} AS median_within,
       CASE WHEN count(DISTINCT {c}) <= 100
            THEN (SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v)
                  FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) END AS heavy
FROM lineitem"""


@register("sketches_appended", " UNION ALL ".join(_sketch_sql(c) for c in _SKETCHED))
def sketches_appended(spark, sf_dir):
    """(C2, C7) Sketches of three parts of the line items, appended to a log one after the other and merged
    by column, held against exact counts: distinct counts within three standard errors and the same as those of the
    whole, medians within 1 % of the rows, frequent items of columns with few values."""
    li = read_table(spark, sf_dir, "lineitem").select(*_SKETCHED)
    log = AppendLog(spark, scratch_dir(spark, "sketches"), LOG_SCHEMAS["column_sketches"])
    for part in range(3):
        log.append(column_sketches(li.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(3)) == part)))
    found = sketch_estimates(log.read(), quantiles=(0.5,), top=3)
    whole = sketch_estimates(column_sketches(li)).select("column_name", F.col("unique_count").alias("whole_count"))
    exact = distinct_counts(li).withColumnRenamed("unique_count", "distinct_count")
    numbers = [c for c in _SKETCHED if c not in ("l_returnflag", "l_linestatus")]
    cells = li.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in numbers])))
    # A row per column: the sides of these joins are as small as the table is wide.
    median = F.broadcast(found.select("column_name", F.col("quantiles")[0].alias("median")))
    ranks = cells.where("v is not null").join(median, "column_name").groupBy("column_name").agg(
        ((F.avg((F.col("v") < F.col("median")).cast("int")) <= 0.51) & (F.avg((F.col("v") <= F.col("median")).cast("int")) >= 0.49)).alias("median_within")
    )
    joined = found.join(whole, "column_name").join(exact, "column_name").join(ranks, "column_name", "left")
    heavy = F.array_join(F.transform("heavy", lambda h: F.concat_ws(":", h["item"], h["count"].cast("string"))), ",")
    return joined.select(
        "column_name", "cells", "missing", "distinct_count",
        (F.abs(F.col("unique_count") / F.col("distinct_count") - 1) <= 3 * 1.04 / 64).alias("distinct_within"),
        (F.col("unique_count") == F.col("whole_count")).alias("same_as_whole"), "median_within",
        F.when(F.col("distinct_count") <= 100, heavy).alias("heavy"),
    )
