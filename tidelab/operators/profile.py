"""Profiling (C1–C10): null and distinct counts per column, target statistics, summaries.

Exact distinct counts avoid ``count(distinct)`` over many columns in one aggregate (Catalyst adds an
``Expand`` that multiplies every row by the column count and shuffles each column): the table is
unpivoted to ``(column, value)`` and grouped twice, so map-side partial aggregation collapses
repeated values before the shuffle and only distinct pairs cross the network.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelab.functions.text import is_blank, js_trim, round_value
from tidelab.operators.schema import INTEGER, REAL, TEXT, at_most_two_values, type_name

PREVIEW_ROWS = 10


def _is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _null_cond(df: DataFrame, c: str):
    return is_blank(F.col(c)) if _is_string(df, c) else F.col(c).isNull()


def _text_value(df: DataFrame, c: str):
    """Trimmed non-blank text of a cell, null otherwise (the distinct key)."""
    if _is_string(df, c):
        t = js_trim(F.col(c))
        return F.when(t != F.lit(""), t)
    return F.col(c).cast("string")


def null_counts(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """``(ordinal, column_name, data_type, null_count)`` in one single-row aggregate."""
    types = types or {}
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("column_name"),
            F.lit(types.get(c) or type_name(df.schema[c].dataType)).alias("data_type"),
            F.count_if(_null_cond(df, c)).alias("null_count"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(F.array(*entries).alias("_n")).select(F.inline("_n"))


def distinct_counts(df: DataFrame, approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """``(column_name, unique_count)`` over trimmed non-blank values.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``) in one aggregate — constant
    memory per column, the choice for very wide or very large tables.
    """
    if approx:
        entries = [
            F.struct(F.lit(c).alias("column_name"), F.approx_count_distinct(_text_value(df, c), rsd).cast("long").alias("unique_count"))
            for c in df.columns
        ]
        return df.agg(F.array(*entries).alias("_d")).select(F.inline("_d"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _text_value(df, c).alias("value")) for c in df.columns])
    long = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    per_value = long.select("column_name", "value").distinct()
    counted = per_value.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    # Columns without any value get 0, not a missing row.
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    return names.join(F.broadcast(counted), "column_name", "left").select(
        "column_name", F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count")
    )


def profile_columns(
    df: DataFrame, target: str | None = None, approx: bool = False, types: dict[str, str] | None = None
) -> DataFrame:
    """Column metadata: ``(ordinal, column_name, data_type, is_target, has_nulls, null_count, unique_count)``.

    Exact mode is one scan: cells are unpivoted to ``(column, value)`` (null for null/blank cells)
    and counted per pair with map-side combine; a second aggregate per column turns pair counts into
    the distinct count (non-null pairs) and the null count (the null pair's count). ``types``
    overrides the type names (text columns typed by ``infer_types`` before coercion).
    """
    types = types or {}
    meta = [(i, c, types.get(c) or type_name(df.schema[c].dataType)) for i, c in enumerate(df.columns)]
    if approx:
        nulls = null_counts(df, types)
        uniq = distinct_counts(df, approx=True)
        # Both sides have one row per column (a bound known at plan time).
        base = uniq.join(F.broadcast(nulls), "column_name")
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("ordinal"), _text_value(df, c).alias("value")) for i, c, _ in meta])
        cells = df.select(F.inline(pairs))
        per_pair = cells.groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
        per_col = per_pair.groupBy("ordinal").agg(
            F.count("value").alias("unique_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        )
        names = df.sparkSession.createDataFrame(meta, "ordinal int, column_name string, data_type string")
        # One row per column on each side: the name table is broadcast.
        base = per_col.join(F.broadcast(names), "ordinal", "right").select(
            "ordinal", "column_name", "data_type",
            F.coalesce("null_count", F.lit(0)).alias("null_count"), F.coalesce("unique_count", F.lit(0)).alias("unique_count"))
    return base.select(
        "ordinal",
        "column_name",
        "data_type",
        (F.col("column_name") == F.lit(target or "")).cast("int").alias("is_target"),
        (F.col("null_count") > 0).cast("int").alias("has_nulls"),
        F.col("null_count").cast("long").alias("null_count"),
        F.col("unique_count").cast("long").alias("unique_count"),
    )


def text_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """Type inference and profile of raw text columns in one scan:
    ``(ordinal, column_name, data_type, spark_type, is_target, has_nulls, null_count, unique_count)``.

    Cells are unpivoted to ``(column, trimmed value)`` and counted per pair (map-side combined);
    the integer/real patterns are then tested once per *distinct* value rather than once per cell —
    a column is INTEGER iff all its distinct non-blank values are integer-like.
    """
    from tidelab.functions.text import INT_PATTERN, REAL_PATTERN
    from tidelab.operators.schema import digits, storage_type

    cols = df.columns
    pairs = F.array(*[F.struct(F.lit(i).alias("ordinal"), _text_value(df, c).alias("value")) for i, c in enumerate(cols)])
    per_pair = df.select(F.inline(pairs)).groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value")
    is_int = v.rlike(INT_PATTERN)
    per_col = per_pair.groupBy("ordinal").agg(
        F.count(v).alias("unique_count"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(is_int).alias("_int"),
        F.count_if(v.rlike(REAL_PATTERN)).alias("_real"),
        F.max(F.when(is_int, digits(v))).alias("_widest"),
    )
    u = F.col("unique_count")
    dtype = (F.when(u == 0, F.lit(TEXT)).when(F.col("_int") == u, F.lit(INTEGER))
             .when(F.col("_real") == u, F.lit(REAL)).otherwise(F.lit(TEXT)))
    spark_type = storage_type(dtype, F.col("_widest"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "ordinal int, column_name string")
    # One row per column on each side: the name table is broadcast.
    j = per_col.join(F.broadcast(names), "ordinal", "right")
    return j.select(
        "ordinal", "column_name", dtype.alias("data_type"), spark_type.alias("spark_type"),
        (F.col("column_name") == F.lit(target or "")).cast("int").alias("is_target"),
        (F.coalesce("null_count", F.lit(0)) > 0).cast("int").alias("has_nulls"),
        F.coalesce("null_count", F.lit(0)).cast("long").alias("null_count"),
        F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    """``(row_count, column_count)``."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.lit(len(df.columns)).cast("long").alias("column_count"))


def profile_summary(profile: DataFrame) -> DataFrame:
    """Totals over a ``profile_columns`` result: total nulls, numeric and categorical column counts."""
    return profile.agg(
        F.coalesce(F.sum("null_count"), F.lit(0)).cast("long").alias("total_nulls"),
        F.count_if(F.col("data_type").isin(INTEGER, REAL)).cast("long").alias("numeric_count"),
        F.count_if(~F.col("data_type").isin(INTEGER, REAL)).cast("long").alias("categorical_count"),
        F.count(F.lit(1)).cast("long").alias("column_count"),
    )


def target_kind(df: DataFrame, target: str) -> str:
    """``text`` | ``binary`` (numeric, ≤ 2 distinct values) | ``numeric``."""
    if type_name(df.schema[target].dataType) == TEXT:
        return "text"
    return "binary" if at_most_two_values(df, target) else "numeric"


def target_stats(df: DataFrame, target: str, kind: str | None = None) -> DataFrame:
    """One-row target statistics.

    * text: ``total_rows, class_count`` (distinct classes);
    * binary: ``total_rows, target_positive_rate_pct`` = round(avg·100, 2);
    * numeric: ``total_rows, avg_target`` = round(avg, 2).
    """
    kind = kind or target_kind(df, target)
    n = F.count(F.lit(1)).alias("total_rows")
    if kind == "text":
        return df.agg(n, F.count_distinct(F.col(target)).alias("class_count"))
    if kind == "binary":
        return df.agg(n, round_value(F.avg(F.col(target)) * F.lit(100.0), 2).alias("target_positive_rate_pct"))
    return df.agg(n, round_value(F.avg(F.col(target)), 2).alias("avg_target"))


def problem_types(profile: DataFrame) -> DataFrame:
    """``(column_name, data_type, problem_type)`` if each column were the target."""
    return profile.select(
        "column_name",
        "data_type",
        F.when(F.col("data_type") == F.lit(TEXT), F.lit("classification"))
        .when(F.col("unique_count") <= 2, F.lit("classification"))
        .otherwise(F.lit("regression"))
        .alias("problem_type"),
    )


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (``order_by`` makes the choice deterministic)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def describe_columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """Schema introspection without a job: ``(column_name, spark_type, data_type)``."""
    return [(f.name, f.dataType.simpleString(), type_name(f.dataType)) for f in df.schema.fields]


@dataclass
class Profile:
    columns: DataFrame
    preview: DataFrame
    stats: DataFrame
    problem_type: str
    target: str | None


def profile(df: DataFrame, target: str | None = None, approx: bool = False) -> Profile:
    """Full profile: column metadata, preview, target statistics and inferred problem type."""
    cols = profile_columns(df, target, approx=approx)
    if target:
        kind = target_kind(df, target)
        stats = target_stats(df, target, kind)
        problem = "regression" if kind == "numeric" else "classification"
    else:
        stats = table_shape(df).select(F.col("row_count").alias("total_rows"))
        problem = "regression"
    return Profile(columns=cols, preview=preview(df), stats=stats, problem_type=problem, target=target)
