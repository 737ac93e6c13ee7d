"""Typing of raw text columns (B3–B6) and plan-time schema helpers.

``infer_types`` is a single aggregate: for every column three ``count_if`` (non-blank, integer-like,
real-like) computed map-side, so the shuffle carries one partial row per task whatever the size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelab.functions.naming import sanitize_identifier
from tidelab.functions.text import INT_PATTERN, REAL_PATTERN, is_blank, js_trim

INTEGER, REAL, TEXT = "INTEGER", "REAL", "TEXT"
# Integer-like text longer than this many digits does not fit a bigint safely, nor a decimal.
MAX_BIGINT_DIGITS, MAX_DECIMAL_DIGITS = 18, 38

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def type_name(dtype: T.DataType) -> str:
    """Workbench type name of a Spark type."""
    if isinstance(dtype, _INTEGRAL):
        return INTEGER
    if isinstance(dtype, _FRACTIONAL):
        return REAL
    return TEXT


def digits(text) -> Column:
    """Number of digits of integer-like text."""
    return F.length(F.regexp_replace(text, "^-", ""))


def storage_type(dtype: Column, widest: Column) -> Column:
    """Spark type that keeps every value of a column of type ``dtype`` whose widest integer has
    ``widest`` digits. Integers beyond a decimal become doubles: rounded, never lost."""
    return (
        F.when(
            dtype == F.lit(INTEGER),
            F.when(widest > MAX_DECIMAL_DIGITS, F.lit("double"))
            .when(widest > MAX_BIGINT_DIGITS, F.lit("decimal(38,0)"))
            .otherwise(F.lit("bigint")),
        )
        .when(dtype == F.lit(REAL), F.lit("double"))
        .otherwise(F.lit("string"))
    )


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(ordinal, column_name, data_type, spark_type)`` for text columns.

    A column is INTEGER when every trimmed non-blank value matches ``-?\\d+``, REAL when every one
    matches ``-?\\d+(\\.\\d+)?``, TEXT otherwise or when it has no non-blank value.
    """
    cols = columns or df.columns
    trimmed = df.select(*[js_trim(F.col(c).cast("string")).alias(c) for c in cols])
    entries = []
    for i, c in enumerate(cols):
        v = F.col(c)
        non_blank = F.count_if(v != F.lit(""))
        int_like = F.count_if(v.rlike(INT_PATTERN))
        real_like = F.count_if(v.rlike(REAL_PATTERN))
        widest = F.max(F.when(v.rlike(INT_PATTERN), digits(v)))
        dtype = (
            F.when(non_blank == 0, F.lit(TEXT))
            .when(int_like == non_blank, F.lit(INTEGER))
            .when(real_like == non_blank, F.lit(REAL))
            .otherwise(F.lit(TEXT))
        )
        spark_type = storage_type(dtype, widest)
        entries.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(c).alias("column_name"),
                dtype.alias("data_type"),
                spark_type.alias("spark_type"),
            )
        )
    return trimmed.agg(F.array(*entries).alias("_t")).select(F.inline("_t"))


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Blank → null; INTEGER / REAL parsed from the trimmed text; TEXT keeps the untrimmed value.

    ``types`` maps column → Spark type string (``bigint``, ``decimal(38,0)``, ``double``, ``string``)
    or workbench type name.
    """
    alias = {INTEGER: "bigint", REAL: "double", TEXT: "string"}
    out = []
    for c in df.columns:
        target = alias.get(types.get(c, "string"), types.get(c, "string"))
        raw = F.col(c).cast("string")
        if target == "string":
            val = F.when(is_blank(raw), F.lit(None).cast("string")).otherwise(raw)
        else:
            t = js_trim(raw)
            val = F.when(t == F.lit(""), F.lit(None).cast(target)).otherwise(t.try_cast(target))
        out.append(val.alias(c))
    return df.select(*out)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Keep rows with at least one non-blank cell."""
    if not df.columns:
        return df
    keep = None
    for c in df.columns:
        cond = ~is_blank(F.col(c).cast("string"))
        keep = cond if keep is None else (keep | cond)
    return df.where(keep)


def resolve_target(columns: list[str], target: str | None) -> str | None:
    """Sanitised requested target if it is a column, else the last column."""
    if target:
        name = sanitize_identifier(target)
        if name in columns:
            return name
        if target in columns:
            return target
    return columns[-1] if columns else None


def at_most_two_values(df: DataFrame, column: str) -> bool:
    """Exact "≤ 2 distinct non-null values" in two single-row scans (min/max, then a count of
    values that are neither) — no distinct aggregation, no shuffle of values."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).collect()[0]
    if row["lo"] is None:
        return True
    others = df.where(F.col(column).isNotNull() & (F.col(column) != F.lit(row["lo"])) & (F.col(column) != F.lit(row["hi"]))).limit(1).count()
    return others == 0


def infer_problem_type(df: DataFrame, target: str) -> str:
    """TEXT target → classification; numeric with ≤ 2 distinct values → classification; else regression."""
    if type_name(df.schema[target].dataType) == TEXT:
        return "classification"
    return "classification" if at_most_two_values(df, target) else "regression"
