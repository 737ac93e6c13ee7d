"""Chart queries: filter → group → aggregate → sort → top-k, plus scatter samples and presets.

Every chart is one DataFrame plan. A grouped chart is a partial/final ``HashAggregate`` (map-side
combine, so a hot label costs one row per task before the shuffle) followed by
``TakeOrderedAndProject`` — each task keeps its own top-k, only k rows per task reach the final
merge. Nothing is collected except the ≤ 500 result rows by whoever calls ``collect``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelab.functions.text import is_date_like, round_value, safe_string, to_number

CHART_TYPES = ("bar", "line", "pie", "scatter")
AGGREGATIONS = ("sum", "avg", "count", "min", "max")
# Result-size clamp of the chart queries.
MIN_LIMIT, MAX_LIMIT = 5, 500

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class ChartError(ValueError):
    pass


def clamp_limit(limit: int) -> int:
    return max(MIN_LIMIT, min(int(limit), MAX_LIMIT))


def _as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _agg_expr(aggregation: str, y) -> Column:
    if aggregation not in AGGREGATIONS:
        raise ChartError(f"unknown aggregation {aggregation!r}")
    if aggregation == "count" or y is None or y == "":
        return F.count(F.lit(1))
    yc = _as_col(y)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[aggregation](yc)


def chart_data(
    df: DataFrame,
    chart_type: str,
    x,
    y=None,
    aggregation: str = "sum",
    limit: int = 12,
    order_by: str = "value",
    scatter_order=None,
    share: bool | None = None,
    sample: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Chart points for ``chart_type``.

    * bar / pie: ``(label, value)`` grouped by ``x``, value descending, top ``limit``.
    * line: the same, value ascending (``order_by="label"`` sorts by the label instead).
    * pie: adds ``share`` = value / total of the kept slices.
    * scatter: ``(x, y)`` doubles where both are present; ``scatter_order`` (column names)
      makes the first-k choice deterministic, ``sample="random"`` takes a reproducible
      pseudo-random k (hash order, a per-task top-k), otherwise it is any k rows (a plain ``LIMIT``).

    Ties on the sort value are broken by label so the top-k cut is deterministic.
    """
    if chart_type not in CHART_TYPES:
        raise ChartError(f"unknown chart type {chart_type!r}")
    k = clamp_limit(limit)

    if chart_type == "scatter":
        if x is None or y is None:
            raise ChartError("scatter needs x and y")
        xc, yc = _as_col(x), _as_col(y)
        pts = df.where(xc.isNotNull() & yc.isNotNull())
        if scatter_order:
            pts = pts.orderBy(*[_as_col(c) for c in scatter_order])
        elif sample == "random":
            pts = pts.orderBy(F.xxhash64(F.lit(seed), *[pts[c] for c in pts.columns]))
        return pts.limit(k).select(to_number(xc).alias("x"), to_number(yc).alias("y"))

    if x is None or x == "":
        raise ChartError("grouped charts need an x column")
    xc = _as_col(x)
    grouped = (
        df.where(xc.isNotNull())
        .groupBy(xc.alias("_label"))
        .agg(_agg_expr(aggregation, y).alias("_agg"))
        .select(
            safe_string(F.col("_label")).alias("label"),
            F.coalesce(round_value(F.col("_agg"), 2), F.lit(0.0)).alias("value"),
            F.col("_label"),
        )
    )
    if order_by == "label":
        ordered = grouped.orderBy(F.col("_label").asc())  # typed: 2 comes before 10
    elif chart_type == "line":
        ordered = grouped.orderBy(F.col("value").asc(), F.col("label").asc())
    else:
        ordered = grouped.orderBy(F.col("value").desc(), F.col("label").asc())
    top = ordered.limit(k).drop("_label")
    if share or (share is None and chart_type == "pie"):
        # The window runs over at most 500 rows (after the limit): a single task is fine here.
        total = F.sum("value").over(Window.partitionBy())
        top = top.withColumn("share", F.when(total == 0, F.lit(None)).otherwise(round_value(F.col("value") / total, 4)))
    return top


@dataclass(frozen=True)
class ChartPreset:
    chart_type: str
    x: str
    y: str
    aggregation: str
    limit: int


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _NUMERIC)]


def suggest_chart(df: DataFrame) -> ChartPreset:
    """Smart preset from the schema (and, only if string dates must be probed, one preview row):

    ≥2 numeric → scatter (sum, 200); date-like + numeric → line (avg, 24);
    categorical + numeric → bar (sum, 12); categorical only → pie (count, 8); else bar (count, 12).
    """
    numeric = numeric_columns(df)
    categorical = categorical_columns(df)
    if len(numeric) >= 2:
        return ChartPreset("scatter", numeric[0], numeric[1], "sum", 200)
    date_like = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    string_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if numeric and not date_like and string_cols:
        first = df.select(*[is_date_like(c).alias(c) for c in string_cols]).limit(1).collect()
        if first:
            date_like = [c for c in string_cols if first[0][c]]
    if date_like and numeric:
        return ChartPreset("line", date_like[0], numeric[0], "avg", 24)
    if categorical and numeric:
        return ChartPreset("bar", categorical[0], numeric[0], "sum", 12)
    if categorical:
        return ChartPreset("pie", categorical[0], "", "count", 8)
    cols = df.columns
    return ChartPreset("bar", cols[0] if cols else "", numeric[0] if numeric else "", "count", 12)


def auto_chart(df: DataFrame) -> tuple[ChartPreset, DataFrame]:
    """The suggested preset and its chart data."""
    p = suggest_chart(df)
    return p, chart_data(df, p.chart_type, p.x, p.y or None, p.aggregation, p.limit)


def chart_query_name(chart_type: str, x: str, y: str | None) -> str:
    """History name used when chart queries are logged."""
    return f"DataViz {chart_type} - {x} / {y or 'count'}"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def chart_sql(table: str, chart_type: str, x: str, y: str | None = None, aggregation: str = "sum", limit: int = 12) -> str:
    """SQL text that gives the rows of ``chart_data`` on a registered view, for the history: the same
    rounding of the binary value, the same tie-break by label."""
    source, label = _ident(table), _ident(x)
    kept = [label] + ([_ident(y)] if chart_type == "scatter" else [])
    where = " AND ".join(f"{c} IS NOT NULL" for c in kept)
    rows = f"FROM {source} WHERE {where}"
    if chart_type == "scatter":
        picked = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {name}" for c, name in zip(kept, ("x", "y"), strict=True))
        return f"SELECT {picked} {rows} LIMIT {clamp_limit(limit)}"
    counted = aggregation == "count" or not y
    measure = "count(1)" if counted else f"{aggregation}({_ident(y)})"
    rounded = f"coalesce(round(CAST({measure} AS DOUBLE) * 100.0D, 0) / 100.0D, 0.0D)"
    order = "value, label" if chart_type == "line" else "value DESC, label"
    return f"SELECT CAST({label} AS STRING) AS label, {rounded} AS value {rows} GROUP BY {label} ORDER BY {order} LIMIT {clamp_limit(limit)}"
