"""Column profiles that can be added up: distinct, quantile and heavy-hitter sketches.

One aggregate over a table gives a row per column with exact cell and missing counts and three binary
sketches: HyperLogLog of the cells' texts, KLL quantiles of numbers, and frequent items. Rows of several
parts of a table merge by column into the row of the whole, so appended rows cost a scan of their own
only. Sketches have a fixed size whatever the rows; only they are shuffled.

Error bounds: distinct counts 1.04 / sqrt(2^12) = 1.6 % standard error; quantile ranks 0.7 % of the rows
(KLL, k = 400); counts of frequent items exact up to ``TRACKED`` distinct values, else off by at most
3.5 / 16384 of the rows. Merging HyperLogLog sketches gives the registers of the whole, and estimates
are taken from the registers alone, so they do not depend on how the rows were cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelab.operators.profile import _text_value

LOG_K = 12
KLL_K = 400
TRACKED = 10_000


def column_sketches(df: DataFrame) -> DataFrame:
    """``(ordinal, column_name, cells, missing, distinct_sketch, heavy_sketch, quantile_sketch)``, a row per
    column of ``df`` in one scan. Null and blank cells are missing and in no sketch, nor are NaN and
    infinite numbers in the quantiles; columns that are not numeric have no quantiles. An empty table
    gives empty sketches, which merge like any other."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        text = _text_value(df, f.name)
        if isinstance(f.dataType, T.NumericType):
            number = df[f.name].cast("double")
            number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
            quantiles = F.kll_sketch_agg_double(number, KLL_K)
        else:
            quantiles = F.lit(None).cast("binary")
        rows.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.count(F.lit(1)).alias("cells"),
            F.count_if(text.isNull()).alias("missing"), F.hll_sketch_agg(text, LOG_K).alias("distinct_sketch"),
            F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("heavy_sketch"),
            quantiles.alias("quantile_sketch"),
        ))
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def merge_sketches(parts: DataFrame, *by: str) -> DataFrame:
    """Sketch rows of several parts (of each ``by``) as those of the whole."""
    return parts.groupBy(*by, "ordinal", "column_name").agg(
        F.sum("cells").alias("cells"), F.sum("missing").alias("missing"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.call_function("approx_top_k_combine", F.col("heavy_sketch"), F.lit(TRACKED)).alias("heavy_sketch"),
        F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch", KLL_K)).alias("quantile_sketch"),
    )


def sketch_estimates(parts: DataFrame, *by: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """``(ordinal, column_name, cells, missing, unique_count, quantiles, heavy)`` of merged sketch rows:
    ``quantiles`` is null without numbers, ``heavy`` holds the ``top`` items by count, ties by item, with
    an item beyond those in no order among equal counts."""
    merged = merge_sketches(parts, *by)
    ranks = F.array(*[F.lit(float(q)) for q in quantiles])
    numbers = F.when(F.kll_sketch_get_n_double("quantile_sketch") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", ranks))
    items = F.filter(F.call_function("approx_top_k_estimate", F.col("heavy_sketch"), F.lit(top + 1)), lambda h: h["item"].isNotNull())
    ordered = F.array_sort(F.transform(items, lambda h: F.struct((-h["count"]).alias("minus"), h["item"].alias("item"))))
    heavy = F.transform(F.slice(ordered, 1, top), lambda h: F.struct(h["item"].alias("item"), (-h["minus"]).alias("count")))
    # A sketch that was never merged estimates from the order its cells came in; a union with itself leaves
    # the registers as they are and makes them alone decide.
    registers = F.hll_union("distinct_sketch", "distinct_sketch")
    return merged.select(
        *by, "ordinal", "column_name", "cells", "missing", F.hll_sketch_estimate(registers).alias("unique_count"),
        numbers.alias("quantiles"), heavy.alias("heavy"),
    )
