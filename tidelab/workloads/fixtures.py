"""Text fixtures derived from the supplied tables (same rows, planted blanks and padding), built
identically in Spark and in the DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.functions.text import TRIM_PATTERN
from tidelab.session import read_table

NBSP = "\u00a0"

# column name → (Spark expression builder, DuckDB expression); both read ``customer``. Builders are
# called lazily: Column objects need an active session, and the registry is imported without one.
CUSTOMER_TEXT = {
    "cust_id": (
        lambda: F.when(F.col("c_custkey") % 7 == 0, F.lit("  ")).otherwise(F.col("c_custkey").cast("string")),
        "CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE CAST(c_custkey AS VARCHAR) END",
    ),
    "name": (lambda: F.col("c_name"), "c_name"),
    "nation_code": (
        lambda: F.concat(F.lit("\t"), F.col("c_nationkey").cast("string"), F.lit(NBSP)),
        "chr(9) || CAST(c_nationkey AS VARCHAR) || chr(160)",
    ),
    "balance": (
        lambda: F.col("c_acctbal").cast("decimal(12,2)").cast("string"),
        "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)",
    ),
    "segment": (
        lambda: F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment")),
        "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END",
    ),
    "mixed_num": (
        lambda: F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(
            F.concat(F.col("c_nationkey").cast("string"), F.lit(".5"))
        ),
        "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) || '.5' END",
    ),
    "expo": (
        lambda: F.when(F.col("c_custkey") % 11 == 0, F.lit("1e5")).otherwise(F.col("c_custkey").cast("string")),
        "CASE WHEN c_custkey % 11 = 0 THEN '1e5' ELSE CAST(c_custkey AS VARCHAR) END",
    ),
    "empty_col": (lambda: F.lit(" "), "' '"),
}

# The oracle's trim: the same character class, applied globally.
DUCK_TRIM_PATTERN = TRIM_PATTERN.replace("'", "''")


def duck_trim(c: str) -> str:
    return f"regexp_replace({c}, '{DUCK_TRIM_PATTERN}', '', 'g')"


def customer_text(spark, sf_dir) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer")
    return cust.select(*[build().alias(name) for name, (build, _) in CUSTOMER_TEXT.items()])


def customer_text_sql() -> str:
    cols = ",\n  ".join(f"{duck} AS {name}" for name, (_, duck) in CUSTOMER_TEXT.items())
    return f"SELECT\n  {cols}\nFROM customer"
