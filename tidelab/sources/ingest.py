"""CSV ingest.

The header is read on its own (one record) and cleaned on the driver; the body is read by Spark's
CSV reader with an explicit all-string schema (no ``inferSchema``: its rules differ — it accepts
``1e5``, booleans, timestamps), staged once as Parquet in the shared scratch folder, then typed
and profiled from the staged copy in one scan (``text_profile``) and written typed in a second.
The raw file is therefore parsed exactly once, and the staged copy cuts the lineage so a lost
executor never re-parses the CSV.

``multiline=True`` handles line ends inside quoted cells; such files are read in byte ranges like any
other (``sources/ranges.py``), with their line ends normalised. ``multiline=False`` takes every line as a
record and reads files with uniform endings as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelab.functions.naming import header_names
from tidelab.operators.profile import PREVIEW_ROWS, profile_columns, text_profile
from tidelab.operators.schema import coerce, drop_blank_rows, infer_types, resolve_target
from tidelab.session import scratch_dir
from tidelab.sources.ranges import read_cells

BOM = "\ufeff"


class IngestError(ValueError):
    pass


@dataclass
class IngestResult:
    df: DataFrame
    columns: DataFrame
    types: dict[str, str]
    target: str | None
    problem_type: str
    path: str
    dataset_id: int | None = None

    def preview(self, n: int = PREVIEW_ROWS) -> DataFrame:
        return self.df.limit(n)


_OPTIONS = {
    "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def _reader(spark: SparkSession):
    return spark.read.options(**_OPTIONS)


def read_header(spark: SparkSession, path: str) -> list[str]:
    first = _reader(spark).option("header", False).csv(path).limit(1).collect()
    if not first:
        raise IngestError("CSV needs a header and at least one data row")
    raw = [v if v is not None else "" for v in first[0]]
    if raw and raw[0].startswith(BOM):
        raw[0] = raw[0][len(BOM):]
    return raw


def read_csv_text(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Body of the CSV as all-string columns named by B1/B2, all-blank rows dropped.

    Where the header's names can be a schema (none empty, none twice), Spark checks the header of
    every file of a folder against it and fails on another order or another name; other headers are
    read by position."""
    if multiline:
        try:
            return drop_blank_rows(read_cells(spark, path, lambda cells: header_names([cells[0].removeprefix(BOM), *cells[1:]]), _OPTIONS))
        except ValueError as e:
            raise IngestError(str(e)) from None
    header = read_header(spark, path)
    names = header_names(header)
    checked = all(h.strip() for h in header) and len({h.lower() for h in header}) == len(header)
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in (header if checked else names)])
    body = _reader(spark).option("header", True).option("enforceSchema", not checked).schema(schema).csv(path)
    return drop_blank_rows(body.toDF(*names))


def _import_problem_type(data_type: str | None, unique_count: int) -> str:
    if data_type is None:
        return "regression"
    return "classification" if data_type == "TEXT" or unique_count <= 2 else "regression"


def ingest_csv(
    spark: SparkSession,
    path: str,
    name: str | None = None,
    target: str | None = None,
    problem_type: str | None = None,
    multiline: bool = False,
    catalog=None,
    description: str | None = None,
    approx_distinct: bool = False,
) -> IngestResult:
    """Read, clean, type, profile and (with a catalog) register a CSV file or folder. ``multiline``
    is for files whose quoted cells hold line ends; they are read in byte ranges too."""
    text = read_csv_text(spark, path, multiline)
    stage = scratch_dir(spark, "ingest-stage")
    text.write.mode("overwrite").parquet(stage)
    staged = spark.read.parquet(stage)
    if staged.limit(1).count() == 0:
        raise IngestError("CSV needs a header and at least one data row")

    tgt = resolve_target(staged.columns, target)
    # Types, distinct and null counts in one scan of the text (so "1", "01" and "1.0" are three
    # values); one row per column comes back — metadata only.
    if approx_distinct:
        inferred = infer_types(staged).collect()
        type_names = {r["column_name"]: r["data_type"] for r in inferred}
        spark_types = {r["column_name"]: r["spark_type"] for r in inferred}
        columns = profile_columns(staged, tgt, approx=True, types=type_names)
    else:
        meta = text_profile(staged, tgt).collect()
        type_names = {r["column_name"]: r["data_type"] for r in meta}
        spark_types = {r["column_name"]: r["spark_type"] for r in meta}
        columns = spark.createDataFrame(
            [(r["ordinal"], r["column_name"], r["data_type"], r["is_target"], r["has_nulls"], r["null_count"], r["unique_count"]) for r in meta],
            "ordinal int, column_name string, data_type string, is_target int, has_nulls int, null_count long, unique_count long",
        )
    typed = coerce(staged, spark_types)
    if problem_type is None:
        row = columns.where(F.col("is_target") == 1).select("data_type", "unique_count").collect()
        problem_type = _import_problem_type(row[0]["data_type"], row[0]["unique_count"]) if row else "regression"

    if catalog is not None:
        ds_id = catalog.register_dataset(
            typed, name or _name_from_path(path), source_type="csv", description=description,
            target_column=tgt, columns_meta=columns,
        )
        return IngestResult(catalog.load(ds_id), columns, type_names, tgt, problem_type, catalog.table_path(f"dataset_{ds_id}"), ds_id)
    out = scratch_dir(spark, "ingest-table")
    typed.write.mode("overwrite").parquet(out)
    return IngestResult(spark.read.parquet(out), columns, type_names, tgt, problem_type, out)


def _name_from_path(path: str) -> str:
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base else base


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a driver-side string to ``path`` through the Hadoop file system (any scheme)."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hpath, True)
    try:
        data = text.encode("utf-8")
        out.write(bytearray(data))
    finally:
        out.close()


def ingest_csv_text(spark: SparkSession, text: str, name: str | None = None, **kwargs) -> IngestResult:
    """CSV given as text: line endings normalised (CRLF and lone CR → LF, as the original parser
    does), written to the shared scratch folder, then read like a file (an in-memory line split
    would break quoted newlines)."""
    folder = scratch_dir(spark, "csv-text")
    path = f"{folder}/upload.csv"
    write_text(spark, path, text.replace("\r\n", "\n").replace("\r", "\n"))
    return ingest_csv(spark, path, name=name or "pasted", **{"multiline": True, **kwargs})
