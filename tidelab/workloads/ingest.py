"""CSV ingest workload (A1): the ``customer`` text fixture is written as CSV to the shared scratch
folder by Spark's parallel writer and ingested back; the typed rows must equal the oracle's
coercion of the same fixture."""

from __future__ import annotations

from tidelab.session import read_table, scratch_dir
from tidelab.sources.ingest import ingest_csv
from tidelab.workloads import ORACLE, register
from tidelab.workloads.fixtures import customer_text, duck_trim


@register("ingest_csv_roundtrip", ORACLE["coerce_types"])
def ingest_csv_roundtrip(spark, sf_dir):
    folder = scratch_dir(spark, "csv-roundtrip")
    (
        customer_text(spark, sf_dir)
        .write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("quoteAll", True)
        .mode("overwrite")
        .csv(folder)
    )
    return ingest_csv(spark, folder, name="customer_text", target="segment").df


def _lf(column: str) -> str:
    """Line ends of a cell as LF."""
    return f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@register(
    "ingest_csv_multiline",
    "SELECT doc_id, "
    + ", ".join(f"CASE WHEN {duck_trim(c)} = '' THEN NULL ELSE {_lf(c)} END AS {c}" for c in ("text", "lang", "source"))
    + ", n_chars FROM documents",
)
def ingest_csv_multiline(spark, sf_dir):
    """(A1) Texts with line ends and quotes inside quoted cells, written as CSV and read back in byte
    ranges; a cell's line ends come out as LF."""
    folder = scratch_dir(spark, "csv-multiline")
    (
        read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
        .write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(folder)
    )
    return ingest_csv(spark, folder, name="documents_text", target="lang", multiline=True).df
