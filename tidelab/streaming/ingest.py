"""File-stream CSV ingest: CSV files landing in a folder are typed with a fixed schema (inferred
once by ``sources.ingest``) and appended to a Parquet table by Structured Streaming.

The stream uses the same cleaning as batch ingest (blank rows dropped, blank cells → null,
INTEGER/REAL parsed from trimmed text, TEXT untrimmed) and a checkpoint location under the shared
checkpoint folder, so a restarted query resumes exactly where it stopped (the file source and the
Parquet sink are both exactly-once).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelab.operators.schema import coerce, drop_blank_rows
from tidelab.session import scratch_dir


def stream_ingest_csv(
    spark: SparkSession,
    source_dir: str,
    types: dict[str, str],
    sink_path: str,
    checkpoint_path: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the stream. ``types`` maps the (clean) column names, in file order, to Spark types or
    workbench type names; files must carry a header row."""
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in types])
    reader = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    typed = coerce(drop_blank_rows(reader.csv(source_dir)), types)
    writer = (
        typed.writeStream.format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint_path or scratch_dir(spark, "stream-ckpt"))
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
