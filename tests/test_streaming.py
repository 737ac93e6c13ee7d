"""File-stream ingest: two CSV drops typed with the batch-inferred schema; the restarted query
resumes from its checkpoint and reads only the new file."""

from tidelab.session import scratch_dir
from tidelab.sources.ingest import write_text
from tidelab.streaming.ingest import stream_ingest_csv


def test_stream_ingest_resumes(spark):
    src = scratch_dir(spark, "stream-src")
    sink = scratch_dir(spark, "stream-sink")
    ckpt = scratch_dir(spark, "stream-ckpt")
    types = {"id": "INTEGER", "amount": "REAL", "name": "TEXT"}
    write_text(spark, f"{src}/a.csv", "id,amount,name\n1, 2.5 ,x\n2,,y\n,,\n")
    stream_ingest_csv(spark, src, types, sink, checkpoint_path=ckpt).awaitTermination(120)
    assert spark.read.parquet(sink).count() == 2
    write_text(spark, f"{src}/b.csv", "id,amount,name\n3,4,\n")
    stream_ingest_csv(spark, src, types, sink, checkpoint_path=ckpt).awaitTermination(120)
    rows = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert rows == [(1, 2.5, "x"), (2, None, "y"), (3, 4.0, None)]
    assert dict(spark.read.parquet(sink).dtypes) == {"id": "bigint", "amount": "double", "name": "string"}
