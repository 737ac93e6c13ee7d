"""Token files: length-delimited binary records with masked checksums, and an offset index.

One record holds one document::

    u32 length of payload | u32 masked CRC-32 of those four bytes
    payload: u8 id width (2 or 4) | u8 1 if the id is null | i64 doc_id | ids, little-endian
    u32 masked CRC-32 of payload | 0x0A

All numbers are little-endian. A mask rotates a checksum right by 15 bits and adds a constant, so
that a checksum stored beside data is not mistaken for data. The closing line feed lets Spark's own
text writer produce the files on any store, under its commit protocol: a lost executor's attempt
leaves nothing behind. Files are written in ascending doc_id order (nulls first), file after file.

The index is a Parquet table beside the records: per record its file, ordinal, byte offset and
length, ids before it in the file, and the checksum of its ids. Readers that shuffle take rows of the
index in any order and read the records at their offsets (``read_at``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelab.llm.common import scratch_dir, parallel_slots, ship, utf8
from tidelab.llm.tokens import encoder, release, runs

MASK_DELTA = 0xA282EAD8  # fixed value of the record format
HEAD = struct.Struct("<II")
BODY = struct.Struct("<BBq")
TAIL = struct.Struct("<I")

INDEX_SCHEMA = (
    "file string, part long, ordinal long, offset long, length long, doc_id long, "
    "before long, n_tokens long, ids_crc32 long"
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = BODY.pack(width, doc_id is None, doc_id or 0) + ids
    size = struct.pack("<I", len(payload))
    return size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload)) + b"\n"


def unframe(data, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at byte ``at``: doc_id, ids and the offset after it. Raises on any damage."""
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 4])) != check:
        raise ValueError(f"damaged record length at byte {at}")
    begin = at + HEAD.size
    payload = bytes(data[begin : begin + size])
    if len(payload) != size or TAIL.unpack_from(data, begin + size)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    width, null, doc_id = BODY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=BODY.size)
    return (None if null else doc_id), ids, begin + size + TAIL.size + 1


def write_records(
    docs: DataFrame, path: str, tokenizer: str, kind: str = "bytes", end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 64 << 20,
) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write records under
    ``path/records`` in ascending id order. Files hold about ``file_bytes`` of text each, however
    large the table. Rows that share an id are spread by a random second key, so that a hot id
    (null among them) is cut over many files; repeated rows each get a record. Other columns are
    not read. An empty table gives files without records."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parallel_slots(spark), -(-int(total) // file_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in runs(sizes, 3 << 19):  # of a batch, one run of texts at a time becomes Python strings
                ids, texts = (batch.column(c).slice(a, b - a).to_pylist() for c in (0, 1))
                out = [frame(i, t + end, enc.width)[:-1] for i, t in zip(ids, enc.encode(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (
        rows.withColumn("_cut", F.rand(11))
        .repartitionByRange(n, "doc_id", "_cut")
        .sortWithinPartitions("doc_id", "_cut")
        .select("doc_id", "text")
        .mapInArrow(encode, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("compression", "none").option("lineSep", "\n").text(f"{path}/records")
    )


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read every file under ``path/records`` back, check both checksums of every record, write the
    offset index to ``path/index`` and return it. Workers that wrote the records let go of their word
    tables first, so the tables do not stand beside the files' contents, nor beside later stages."""
    ship(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                at = ordinal = before = 0
                rows = []
                while at < len(data):
                    doc_id, ids, after = unframe(data, at)
                    rows.append((at, after - at, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at, before = after, before + len(ids)
                for ordinal in range(0, len(rows), 20_000):
                    part = rows[ordinal : ordinal + 20_000]
                    cols = list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()] * len(part)),
                            pa.array(range(ordinal, ordinal + len(part)), pa.int64()),
                            *(pa.array(c, pa.int64()) for c in cols),
                        ],
                        ["file", "ordinal", "offset", "length", "doc_id", "before", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    (
        files.select("path", "content")
        .mapInArrow(
            scan,
            "file string, ordinal long, offset long, length long, doc_id long, before long, "
            "n_tokens long, ids_crc32 long",
        )
        .withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
        .select("file", "part", "ordinal", "offset", "length", "doc_id", "before", "n_tokens", "ids_crc32")
        .write.parquet(f"{path}/index")
    )
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read_at(index: DataFrame, path: str) -> DataFrame:
    """Records for rows of the index, in any selection: ``(doc_id, ids array<long>, file, offset)``.
    Each file is opened once and only the wanted offsets are decoded."""
    spark = index.sparkSession
    ship(spark)
    wanted = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, offsets in zip(*batch.columns, strict=True):
                data = memoryview(content.as_buffer())
                got = [(*unframe(data, at)[:2], name.as_py(), at) for at in offsets.as_py()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g[0] for g in got], pa.int64()),
                        pa.array([g[1].astype(np.int64) for g in got], pa.list_(pa.int64())),
                        pa.array([g[2] for g in got], pa.string()),
                        pa.array([g[3] for g in got], pa.int64()),
                    ],
                    ["doc_id", "ids", "file", "offset"],
                )

    joined = files.select(F.col("path").alias("file"), "content").join(wanted, "file")
    return joined.select("file", "content", "offsets").mapInArrow(
        fetch, "doc_id long, ids array<long>, file string, offset long"
    )


def token_table(index: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` over all files: ``start`` counts the ids of every
    document before it. The running total over files is a window over one row per file."""
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return index.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_records(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the records and their index to the shared folder and report every document from them."""
    path = scratch_dir(spark, "records")
    write_records(docs, path, tokenizer)
    return token_table(build_index(spark, path))
