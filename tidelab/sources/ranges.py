"""Multi-line CSV read in byte ranges (A1).

Quoted cells may hold line ends, so a line end alone does not end a record. Files are still read in
Spark's own splits, as lines with their split's place in the file:

1. The quotes of every range are counted; whether a range begins inside quotes is the parity of all
   quotes before it in its file. One small row a range.
2. Each range's lines are cut where the quotes so far are even. A record that crosses ranges leaves
   one fragment in each, and these few are joined by the range that the record began in.
3. Records are split into cells by Spark's CSV functions.

Every quote counts, wherever it stands, so a stray one opens a quoted cell up to the next. Line ends
inside cells come out as LF, whatever the file has (LF, CRLF or CR). A file that ends inside quotes
ends its last record there. Compressed files cannot be split by Spark and are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_PIECES = "file string, begin long, number long, owner long, whole boolean, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, begin, line)``: the lines of each range, in the order of the file within a range."""
    text = spark.read.text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").alias("line")
    )


def range_parity(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, begin, quotes, inside)``, a row a byte range: the quotes in it and whether it begins
    inside quotes. Ranges without a line's beginning have no row; the window is over a file's ranges."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    ranges = _lines(spark, path).groupBy("file", "begin").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)


def read_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, first, record)``: every record as text; ``first`` marks a file's first one."""
    # A row a range, as in the scan's own plan on the driver.
    inside = {(r["file"], r["begin"]): r["inside"] for r in range_parity(spark, path, quote).select("file", "begin", "inside").toLocalIterator()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_lines, odd, number, leading = None, [], 0, 0, False

        def fragment(closed: bool) -> pa.RecordBatch:
            """The lines held: what began in an earlier range, or goes on in a later one, is a part."""
            file, begin = here
            return rows(file, begin, [number], [not leading and closed], ["\n".join(open_lines)], leading)

        def rows(file, begin, numbers, whole, records, lead=False) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * n, pa.string()), pa.array([begin] * n, pa.int64()), pa.array(numbers, pa.int64()),
                    pa.array([None if lead else begin] * n, pa.int64()), pa.array(whole, pa.bool_()),
                    pa.array([begin == 0 and k == 0 and not lead for k in numbers], pa.bool_()), pa.array(records, pa.string()),
                ],
                ["file", "begin", "number", "owner", "whole", "first", "record"],
            )

        for batch in batches:
            begins = batch.column(1).to_numpy()
            files = batch.column(0)
            turns = np.flatnonzero(np.diff(begins) != 0) + 1
            turns = sorted({0, *turns.tolist(), *(np.flatnonzero(pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()})
            for a, b in zip(turns, [*turns[1:], batch.num_rows], strict=True):
                if (files[a].as_py(), int(begins[a])) != here:
                    if open_lines:
                        yield fragment(odd == 0)
                    here = (files[a].as_py(), int(begins[a]))
                    if here not in inside:
                        raise ValueError(f"{here[0]} changed while it was read")
                    open_lines, odd, number = [], int(inside[here]), 0
                    leading = bool(odd)
                lines = batch.column(2).slice(a, b - a)
                quotes = pc.count_substring(lines, quote).to_numpy()
                before = (odd + np.concatenate([[0], np.cumsum(quotes)])) % 2
                starts = np.flatnonzero(before[:-1] == 0)  # lines that begin a record
                odd = int(before[-1])
                texts = lines.to_pylist()
                if not len(starts):
                    open_lines += texts
                    continue
                if open_lines or leading:
                    open_lines += texts[: starts[0]]
                    if open_lines:
                        yield fragment(True)
                        number += not leading
                    leading = False
                ends = starts[1:].tolist()
                done = ["\n".join(texts[x:y]) if y - x > 1 else texts[x] for x, y in zip(starts.tolist(), ends, strict=False)]
                if done:
                    yield rows(*here, range(number, number + len(done)), [True] * len(done), done)
                    number += len(done)
                open_lines = texts[starts[-1] :]
        if open_lines:
            yield fragment(odd == 0)

    pieces = _lines(spark, path).mapInArrow(cut, _PIECES)
    whole = pieces.where("whole").select("file", "first", "record")
    # At most two fragments a range. A fragment that leads a range goes with the last record begun before.
    began = Window.partitionBy("file").orderBy("begin", F.col("owner").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where("not whole").withColumn("owner", F.last("owner", ignorenulls=True).over(began))
    joined = parts.groupBy("file", "owner").agg(
        F.max("first").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "record"))), lambda p: p["record"]), "\n").alias("record")
    )
    return whole.unionByName(joined.select("file", "first", "record"))


def read_cells(spark: SparkSession, path: str, names_of, options: dict[str, str]) -> DataFrame:
    """The records below the files' headers as text columns. ``names_of(cells)`` makes the columns'
    names of the header's cells; all files of a folder must have the same header."""
    records = read_records(spark, path)
    headers = [r["record"] for r in records.where("first").select("record").distinct().limit(2).collect()]
    if not headers:
        raise ValueError("CSV needs a header and at least one data row")
    if len(headers) > 1:
        raise ValueError(f"files with different headers: {headers[0][:200]!r} and {headers[1][:200]!r}")
    cells = _header_cells(spark, headers[0], options)
    names = names_of(cells)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType(), True) for i in range(len(names))])
    row = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), options)
    body = records.where("not first and record <> ''").select(row.alias("r")).select("r.*")
    return body.toDF(*names)


def _header_cells(spark: SparkSession, header: str, options: dict[str, str]) -> list[str]:
    """A header has at most one cell more than it has commas."""
    most = header.count(",") + 1
    schema = ", ".join(f"c{i} string" for i in range(most))
    marked = spark.range(1).select(F.from_csv(F.lit(header + ',"|"'), schema + ", e0 string", options).alias("r")).select("r.*").first()
    cells = [c if c is not None else "" for c in marked]
    return cells[: cells.index("|")] if "|" in cells else cells[:most]
