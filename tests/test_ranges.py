"""Multi-line CSV in byte ranges: the same records whatever the ranges."""

import contextlib
import csv
import io
import random

import pytest

from tidelab.sources.ingest import IngestError, ingest_csv, read_csv_text
from tidelab.sources.ranges import range_parity, read_records


@contextlib.contextmanager
def ranges_of(spark, size):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], size)
    spark.conf.set(keys[1], size if size > 1 << 20 else 1)
    try:
        yield
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def table(n, seed=1):
    rnd = random.Random(seed)
    cell = lambda: rnd.choice(["plain", 'a "quoted" word', "two\nlines", "\n\nlines\n", "", "x,y", '"', '\n"\n', "é漢", " padded ", "z" * rnd.randint(1, 90)])
    return [[str(i), cell(), cell(), cell() + "."] for i in range(n)]


def write(path, rows, end="\n", header=("id", "note", "more, text", "last")):
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
    w.writerows([header, *rows])
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(out.getvalue().replace("\n", end))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("size", [1 << 27, 2000, 61])
def test_same_cells_whatever_the_ranges(spark, tmp_path, size, end):
    rows = table(300)
    path = str(tmp_path / "t.csv")
    write(path, rows, end)
    with ranges_of(spark, size):
        n = range_parity(spark, path).count()
        got = read_csv_text(spark, path, multiline=True)
        assert got.columns == ["id", "note", "more_text", "last"]
        got = sorted((tuple(x or "" for x in r) for r in got.collect()), key=lambda r: int(r[0]))
    assert got == [tuple(r) for r in rows]
    assert n == 1 if size == 1 << 27 else n >= 5


def test_folders_headers_and_empty_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(4):
        write(folder / f"p{k}.csv", table(40, k))
    (folder / "p9.csv").write_text("")
    with ranges_of(spark, 300):
        assert read_csv_text(spark, str(folder), multiline=True).count() == 160
        assert read_records(spark, str(folder)).where("first").count() == 4
        write(folder / "p8.csv", table(3), header=("other", "note", "more", "last"))
        with pytest.raises(IngestError):
            read_csv_text(spark, str(folder), multiline=True)
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(IngestError):
        read_csv_text(spark, str(empty), multiline=True)


def test_a_cell_over_many_ranges_and_an_open_end(spark, tmp_path):
    path = tmp_path / "t.csv"
    long = "\n".join(f"line {i}" for i in range(500))
    path.write_text('﻿id,note\n1,"' + long + '"\n2,short\n\n3,"never closed\nat all')
    for size in (1 << 27, 100):
        with ranges_of(spark, size):
            got = {r["id"]: r["note"] for r in read_csv_text(spark, str(path), multiline=True).collect()}
        assert got["1"] == long and got["2"] == "short" and set(got) == {"1", "2", "3"}


def test_ragged_rows_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,amount,note\n1,2.5\n2,3,"a\nb",extra\n,,\n')
    res = ingest_csv(spark, str(path), multiline=True)
    assert res.types == {"id": "INTEGER", "amount": "REAL", "note": "TEXT"}
    assert sorted(map(tuple, res.df.collect())) == [(1, 2.5, None), (2, 3.0, "a\nb")]
