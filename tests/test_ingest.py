"""CSV ingest edge cases (BOM, CRLF/CR, quotes, embedded newlines, blank and ragged rows, header
cleaning, type inference rules)."""

from tidelab.functions.naming import header_names, sanitize_identifier, unique_names
from tidelab.sources.ingest import IngestError, ingest_csv_text


def test_sanitize_and_unique():
    assert sanitize_identifier("Café Name!") == "cafe_name"
    assert sanitize_identifier("  __  ") == "col"
    assert sanitize_identifier("Units Sold (k)") == "units_sold_k"
    assert unique_names(["x", "x", "x"]) == ["x", "x_2", "x_3"]
    assert unique_names(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    assert header_names(["", "A b", "a_b"]) == ["column", "a_b", "a_b_2"]


def test_ingest_edge_cases(spark):
    text = (
        "﻿Id,Name,Amount,Note,Flag,\r\n"
        '1,"Smith, J",10,"line1\nline2",1,x\r\n'
        "2,O'Brien,\t2.5 ,\"say \"\"hi\"\"\",0,\r"
        ",,,,,\n"
        "\n"
        "3,Lee,7,short\n"
        "4,Kim, 1e5 ,n,1,y,extra\n"
    )
    res = ingest_csv_text(spark, text, target="flag")
    df = res.df
    assert df.columns == ["id", "name", "amount", "note", "flag", "column"]
    assert res.types == {"id": "INTEGER", "name": "TEXT", "amount": "TEXT", "note": "TEXT", "flag": "INTEGER", "column": "TEXT"}
    rows = {r["id"]: r.asDict() for r in df.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[1]["name"] == "Smith, J"
    assert rows[1]["note"] == "line1\nline2"
    assert rows[2]["note"] == 'say "hi"'
    assert rows[2]["amount"] == "\t2.5 "  # TEXT keeps the untrimmed value
    assert rows[3]["flag"] is None and rows[3]["note"] == "short"
    assert res.target == "flag"
    assert res.problem_type == "classification"
    meta = {r["column_name"]: r.asDict() for r in res.columns.collect()}
    assert meta["flag"]["is_target"] == 1 and meta["flag"]["null_count"] == 1
    assert meta["column"]["unique_count"] == 2


def test_ingest_numeric_types(spark):
    text = "a,b,c,d\n1,1.5,+5,x\n-2,2,.5,\n 3 ,3.0,7,\n"
    res = ingest_csv_text(spark, text)
    assert res.types == {"a": "INTEGER", "b": "REAL", "c": "TEXT", "d": "TEXT"}
    assert res.target == "d"  # missing target → last column
    got = sorted((r["a"], r["b"]) for r in res.df.collect())
    assert got == [(-2, 2.0), (1, 1.5), (3, 3.0)]
    assert dict(res.df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "string"}


def test_header_only_is_error(spark):
    import pytest

    with pytest.raises(IngestError):
        ingest_csv_text(spark, "a,b\n")
