"""Property tests: type inference and coercion against a plain-Python statement of the rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidelab.operators.schema import coerce, infer_types

_WS = " \t ﻿"
_INT = re.compile(r"-?[0-9]+")
_REAL = re.compile(r"-?[0-9]+(\.[0-9]+)?")


def _rule(values):
    vals = [v.strip(_WS) for v in values if v is not None]
    vals = [v for v in vals if v != ""]
    if not vals:
        return "TEXT"
    if all(_INT.fullmatch(v) for v in vals):
        return "INTEGER"
    if all(_REAL.fullmatch(v) for v in vals):
        return "REAL"
    return "TEXT"


cell = st.one_of(
    st.none(),
    st.sampled_from(["", " ", "\t", " ", "x", "1e5", "+5", ".5", "-", "1.", "007"]),
    st.integers(-10**6, 10**6).map(str),
    st.floats(-1e4, 1e4, allow_nan=False).map(lambda f: f"{f:.3f}"),
    st.builds(lambda ws, n: ws + str(n) + ws, st.sampled_from(_WS), st.integers(-99, 99)),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell), min_size=1, max_size=12))
def test_infer_and_coerce_match_rules(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    types = {r["column_name"]: r["data_type"] for r in infer_types(df).collect()}
    assert types == {"a": _rule([r[0] for r in rows]), "b": _rule([r[1] for r in rows])}
    spark_types = {r["column_name"]: r["spark_type"] for r in infer_types(df).collect()}
    out = coerce(df, spark_types).collect()
    # coercion keeps the row count and turns exactly the blank cells into nulls
    assert len(out) == len(rows)
    col_a = [r["a"] for r in out]
    blanks = sum(1 for a, _ in rows if a is None or a.strip(_WS) == "")
    assert sum(1 for v in col_a if v is None) == blanks
