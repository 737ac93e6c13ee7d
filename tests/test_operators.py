"""Charts, profiling, typing traps and hashing on hand-made frames and the supplied tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelab.functions.hashing import fnv1a_unit
from tidelab.functions.text import is_blank, is_date_like, js_trim, round_value, safe_string, to_number
from tidelab.operators.charts import ChartError, chart_data, clamp_limit, suggest_chart
from tidelab.operators.profile import profile, profile_columns, target_stats
from tidelab.operators.schema import at_most_two_values, infer_problem_type, resolve_target

SF001 = "/root/testdata/sf0.001"


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t 5 ", None, "2024-01-02x"), ("﻿x ", 3, "2024/01/02"), ("", 1, "24-01-02")], "s string, n int, d string")
    rows = df.select(js_trim("s").alias("t"), is_blank("s").alias("b"), safe_string("n").alias("ss"),
                     to_number("s").alias("num"), is_date_like("d").alias("dl")).collect()
    assert [r["t"] for r in rows] == ["5", "x", ""]
    assert [r["b"] for r in rows] == [False, False, True]
    assert [r["ss"] for r in rows] == ["", "3", "1"]
    assert [r["dl"] for r in rows] == [True, True, False]
    assert rows[1]["num"] is None


def test_round_value_is_binary(spark):
    r = spark.range(1).select(round_value(F.lit(1.005), 2).alias("a"), round_value(F.lit(2.675), 2).alias("b"),
                              round_value(F.lit(-0.125), 2).alias("c"), round_value(F.lit(0.125), 2).alias("d")).collect()[0]
    assert (r["a"], r["b"], r["c"], r["d"]) == (1.0, round(2.675 * 100) / 100, -0.13, 0.13)


def test_fnv1a(spark):
    def ref(s):
        h = 2166136261
        for ch in s:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return h / 4294967295

    df = spark.createDataFrame([("ab", 1), ("", 22)], "a string, b int")
    got = [r[0] for r in df.select(fnv1a_unit("a", "b")).collect()]
    assert got == [ref("ab|1"), ref("|22")]


def test_chart_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 9.0), ("c", None)], "x string, y double")
    bar = chart_data(df, "bar", "x", "y", "sum").collect()
    assert [(r.label, r.value) for r in bar] == [("b", 5.0), ("a", 3.0), ("c", 0.0)]
    line = chart_data(df, "line", "x", "y", "avg").collect()
    assert [r.label for r in line] == ["c", "a", "b"]
    cnt = chart_data(df, "bar", "x", None, "max").collect()
    assert {r.label: r.value for r in cnt} == {"a": 2.0, "b": 1.0, "c": 1.0}
    pie = chart_data(df, "pie", "x", "y", "sum").collect()
    assert abs(sum(r.share for r in pie) - 1.0) < 1e-3
    sc = chart_data(df, "scatter", "x", "y", scatter_order=["y"]).collect()
    assert all(r.y is not None for r in sc)
    assert clamp_limit(1) == 5 and clamp_limit(10_000) == 500
    with pytest.raises(ChartError):
        chart_data(df, "area", "x", "y")


def test_chart_total_property(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    total = o.agg(F.sum("o_totalprice")).collect()[0][0]
    got = sum(r.value for r in chart_data(o, "bar", "o_orderstatus", "o_totalprice", "sum", 500).collect())
    assert abs(got - total) < 0.01 * 5


def test_suggest_chart(spark):
    assert suggest_chart(spark.createDataFrame([(1, 2.0, "a")], "a int, b double, c string")).chart_type == "scatter"
    assert suggest_chart(spark.createDataFrame([("2024-01-01", 2.0)], "d string, v double")).chart_type == "line"
    assert suggest_chart(spark.createDataFrame([("x", 2.0)], "d string, v double")).chart_type == "bar"
    p = suggest_chart(spark.createDataFrame([("x", "y")], "a string, b string"))
    assert (p.chart_type, p.aggregation, p.limit) == ("pie", "count", 8)


def test_profile_properties(spark):
    c = spark.read.parquet(f"{SF001}/customer.parquet")
    prof = profile_columns(c, "c_mktsegment").toPandas()
    n = c.count()
    pdf = c.toPandas()
    for _, r in prof.iterrows():
        col = pdf[r["column_name"]]
        assert r["null_count"] == int(col.isna().sum())
        assert r["unique_count"] == int(col.dropna().astype(str).str.strip().replace("", pd.NA).dropna().nunique())
    assert prof["null_count"].sum() + sum(pdf[c].notna().sum() for c in pdf.columns) == n * len(pdf.columns)
    approx = profile_columns(c, approx=True).toPandas().set_index("column_name")
    exact = prof.set_index("column_name")
    for col in exact.index:
        assert abs(approx.loc[col, "unique_count"] - exact.loc[col, "unique_count"]) <= max(2, 0.1 * exact.loc[col, "unique_count"])


def test_target_stats_and_problem_type(spark):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    assert infer_problem_type(labels, "quality") == "classification"
    assert infer_problem_type(labels, "doc_id") == "regression"
    assert at_most_two_values(labels, "toxic")
    s = target_stats(labels, "quality").collect()[0]
    assert set(s.asDict()) == {"total_rows", "target_positive_rate_pct"}
    p = profile(labels, "quality")
    assert p.problem_type == "classification" and p.preview.count() == 10
    assert resolve_target(["a", "b_c"], "B C") == "b_c" and resolve_target(["a", "b"], "zz") == "b"


def test_describe_and_experiment_helpers(spark):
    from tidelab.operators.experiments import metrics_map, run_params, run_scores, workspace_summary
    from tidelab.operators.profile import describe_columns

    df = spark.createDataFrame([(1, 2.0, "a")], "a int, b double, c string")
    assert describe_columns(df) == [("a", "int", "INTEGER"), ("b", "double", "REAL"), ("c", "string", "TEXT")]
    metrics = spark.createDataFrame(
        [(1, 10, "f1", 0.5), (2, 10, "f1", 0.7), (3, 10, "accuracy", 0.9), (4, 11, "r2", 0.3), (5, 12, "rmse", 2.0)],
        "id long, run_id long, metric_name string, metric_value double")
    mm = {r["run_id"]: r["metrics"] for r in metrics_map(metrics).collect()}
    assert mm[10] == {"f1": 0.7, "accuracy": 0.9} and mm[12] == {"rmse": 2.0}
    sc = {r["run_id"]: r["score"] for r in run_scores(metrics).collect()}
    assert sc == {10: 0.7, 11: 0.3}  # precedence: f1 before accuracy; run 12 has no score metric
    cfg = spark.createDataFrame([(1, 10, '{"C": 1, "kernel": "rbf"}'), (2, 11, "not json")], "id long, run_id long, params_json string")
    assert sorted((r["run_id"], r["param"], r["value"]) for r in run_params(cfg).collect()) == [(10, "C", "1"), (10, "kernel", "rbf")]
    one = spark.createDataFrame([(1,)], "id long")
    ws = {r["name"]: r["value"] for r in workspace_summary(one, one, one, metrics).collect()}
    assert ws == {"datasets": 1.0, "saved_queries": 1.0, "experiments": 1.0, "best_accuracy": 0.9}


def test_auto_chart(spark):
    from tidelab.operators.charts import auto_chart

    p, data = auto_chart(spark.createDataFrame([("x", 1.0), ("y", 2.0), ("x", 3.0)], "c string, v double"))
    assert p.chart_type == "bar" and {r.label: r.value for r in data.collect()} == {"x": 4.0, "y": 2.0}
