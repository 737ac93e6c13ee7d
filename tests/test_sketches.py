"""Mergeable column sketches: merged parts against the whole, appends through the catalog, odd columns."""

import pytest

from tidelab.operators.sketches import column_sketches, sketch_estimates
from tidelab.sources.catalog import Catalog


def by_name(df):
    return {r.column_name: r for r in df.collect()}


def frame(spark, low, high):
    return spark.range(low, high).selectExpr(
        "id", "cast(id % 5000 as string) as code", "if(id % 4 = 0, null, if(id % 4 = 1, ' ', concat('k', id % 3))) as kind",
        "if(id % 10 = 0, cast('NaN' as double), id / 7) as x",
    )


def test_parts_merge_into_the_whole(spark):
    whole = by_name(sketch_estimates(column_sketches(frame(spark, 0, 30_000)), top=2))
    parts = column_sketches(frame(spark, 0, 100))
    for low, high in ((100, 9000), (9000, 9000), (9000, 30_000)):
        parts = parts.unionByName(column_sketches(frame(spark, low, high)))
    merged = by_name(sketch_estimates(parts, top=3))
    for c in ("id", "code", "kind", "x"):
        assert merged[c].unique_count == whole[c].unique_count and merged[c].cells == 30_000 and merged[c].missing == whole[c].missing
    assert merged["kind"].missing == 15_000 and merged["kind"].unique_count == 3 and merged["kind"].quantiles is None
    assert merged["id"].unique_count == pytest.approx(30_000, rel=0.05) and merged["code"].unique_count == pytest.approx(5000, rel=0.05)
    assert merged["x"].quantiles == pytest.approx([30_000 / 7 * q for q in (0.25, 0.5, 0.75)], abs=30_000 / 7 * 0.02)
    assert [(h.item, h["count"]) for h in merged["kind"].heavy] == [("k0", 5000), ("k1", 5000), ("k2", 5000)]


def test_appended_rows_are_sketched_once(spark):
    catalog = Catalog(spark)
    dataset = catalog.register_dataset(frame(spark, 0, 500), "parts")
    catalog.append_rows(dataset, frame(spark, 500, 800))
    catalog.append_rows(dataset, frame(spark, 800, 1000).select("x", "kind", "code", "id"))
    got = by_name(catalog.column_estimates(dataset))
    assert catalog.load(dataset).count() == 1000 and got["id"].cells == 1000
    assert got["id"].unique_count == pytest.approx(1000, rel=0.05)
    assert catalog.log("column_sketches").read().count() == 12
    with pytest.raises(ValueError, match="columns"):
        catalog.append_rows(dataset, spark.range(3))


def test_empty_table(spark):
    got = by_name(sketch_estimates(column_sketches(frame(spark, 0, 0))))
    assert all(r.cells == 0 and r.unique_count == 0 and r.quantiles is None and r.heavy == [] for r in got.values())


def test_an_appended_aggregate_is_computed_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from tidelab.sources.catalog import AppendLog

    seen = spark.sparkContext.accumulator(0)

    @F.udf(T.LongType())
    def counted(v):
        seen.add(1)
        return v

    rows = spark.range(20).coalesce(1).select(counted("id").alias("v")).agg(F.sum("v").alias("total"))
    one = rows.select(F.inline(F.array(F.struct(F.col("total")))))
    log = AppendLog(spark, str(tmp_path / "log"), "id long, total long")
    log.append(one)
    assert [(r.id, r.total) for r in log.read().collect()] == [(1, 190)]
    assert seen.value == 20
