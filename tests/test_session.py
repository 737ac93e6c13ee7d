"""Session helpers: scratch paths under the shared checkpoint folder, materialisation, release."""

from tidelab.session import drop_path, ensure_checkpoint_dir, materialize, scratch_dir


def test_scratch_and_materialize(spark):
    base = ensure_checkpoint_dir(spark)
    p1, p2 = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert p1 != p2 and p1.startswith(base.rstrip("/"))
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    m = materialize(df, "t")
    assert m.count() == 100 and sorted(m.columns) == ["id", "twice"]
    assert "parquet" in m._jdf.queryExecution().optimizedPlan().toString().lower() or m.inputFiles()


def test_dropped_scratch_is_gone(spark):
    path = scratch_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    drop_path(spark, path)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)
