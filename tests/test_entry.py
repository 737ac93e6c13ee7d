"""Driver contract: registry importable without a session, every query of the library has a
name-matched oracle, and the flagship runs."""

import os
import re
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_imports_without_session():
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.strip().splitlines()[-1]) >= 60


def test_every_query_of_the_library_has_an_oracle():
    import __spark_entry__ as e

    missing = set(e.queries()) - set(e.oracle_sql())
    own = {m for m in missing if not re.match(r"op\d+_|pipeline$", m)}  # tested where they live
    assert not own, own


def test_entry_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert df.columns == ["region", "total_revenue"]
    assert len(rows) == 5 and rows[0]["total_revenue"] >= rows[-1]["total_revenue"]


def test_sql_workloads_leave_caller_views_alone(spark):
    import __spark_entry__ as e

    spark.range(3).createOrReplaceTempView("lineitem")
    e.queries()["sql_rollup"](spark, "/root/testdata/sf0.001").collect()
    assert spark.table("lineitem").count() == 3
    spark.catalog.dropTempView("lineitem")
