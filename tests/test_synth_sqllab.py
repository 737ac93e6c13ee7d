"""Synthetic demo tables, saved example queries through the SQL lab, and the read-only guard."""

import pytest

from tidelab.plans.guard import SqlGuardError, check_read_only, text_check
from tidelab.plans.sqllab import EXAMPLES, SqlLab
from tidelab.session import scratch_dir
from tidelab.sources.synth import synth_retail, synth_saas


def test_synth_retail(spark):
    df = synth_retail(spark)
    assert df.count() == 1200
    r = {x["sale_id"]: x for x in df.where("sale_id in (1, 3, 12)").collect()}
    # n = 3: promo, category Dairy, region West
    assert r[3]["promo_flag"] == 1 and r[3]["product_category"] == "Dairy" and r[3]["region"] == "West"
    assert r[3]["sale_date"] == "2023-01-04"
    assert r[3]["units_sold"] == 40 + 3 * 9 + 3 + 20
    assert r[12]["units_sold"] == 40 + 0 + 0 + 20 - 8
    assert r[1]["discount_pct"] == 0.05 and r[3]["discount_pct"] == 0.14


def test_synth_saas(spark):
    df = synth_saas(spark)
    assert df.count() == 1500
    r = df.where("customer_id = 'CUST-00001'").collect()[0]
    assert r["plan"] == "Pro" and r["seats"] == 19 and r["support_tickets"] == 2
    assert r["monthly_logins"] == 35 and r["churn"] == 0
    assert df.where("churn = 1").count() > 0


def test_examples_run_through_lab(spark):
    lab = SqlLab(spark, history_path=scratch_dir(spark, "history"))
    lab.register("retail_sales", synth_retail(spark))
    lab.register("saas_churn", synth_saas(spark))
    for name, q in EXAMPLES.items():
        res = lab.run(q, dataset_id=1 if "Retail" in name else 2, name=name)
        assert res.ok, res.error
        assert res.df.count() >= 4
    bad = lab.run("SELECT nope FROM retail_sales")
    assert not bad.ok and bad.error
    hist = lab.history()
    assert hist.count() == 4  # failures are not logged
    assert [r["id"] for r in hist.collect()] == [4, 3, 2, 1]
    assert lab.history(dataset_id=2).count() == 2


@pytest.mark.parametrize(
    "q",
    [
        "INSERT INTO t VALUES (1)",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
        "DROP TABLE x",
        "CREATE TABLE t AS SELECT 1",
        "SET spark.sql.ansi.enabled=false",
        "SELECT 1; DROP TABLE x",
        "CACHE TABLE t",
        "EXECUTE IMMEDIATE 'CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1'",
        "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t",
        "SELECT java_method('java.lang.System', 'lineSeparator')",
        "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.System', 'lineSeparator'))",
        "SELECT * FROM csv.`/etc/hostname`",
        "WITH a AS (SELECT * FROM text.`file:/etc/hostname`) SELECT * FROM a",
        "SELECT * FROM (SELECT a FROM t WHERE a IN (SELECT * FROM parquet.`/x`)) q",
        "SELECT * FROM some_python_table_function(1)",
        "EXPLAIN SELECT * FROM json.`/etc/hostname`",
        "EXPLAIN EXTENDED DROP TABLE x",
    ],
)
def test_guard_rejects(spark, q):
    with pytest.raises(SqlGuardError):
        check_read_only(spark, q)


@pytest.mark.parametrize(
    "q",
    ["SELECT 1", "(SELECT 1)", "/* c */ SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "EXPLAIN SELECT 1",
     "SELECT 'drop table' AS s", "SHOW TABLES", "DESCRIBE TABLE nation", "VALUES (1, 2)", "FROM t SELECT a", "SELECT * FROM range(3)",
     "SELECT * FROM t LATERAL VIEW explode(xs) q AS x", "SELECT a, sum(b) OVER (PARTITION BY c) FROM t ORDER BY 1 LIMIT 2 OFFSET 1",
     "SELECT a FROM t GROUP BY ROLLUP (a) HAVING count(*) > 1", "SELECT * FROM t PIVOT (sum(a) FOR b IN (1, 2))",
     "SELECT * FROM a, LATERAL (SELECT * FROM b WHERE a.x = b.x)", "SELECT 1 UNION SELECT 2 EXCEPT SELECT 3"],
)
def test_guard_accepts(spark, q):
    check_read_only(spark, q)


def test_text_fallback():
    text_check("SELECT 'insert' FROM t")
    with pytest.raises(SqlGuardError):
        text_check("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a")
    for bad in ("UPDATE t SET a = 1", "SELECT * FROM csv.`/x`", "SELECT TRANSFORM(a) USING 'cat' FROM t"):
        with pytest.raises(SqlGuardError):
            text_check(bad)


def test_chart_logging_and_sql_text(spark):
    from tidelab.operators.charts import chart_data, chart_sql

    lab = SqlLab(spark, history_path=scratch_dir(spark, "history"))
    lab.register("retail_sales", synth_retail(spark))
    q = chart_sql("retail_sales", "bar", "region", "revenue", "sum", 3)
    via_sql = {r["label"]: r["value"] for r in lab.run(q).df.collect()}
    via_df = {r["label"]: r["value"] for r in chart_data(synth_retail(spark), "bar", "region", "revenue", "sum", 3).collect()}
    assert via_sql.keys() == via_df.keys() and via_sql == via_df
    lab.log_chart("retail_sales", "bar", "region", "revenue", dataset_id=1)
    names = [r["query_name"] for r in lab.history().collect()]
    assert names[0] == "DataViz bar - region / revenue"
    sample = chart_data(synth_retail(spark), "scatter", "ad_spend", "revenue", limit=20, sample="random").collect()
    again = chart_data(synth_retail(spark), "scatter", "ad_spend", "revenue", limit=20, sample="random").collect()
    assert len(sample) == 20 and sample == again
