"""The workbench facade end to end: upload → profile → prepare → SQL → train → experiments."""

from tidelab.sources.synth import synth_saas
from tidelab.workbench import Workbench


def test_workbench_flow(spark):
    wb = Workbench(spark)
    pdf = synth_saas(spark, 300).toPandas()
    res = wb.import_csv(csv_text=pdf.to_csv(index=False), name="saas", target="churn")
    ds = res.dataset_id
    assert wb.list_datasets().count() == 1
    prof = wb.profile(ds)
    assert prof.problem_type == "classification"
    prep = wb.prepare(ds, target="churn", features=["plan", "seats", "monthly_logins", "support_tickets"], version_name="v1")
    assert wb.preparations(ds).count() == 1
    q = wb.run_sql("SELECT industry, max(seats) AS widest FROM dataset_1 WHERE nps > 50 GROUP BY industry", dataset_id=ds)
    assert q.ok, q.error
    assert q.df.count() == 5 and wb.sql_history(ds).count() == 1
    points = wb.chart(ds, "bar", "plan", "seats", "avg", 5).collect()
    logged = wb.sql_history(ds).first()
    assert logged["query_name"] == "DataViz bar - plan / seats"
    assert wb.run_sql(logged["query_text"]).df.collect() == points
    assert wb.suggest_chart(ds).chart_type == "scatter"
    exp = wb.train_all(prep["dataset_id"], models=["Logistic Regression", "Naive Bayes"])
    lst = wb.experiments().collect()
    assert lst[0]["id"] == exp and lst[0]["run_count"] == 2 and lst[0]["best_model"] is not None
    det = wb.experiment(exp)
    assert det.leaderboard.count() == 2 and det.runs.count() == 2
    assert wb.models().count() == 12
