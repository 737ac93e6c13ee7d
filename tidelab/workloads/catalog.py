"""Workloads of the catalog, the guard, the history and the run log (A2, A3, A7, A10, A12, A13, B5, B8,
B10, C9, D11, D15, E8, E10, F1, F3, F5, F8, G19, G20, G23, G24, G28, G31, G32, H2, I3, J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelab.functions.text import is_date_like, safe_string, to_number
from tidelab.ml.runner import benchmark, resolve_inputs, save_benchmark
from tidelab.ml.split import split_threshold
from tidelab.operators.charts import auto_chart, chart_data
from tidelab.operators.experiments import experiment_details, leaderboard, list_created
from tidelab.operators.prep import Derived
from tidelab.operators.profile import profile
from tidelab.operators.schema import coerce, infer_types
from tidelab.plans.guard import SqlGuardError, check_read_only
from tidelab.plans.sqllab import SqlLab
from tidelab.session import read_table, scratch_dir
from tidelab.sources.catalog import AppendLog, Catalog, list_datasets, to_json_rows
from tidelab.sources.ingest import ingest_csv_text
from tidelab.workloads import register
from tidelab.workloads.experiments import _SCORES, _logs, _with
from tidelab.workloads.ml import _FRAME_SQL, _MD5, _customer_frame


@register(
    "ingest_csv_text",
    """
SELECT CAST(n_nationkey AS BIGINT) AS nation_key, n_name AS nom_du_pays,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS region,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey + 0.5 AS DOUBLE) END AS region_2 FROM nation""",
)
def ingest_csv_text_q(spark, sf_dir):
    """Pasted text (A2) with dirty and doubled headers, CRLF, blank, short and long rows."""
    rows = read_table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    lines = ["﻿Nation Key,Nom du pays!,Region!,region"]
    for r in rows:
        k = r["n_nationkey"]
        cells = [f" {k} ", f'"{r["n_name"]}"'] + ([] if k % 3 == 0 else [str(r["n_regionkey"]), f"{k}.5"])
        lines += [",".join(cells) + (",,extra" if k % 3 == 1 else ""), *([" , ,,"] if k % 5 == 0 else [])]
    return ingest_csv_text(spark, "\r\n".join(lines) + "\r\n", name="nation").df


@register("table_roundtrip", "SELECT * FROM customer")
def table_roundtrip(spark, sf_dir):
    """Table sink (A10) and scan by dataset id (A3)."""
    cat = Catalog(spark)
    return cat.load(cat.register_dataset(read_table(spark, sf_dir, "customer"), "customer", target_column="c_mktsegment"))


_DATASETS = """datasets AS (SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS target_column,
       CASE WHEN c_custkey % 3 = 0 THEN 'tbl_' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN '9 no name' END AS storage_key FROM customer),
columns AS (SELECT o_orderkey AS id, o_custkey AS dataset_id, 'c' || CAST(o_orderkey AS VARCHAR) AS column_name,
       CASE o_orderstatus WHEN 'F' THEN 'TEXT' WHEN 'O' THEN 'INTEGER' ELSE 'REAL' END AS data_type,
       CAST(o_orderkey % 2 AS INTEGER) AS is_target, o_orderkey % 5 AS unique_count FROM orders)"""


@register(
    "list_datasets",
    f"""
WITH {_DATASETS},
t AS (SELECT dataset_id, max(id) AS id FROM columns WHERE is_target = 1 GROUP BY dataset_id),
f AS (SELECT c.* FROM columns c JOIN t ON c.dataset_id = t.dataset_id AND c.id = t.id)
SELECT d.*, f.column_name AS resolved_target,
       CASE WHEN d.id % 3 = 0 THEN d.storage_key ELSE 'dataset_' || CAST(d.id AS VARCHAR) END AS table_name,
       CASE WHEN f.data_type = 'TEXT' THEN 'classification' WHEN f.data_type IS NOT NULL AND f.unique_count <= 2 THEN 'classification'
            ELSE 'regression' END AS inferred_problem_type
FROM datasets d LEFT JOIN f ON f.dataset_id = d.id""",
)
def list_datasets_q(spark, sf_dir):
    key = F.col("c_custkey")
    storage = F.when(key % 3 == 0, F.concat(F.lit("tbl_"), key.cast("string"))).when(key % 3 == 1, F.lit("9 no name"))
    datasets = read_table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("target_column"), storage.alias("storage_key"))
    status = F.col("o_orderstatus")
    columns = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dataset_id"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("column_name"),
        F.when(status == "F", "TEXT").when(status == "O", "INTEGER").otherwise("REAL").alias("data_type"),
        (F.col("o_orderkey") % 2).cast("int").alias("is_target"), (F.col("o_orderkey") % 5).alias("unique_count"))
    return list_datasets(datasets, columns)


@register(
    "append_log_ids",
    """
WITH given AS (SELECT CAST(n_nationkey + 100 AS BIGINT) AS id FROM nation WHERE n_nationkey % 2 = 0),
m AS (SELECT max(id) AS top FROM given), odd AS (SELECT count(*) AS n FROM nation WHERE n_nationkey % 2 = 1)
SELECT id FROM given
UNION ALL SELECT CAST((SELECT top FROM m) + row_number() OVER () AS BIGINT) FROM nation WHERE n_nationkey % 2 = 1
UNION ALL SELECT CAST((SELECT top FROM m) + (SELECT n FROM odd) + row_number() OVER () AS BIGINT) FROM region""",
)
def append_log_ids(spark, sf_dir):
    """Given ids stay, missing ones follow the largest."""
    log = AppendLog(spark, scratch_dir(spark, "log"), "id long, name string")
    nation = read_table(spark, sf_dir, "nation")
    given = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 100).cast("long")
    log.append(nation.select(given.alias("id"), F.col("n_name").alias("name")))
    log.append(read_table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return log.read().select("id")


@register("json_rows", "SELECT CAST(to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}) AS VARCHAR) AS value FROM orders")
def json_rows(spark, sf_dir):
    return to_json_rows(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))


@register(
    "text_cells",
    """
SELECT o_orderkey, COALESCE(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END, '') AS safe,
       o_orderkey % 3 <> 2 AS date_like,
       CAST(CASE o_orderkey % 7 WHEN 0 THEN 12.5 WHEN 1 THEN -300.0 WHEN 2 THEN 0.5 END AS DOUBLE) AS num FROM orders""",
)
def text_cells(spark, sf_dir):
    """Safe strings (B10), date-like texts (B8), and the texts that are no numbers."""
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    when = (F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(key % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
            .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")))
    texts = ["12.5", " -3e2 ", ".5", "1d", "2F", "NaN", "Infinity"]
    cell = F.element_at(F.array(*[F.lit(t) for t in texts]), (key % 7 + 1).cast("int"))
    return o.select(
        "o_orderkey", safe_string(F.when(key % 4 != 0, F.col("o_orderpriority"))).alias("safe"),
        is_date_like(when).alias("date_like"), to_number(cell).alias("num"))


@register(
    "wide_integers",
    """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(repeat('9', 40) AS DOUBLE) ELSE CAST(c_custkey AS DOUBLE) END AS wide FROM customer""",
)
def wide_integers(spark, sf_dir):
    """Integers too wide for any exact type keep a value."""
    c = read_table(spark, sf_dir, "customer")
    text = c.select(F.col("c_custkey").cast("string").alias("c_custkey"),
                    F.when(F.col("c_custkey") % 2 == 0, F.lit("9" * 40)).otherwise(F.col("c_custkey").cast("string")).alias("wide"))
    return coerce(text, {r["column_name"]: r["spark_type"] for r in infer_types(text).collect()})


@register(
    "full_profile",
    """
SELECT 'regression' AS problem_type, count(*) AS total_rows, ROUND(AVG(c_acctbal) * 100) / 100 AS avg_target,
       CAST(5 AS BIGINT) AS columns, CAST(10 AS BIGINT) AS preview_rows FROM customer""",
)
def full_profile(spark, sf_dir):
    p = profile(read_table(spark, sf_dir, "customer"), "c_acctbal")
    return p.stats.select(
        F.lit(p.problem_type).alias("problem_type"), "total_rows", "avg_target",
        F.lit(p.columns.count()).cast("long").alias("columns"), F.lit(p.preview.count()).cast("long").alias("preview_rows"))


@register(
    "prepared_lineage",
    """
SELECT 'segment' AS target_column, '["balance", "c_nationkey"]' AS selected, '["c_custkey", "c_name"]' AS dropped,
       'classification' AS task_type, 'v1' AS version_name, CAST((SELECT count(*) FROM customer) AS BIGINT) AS row_count,
       CAST(3 AS BIGINT) AS steps""",
)
def prepared_lineage(spark, sf_dir):
    """A prepared version's dataset row, selection, type and steps."""
    cat = Catalog(spark)
    src = cat.register_dataset(read_table(spark, sf_dir, "customer"), "customer", target_column="c_mktsegment")
    made = cat.prepare(src, features=["c_acctbal", "c_nationkey"], rename={"c_acctbal": "balance", "c_mktsegment": "segment"},
                       derived=[Derived("both", "sum", "c_acctbal", "c_nationkey")], version_name="v1")
    sel = cat.log("feature_selections").read().select(
        "dataset_id", "target_column", F.col("selected_features_json").alias("selected"),
        F.col("dropped_features_json").alias("dropped"), "task_type")
    ds = cat.log("datasets").read().where(F.col("id") == made["dataset_id"]).select(F.col("id").alias("dataset_id"), "version_name", "row_count")
    steps = cat.log("dataset_transformations").read().count()
    return sel.join(ds, "dataset_id").drop("dataset_id").withColumn("steps", F.lit(steps).cast("long"))


def _clamped_sql(limit: int) -> str:
    return f"""
SELECT CAST(o_custkey AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_custkey
ORDER BY value DESC, label LIMIT {limit}"""


@register("chart_limit_raised", _clamped_sql(5))
def chart_limit_raised(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "orders"), "bar", "o_custkey", None, "count", 1)


@register("chart_limit_lowered", _clamped_sql(500))
def chart_limit_lowered(spark, sf_dir):
    return chart_data(read_table(spark, sf_dir, "orders"), "bar", "o_custkey", None, "count", 100_000)


@register(
    "chart_line_numeric_label",
    """
WITH n AS (SELECT l_linenumber * 5 AS n, count(*) AS c FROM lineitem GROUP BY 1)
SELECT CAST(n AS VARCHAR) AS label, CAST(c AS DOUBLE) AS value FROM n ORDER BY n LIMIT 5""",
)
def chart_line_numeric_label(spark, sf_dir):
    """Numeric labels in numeric order: the first five of 5, 10, 15, ...."""
    li = read_table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 5).alias("n"))
    return chart_data(li, "line", "n", None, "count", 5, order_by="label")


@register("auto_chart", "SELECT r_name AS label, CAST(sum(r_regionkey) AS DOUBLE) AS value FROM region GROUP BY r_name ORDER BY value DESC, label")
def auto_chart_q(spark, sf_dir):
    """The preset for one numeric and one text column is a bar chart of sums."""
    preset, points = auto_chart(read_table(spark, sf_dir, "region"))
    if (preset.chart_type, preset.aggregation, preset.limit) != ("bar", "sum", 12):
        raise RuntimeError(f"unexpected preset {preset}")
    return points


# Statements about a nation, and whether they only read.
STATEMENTS = (
    ("select", "SELECT n_name FROM nation WHERE n_name = '{}'", True),
    ("with", "WITH a AS (SELECT '{}' AS x) SELECT * FROM a", True),
    ("set_operation", "SELECT '{}' UNION ALL SELECT n_name FROM nation", True),
    ("subquery", "SELECT 1 WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = '{}')", True),
    ("explain", "EXPLAIN SELECT '{}'", True),
    ("insert", "INSERT INTO nation SELECT '{}'", False),
    ("with_insert", "WITH a AS (SELECT '{}') INSERT INTO nation SELECT * FROM a", False),
    ("drop", "DROP VIEW `{}`", False),
    ("two", "SELECT '{}'; DROP VIEW nation", False),
    ("set", "SET x = '{}'", False),
    ("immediate", "EXECUTE IMMEDIATE 'CREATE TEMPORARY VIEW `{}` AS SELECT 1'", False),
    ("transform", "SELECT TRANSFORM('{}') USING 'cat' AS (b) FROM nation", False),
    ("java", "SELECT java_method('java.lang.String', 'valueOf', '{}')", False),
    ("nested_reflect", "SELECT (SELECT reflect('java.lang.String', 'valueOf', '{}'))", False),
    ("file", "SELECT * FROM csv.`/tmp/{}`", False),
)


@register(
    "guard_cases",
    "SELECT n_name AS nation, s.kind, s.accepted FROM nation, (VALUES "
    + ", ".join(f"('{kind}', {str(ok).upper()})" for kind, _, ok in STATEMENTS) + ") AS s(kind, accepted)",
)
def guard_cases(spark, sf_dir):
    """What the read-only guard says to each statement about each nation (F1); none is run."""
    out = []
    for (name,) in read_table(spark, sf_dir, "nation").select("n_name").collect():
        for kind, text, _ in STATEMENTS:
            try:
                check_read_only(spark, text.format(name))
                out.append((name, kind, True))
            except SqlGuardError:
                out.append((name, kind, False))
    return spark.createDataFrame(out, "nation string, kind string, accepted boolean")


def _history_lab(spark, sf_dir) -> SqlLab:
    lab = SqlLab(spark.newSession(), history_path=scratch_dir(spark, "history"))
    lab.register_tables(sf_dir, ["region", "nation", "lineitem"])
    return lab


@register(
    "history_append",
    """
SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS id, CAST(r_regionkey AS BIGINT) AS dataset_id,
       CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE left('SELECT r_name, ' || CAST(r_regionkey AS VARCHAR) || repeat(' ', 90), 80) END AS query_name
FROM region""",
)
def history_append(spark, sf_dir):
    """Successful queries are logged under their name, else the text's first 80 characters; failing
    ones are not (F3)."""
    lab = _history_lab(spark, sf_dir)
    for r in read_table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        name = r["r_name"] if r["r_regionkey"] % 2 == 0 else None
        lab.run(f"SELECT r_name, {r['r_regionkey']}{' ' * 90} AS a FROM region", r["r_regionkey"], name)
        lab.run("SELECT nope FROM region", r["r_regionkey"], "never logged")
    return lab.history().select("id", "dataset_id", "query_name")


@register(
    "error_results",
    "SELECT n_name AS nation, n_nationkey % 2 = 0 AS ok, n_nationkey % 2 = 1 AS has_error FROM nation",
)
def error_results(spark, sf_dir):
    """Errors come back as results."""
    lab = _history_lab(spark, sf_dir)
    out = []
    for r in read_table(spark, sf_dir, "nation").collect():
        good = r["n_nationkey"] % 2 == 0
        res = SqlLab(lab.spark).run(f"SELECT {'n_name' if good else 'no_such_column'} FROM nation")
        out.append((r["n_name"], res.ok, bool(res.error)))
    return spark.createDataFrame(out, "nation string, ok boolean, has_error boolean")


@register(
    "chart_logged",
    """
SELECT l_returnflag AS label, ROUND(SUM(l_quantity) * 100) / 100 AS value, 'DataViz bar - l_returnflag / l_quantity' AS query_name
FROM lineitem GROUP BY l_returnflag ORDER BY value DESC, label LIMIT 5""",
)
def chart_logged(spark, sf_dir):
    """The logged text of a chart gives the chart's points (F8)."""
    lab = _history_lab(spark, sf_dir)
    lab.log_chart("lineitem", "bar", "l_returnflag", "l_quantity", "sum", 5, dataset_id=1)
    logged = lab.history().first()
    return lab.run(logged["query_text"]).df.withColumn("query_name", F.lit(logged["query_name"]))


@register(
    "resolved_inputs",
    """
SELECT CAST(ask AS INTEGER) AS ask, target, features, task
FROM (VALUES (1, 'c_mktsegment', 'c_custkey,c_name,c_nationkey,c_acctbal', 'classification'),
             (2, 'c_mktsegment', 'balance,both', 'classification'),
             (3, 'c_acctbal', 'c_nationkey', 'regression')) AS t(ask, target, features, task)
WHERE (SELECT count(*) FROM customer) > 0""",
)
def resolved_inputs(spark, sf_dir):
    """Target, features and task from the request, the latest preparation or the dataset."""
    cat = Catalog(spark)
    src = cat.register_dataset(read_table(spark, sf_dir, "customer"), "customer", target_column="c_mktsegment")
    made = cat.prepare(src, features=["c_acctbal"], rename={"c_acctbal": "balance"},
                       derived=[Derived("both", "sum", "c_acctbal", "c_nationkey")])
    asks = [(src, {}), (made["dataset_id"], {}), (src, {"target": "c_acctbal", "features": ["c_nationkey"]})]
    out = []
    for no, (ds, kw) in enumerate(asks, 1):
        _, target, features, task = resolve_inputs(cat, ds, **kw)
        out.append((no, target, ",".join(features), task))
    return spark.createDataFrame(out, "ask int, target string, features string, task string")


@register(
    "benchmark_log",
    f"""
WITH f AS ({_FRAME_SQL}), s AS (SELECT {_MD5.format(seed=42, key='c_custkey')} < {split_threshold(75)} AS is_train FROM f),
n AS (SELECT count_if(NOT is_train)::BIGINT AS n_test FROM s)
SELECT m.model_name, m.status, m.has_error, m.ends_later, CAST(m.rank AS INTEGER) AS rank, m.scored,
       CASE WHEN m.status = 'completed' THEN n.n_test END AS predictions, CAST(0.75 AS DOUBLE) AS train_size, CAST(0.25 AS DOUBLE) AS test_size
FROM n, (VALUES ('Naive Bayes', 'completed', FALSE, TRUE, 2, TRUE), ('Decision Tree', 'failed', TRUE, TRUE, 3, FALSE),
                ('Logistic Regression', 'completed', FALSE, TRUE, 1, TRUE)) AS m(model_name, status, has_error, ends_later, rank, scored)""",
)
def benchmark_log(spark, sf_dir):
    """A benchmark with one failing model: it goes on, and logs the cause, times, ranks, predictions and
    split (G23, G24, G28, G31, G32)."""
    frame = _customer_frame(spark, sf_dir, "classification")
    models = ["Naive Bayes", "Decision Tree", "Logistic Regression"]
    res = benchmark(frame, "rich", "classification", models, {"Decision Tree": {"max_depth": 99}}, train_split=75, key="c_custkey")
    cat = Catalog(spark)
    exp = save_benchmark(cat, res)
    runs, metrics = cat.log("model_runs").read(), cat.log("metrics").read()
    arts = {r["run_id"]: r["artifact_key"] for r in cat.log("artifacts").read().where("artifact_type = 'predictions'").collect()}
    counts = [(i, spark.read.parquet(cat.table_path(k)).count()) for i, k in arts.items()]
    n = spark.createDataFrame(counts, "run_id long, predictions long").withColumnRenamed("run_id", "id")
    exps = cat.log("experiments").read().select(F.col("id").alias("experiment_id"), "train_size", "test_size")
    return leaderboard(runs, metrics, exp).join(n, "id", "left").join(exps, "experiment_id").select(
        "model_name", "status", F.coalesce(F.col("error_message").contains("max_depth 99"), F.lit(False)).alias("has_error"),
        (F.col("finished_at") >= F.col("started_at")).alias("ends_later"), "rank", F.col("score").isNotNull().alias("scored"),
        "predictions", "train_size", "test_size",
    )


@register(
    "one_experiment",
    _with(_SCORES + """,
lb AS (SELECT *, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY ok DESC, score DESC NULLS LAST, id) AS INTEGER) AS rank
       FROM scored WHERE experiment_id = 10)
SELECT lb.id, lb.rank, CAST((SELECT count(*) FROM metrics m WHERE m.run_id = lb.id) AS INTEGER) AS n_metrics FROM lb"""),
)
def one_experiment(spark, sf_dir):
    """Details and leaderboard of one experiment, children pruned to its runs."""
    lg = _logs(spark, sf_dir)
    details = experiment_details(lg["runs"], lg["configs"], lg["metrics"], lg["artifacts"], 10).select("id", F.size("metrics").alias("n_metrics"))
    return leaderboard(lg["runs"], lg["metrics"], 10).select("id", "rank").join(details, "id")


@register("list_created", "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, id DESC")
def list_created_q(spark, sf_dir):
    return list_created(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")))
