"""Learners whose results SQL can state: the first boosted tree, and facts of the dual solvers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidelab.functions.text import round_value
from tidelab.ml.boosting import SecondOrderBoosting
from tidelab.ml.dual import DualSVC, DualSVR
from tidelab.ml.folds import cross_validate_linear
from tidelab.ml.neighbours import indexed_search
from tidelab.session import read_table
from tidelab.workloads import register

_CUTS = ([5.0 * i for i in range(1, 10)], [i / 100 for i in range(0, 10)], [i / 100 for i in range(0, 8)])
_CUTS_SQL = ", ".join(f"({j}, {b}, {t!r}::DOUBLE)" for j, cuts in enumerate(_CUTS) for b, t in enumerate(cuts))


def _level_sql(level: int) -> str:
    """The best split of every node of a level, from the rows ``r<level>``, and the rows one level down."""
    return f"""
long{level} AS (SELECT r.node, f.feature, f.v, r.g, r.h FROM r{level} r,
  LATERAL (SELECT unnest([0, 1, 2]) AS feature, unnest([r.x0, r.x1, r.x2]) AS v) f),
sums{level} AS (SELECT node, sum(g) AS g, sum(h) AS h FROM r{level} GROUP BY node),
side{level} AS (
  SELECT l.node, l.feature, c.bin, c.threshold, m.missing_left, count_if(l.v IS NULL) AS missing,
         sum(CASE WHEN (l.v IS NULL AND m.missing_left) OR l.v <= c.threshold THEN l.g ELSE 0 END) AS gl,
         sum(CASE WHEN (l.v IS NULL AND m.missing_left) OR l.v <= c.threshold THEN l.h ELSE 0 END) AS hl
  FROM long{level} l JOIN cuts c ON c.feature = l.feature, (VALUES (TRUE), (FALSE)) m(missing_left)
  GROUP BY ALL),
gain{level} AS (
  SELECT s.*, 0.5 * (gl * gl / (hl + 1) + (n.g - gl) * (n.g - gl) / (n.h - hl + 1) - n.g * n.g / (n.h + 1)) AS gain
  FROM side{level} s JOIN sums{level} n ON n.node = s.node
  WHERE (missing > 0 OR NOT missing_left) AND hl >= 1 AND n.h - hl >= 1),
best{level} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, missing_left DESC) AS place
                 FROM gain{level} WHERE gain > 0) WHERE place = 1),
r{level + 1} AS (
  SELECT r.x0, r.x1, r.x2, r.g, r.h,
         2 * r.node + CASE WHEN CASE b.feature WHEN 0 THEN r.x0 WHEN 1 THEN r.x1 ELSE r.x2 END IS NULL
                                THEN CASE WHEN b.missing_left THEN 0 ELSE 1 END
                           WHEN CASE b.feature WHEN 0 THEN r.x0 WHEN 1 THEN r.x1 ELSE r.x2 END <= b.threshold THEN 0 ELSE 1 END AS node
  FROM r{level} r JOIN best{level} b ON b.node = r.node),"""


def _node_sql(level: int, last: bool) -> str:
    if last:
        return f"""SELECT node::INTEGER AS node, NULL::INTEGER AS feature, NULL::DOUBLE AS threshold, NULL::BOOLEAN AS missing_left,
       NULL::DOUBLE AS gain, sum(g)::DOUBLE AS g, sum(h)::DOUBLE AS h, ROUND(-0.5 * sum(g) / (sum(h) + 1) * 1e9) / 1e9 AS leaf FROM r{level} GROUP BY node"""
    return f"""SELECT n.node::INTEGER AS node, b.feature::INTEGER AS feature, b.threshold, b.missing_left, ROUND(b.gain * 1e6) / 1e6 AS gain, n.g::DOUBLE AS g, n.h::DOUBLE AS h,
       CASE WHEN b.node IS NULL THEN ROUND(-0.5 * n.g / (n.h + 1) * 1e9) / 1e9 END AS leaf
FROM sums{level} n LEFT JOIN best{level} b ON b.node = n.node"""


@register(
    "boosting_first_tree",
    f"""
WITH cuts(feature, bin, threshold) AS (VALUES {_CUTS_SQL}),
r0 AS (SELECT l_quantity::DOUBLE AS x0, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount::DOUBLE END AS x1,
              CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN NULL ELSE l_tax::DOUBLE END AS x2,
              CASE WHEN l_extendedprice > 40000 THEN -0.5 ELSE 0.5 END::DOUBLE AS g, 0.25::DOUBLE AS h, 1 AS node FROM lineitem),
{_level_sql(0)}{_level_sql(1)}{_level_sql(2)}
nodes AS (
{_node_sql(0, False)}
UNION ALL {_node_sql(1, False)}
UNION ALL {_node_sql(2, False)}
UNION ALL {_node_sql(3, True)})
SELECT * FROM nodes""",
)
def boosting_first_tree(spark, sf_dir):
    """(G11) The first tree of the boosting, three levels deep, over given thresholds and columns with
    missing values: every node's sums, gain, side of the missing rows and leaf value."""
    li = read_table(spark, sf_dir, "lineitem")
    x = F.array(
        F.col("l_quantity").cast("double"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount").cast("double")),
        F.when(~((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 2)), F.col("l_tax").cast("double")),
    )
    data = li.select(x.alias("features"), F.when(F.col("l_extendedprice") > 40000, 1.0).otherwise(0.0).alias("label"))
    model = SecondOrderBoosting(rounds=1, maxDepth=3, learningRate=0.5, thresholds=[list(c) for c in _CUTS]).fit(data)
    return model.tree_rows(spark).select(
        "node", "feature", "threshold", "missing_left", round_value(F.col("gain"), 6).alias("gain"), "g", "h", round_value(F.col("leaf"), 9).alias("leaf")
    )


_ORDER_SQL = "SELECT count(*)::BIGINT AS n, 0::BIGINT AS outside_box, 0::BIGINT AS negative_terms, TRUE AS gap_reached, TRUE AS gap_confirmed, TRUE AS weights_confirmed FROM orders"


def _order_frame(spark, sf_dir, label):
    o = read_table(spark, sf_dir, "orders")
    months = (F.year("o_orderdate") - 1995) + F.month("o_orderdate") / 12
    x = array_to_vector(F.array(F.col("o_totalprice").cast("double") / 100_000, months.cast("double")))
    return o.select("o_orderkey", x.alias("features"), label.cast("double").alias("label"))


def _certificate(data, model, tol: float, C: float, term, low: float):
    """Facts of a dual solution, from its rows: variables outside their box, terms of the duality gap below
    zero (each row's is at least 0), whether the terms' sum is the gap that the fit reported and under the bound,
    and whether the variables make up the weights."""
    rows = model.duals.withColumn("term", term)
    sign = F.lit(1.0) if model.regression else F.col("y")
    joined = rows.join(data.select(F.col("o_orderkey").alias("key"), vector_to_array("features").alias("x")), "key")
    weights = [F.abs(F.sum(F.col("a") * sign * F.col("x")[j]) - F.lit(float(w))) for j, w in enumerate(model.weights[:-1])]
    far = F.greatest(*weights, F.abs(F.sum(F.col("a") * sign) - F.lit(float(model.weights[-1]))))
    facts = model.facts
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("a") < low) | (F.col("a") > C)).alias("outside_box"),
        F.count_if(F.col("term") < -1e-9).alias("negative_terms"),
        (F.sum("term") <= tol * facts["primal"]).alias("gap_reached"),
        (F.abs(F.sum("term") - F.lit(facts["gap"])) <= 1e-6 * facts["primal"]).alias("gap_confirmed"),
        (far <= 1e-6 * (1 + float(abs(model.weights).max()))).alias("weights_confirmed"),
    )


@register("svm_dual_certificate", _ORDER_SQL)
def svm_dual_certificate(spark, sf_dir):
    """(G8) Dual coordinate ascent on all orders: the certificate is recomputed from the dual variables."""
    data = _order_frame(spark, sf_dir, F.col("o_orderstatus") == "F")
    model = DualSVC(C=1.0, tol=0.02, epochs=10, keyCol="o_orderkey").fit(data)
    slack = 1 - F.col("y") * F.col("margin")
    return _certificate(data, model, 0.02, 1.0, F.greatest(F.lit(0.0), slack) - F.col("a") * slack, 0.0)


@register("svr_dual_certificate", _ORDER_SQL)
def svr_dual_certificate(spark, sf_dir):
    """(G4) The same for regression of the year on price and date."""
    data = _order_frame(spark, sf_dir, F.year("o_orderdate") - 1994)
    model = DualSVR(C=1.0, epsilon=0.1, tol=0.02, epochs=10, keyCol="o_orderkey").fit(data)
    off = F.col("y") - F.col("margin")
    term = F.greatest(F.lit(0.0), F.abs(off) - 0.1) + 0.1 * F.abs("a") - F.col("a") * off
    return _certificate(data, model, 0.02, 1.0, term, -1.0)


@register(
    "knn_indexed",
    """
WITH o AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE / 100000 AS x, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE / 365 AS y FROM orders),
d AS (SELECT q.id AS query_id, r.id AS neighbor_id, sqrt((r.x - q.x) * (r.x - q.x) + (r.y - q.y) * (r.y - q.y)) AS distance
      FROM o q JOIN o r ON r.id <> q.id WHERE q.id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, neighbor_id, round(distance * 1e9) / 1e9 AS distance, rank::INTEGER AS rank FROM k WHERE rank <= 5""",
)
def knn_indexed(spark, sf_dir):
    """(G7) The five nearest orders by price and date of every order whose key is divisible by 20, through
    the index of random projections, with exact search where the index does not prove the answer."""
    o = read_table(spark, sf_dir, "orders")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double") / 365
    x = F.array(F.col("o_totalprice").cast("double") / 100_000, days)
    rows = o.select(F.col("o_orderkey").alias("id"), x.alias("features"))
    found = indexed_search(rows, rows.where("id % 20 = 0"), 5, exclude_self=True)
    return found.select("query_id", "neighbor_id", round_value(F.col("distance"), 9).alias("distance"), "rank")


_FOLD_OF_LINE = "('0x' || substr(md5('42|' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), 1, 15))::BIGINT % 4"


@register(
    "cross_validate_ridge",
    f"""
WITH rows AS (
  SELECT {_FOLD_OF_LINE} AS fold, l_extendedprice::DOUBLE + 2000 * l_quantity::DOUBLE AS y, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity::DOUBLE END AS a,
         l_discount::DOUBLE * 100 AS b FROM lineitem),
means AS (
  SELECT k.fold, avg(r.a) AS ma, avg(r.b) AS mb, avg(r.y) AS my, count(*) AS n
  FROM (SELECT DISTINCT fold FROM rows) k JOIN rows r ON r.fold <> k.fold GROUP BY k.fold),
filled AS (
  SELECT m.fold, r.fold <> m.fold AS train, coalesce(r.a, m.ma) - m.ma AS a, r.b - m.mb AS b, r.y - m.my AS y, m.n
  FROM means m, rows r),
moments AS (
  SELECT fold, any_value(n) AS n, sqrt(sum(a * a) / (any_value(n) - 1)) AS sa, sqrt(sum(b * b) / (any_value(n) - 1)) AS sb,
         sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS bxy FROM filled WHERE train GROUP BY fold),
system AS (
  SELECT m.*, p.alpha, n - 1 + p.alpha AS d, ab / (sa * sb) AS c, ay / sa AS u, bxy / sb AS v
  FROM moments m, (VALUES (0.0::DOUBLE), (1000.0), (50000.0)) p(alpha)),
fits AS (
  SELECT fold, alpha, n, (u * d - v * c) / (d * d - c * c) / sa AS wa, (v * d - u * c) / (d * d - c * c) / sb AS wb FROM system),
errors AS (
  SELECT f.fold, f.alpha, f.n AS n_train, count(*) AS n_test, sum((r.y - wa * r.a - wb * r.b) ** 2) AS sse, var_pop(r.y) * count(*) AS sst
  FROM fits f JOIN filled r ON r.fold = f.fold AND NOT r.train GROUP BY ALL),
scores AS (SELECT fold, alpha, n_train, n_test, sqrt(sse / n_test) AS rmse, 1 - sse / sst AS r2 FROM errors),
both_kinds AS (
  SELECT * FROM scores UNION ALL
  SELECT -1, alpha, NULL, sum(n_test), avg(rmse), avg(r2) FROM scores GROUP BY alpha)
SELECT fold::INTEGER AS fold, alpha, n_train::BIGINT AS n_train, n_test::BIGINT AS n_test, round(rmse * 1e3) / 1e3 AS rmse, round(r2 * 1e6) / 1e6 AS r2
FROM both_kinds""",
)
def cross_validate_ridge(spark, sf_dir):
    """(G30, G2) Four folds and three penalties of a price made to grow with the quantity, by the quantity,
    missing in places, and the discount, from one pass of sums that add up over folds."""
    li = read_table(spark, sf_dir, "lineitem")
    data = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), (F.col("l_extendedprice").cast("double") + 2000 * F.col("l_quantity").cast("double")).alias("price"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double")).alias("quantity"),
        (F.col("l_discount").cast("double") * 100).alias("discount"),
    )
    found = cross_validate_linear(data, "price", "Ridge", [0.0, 1000.0, 50000.0], folds=4, key="line")
    return found.select("fold", "alpha", "n_train", "n_test", round_value(F.col("rmse"), 3).alias("rmse"), round_value(F.col("r2"), 6).alias("r2"))
