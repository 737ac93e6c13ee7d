"""Exact k-nearest neighbours: a query side against reference rows, in blocks.

The reference rows are dealt into blocks and the query rows into groups, both of a documented byte
bound, and each block meets each group in a call of its own. It scores the queries against the block
by matrix products, takes every reference row that could be among the ``k`` nearest (the k-th
approximate distance and a margin for rounding, so ties are never cut), computes those distances
exactly, and keeps the first ``k`` by (distance, reference id). With more than one block the short lists
of a query, ``k`` rows each, are merged by one aggregate. Only row counts reach the driver. The cost is
queries x references distances, and in the shuffle a copy of the reference rows per group and of the
query rows per block, stated and split over tasks; fitting on a sample of the reference rows is the
caller's choice, never made here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelab.session import ship_package

#: Approximate distances that a step over queries holds at a time (8 MB).
STEP_NUMBERS = 1 << 20

HITS = "array<struct<distance: double, neighbor_id: long, label: double>>"
_HIT_TYPE = pa.list_(pa.struct([("distance", pa.float64()), ("neighbor_id", pa.int64()), ("label", pa.float64())]))


def _as_array(df: DataFrame, col: str) -> Column:
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.col(col).cast("array<double>")
    return vector_to_array(F.col(col))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def per_step(rows: int) -> int:
    """How many queries are scored at a time against that many rows."""
    return max(1, STEP_NUMBERS // max(1, rows))


def _nearest(query: np.ndarray, rows: np.ndarray, squares: np.ndarray, ids: np.ndarray, skip, k: int):
    """For each query the positions and exact distances of its ``k`` nearest rows by (distance, id);
    ``skip[i]`` is an id that query ``i`` may not meet, or None."""
    own = (query * query).sum(1)
    d2 = own[:, None] + squares[None, :] - 2 * query @ rows.T
    margin = 1e-9 * (own + (squares.max() if len(squares) else 0.0)) + 1e-12
    for i in range(len(query)):
        near = d2[i]
        if skip is not None:
            near = np.where(ids == skip[i], np.inf, near)
        kth = np.partition(near, k - 1)[k - 1] if k < len(near) else np.inf
        at = np.flatnonzero((near <= kth + margin[i]) & np.isfinite(near))
        exact = np.sqrt(((rows[at] - query[i]) ** 2).sum(1))
        order = np.lexsort((ids[at], exact))[:k]
        yield at[order], exact[order]


def knn_hits(
    train: DataFrame, queries: DataFrame, k: int = 5, train_id: str = "id", query_id: str = "id",
    features: str = "features", label: str | None = None, exclude_self: bool = False, block_bytes: int = 32 << 20,
    group_bytes: int = 32 << 20,
) -> DataFrame:
    """``(query_id, hits)``: up to ``k`` hits per query row, nearest first, ties by reference id.

    Query ids are unique; ``exclude_self`` passes over reference rows with the query's own id. Rows
    without features take no part. ``block_bytes`` bounds what a task holds of the reference rows, ``group_bytes`` of the
    query rows."""
    label_col = F.col(label).cast("double") if label else F.lit(None).cast("double")
    ref = train.select(
        F.col(train_id).cast("long").alias("id"), label_col.alias("label"), _as_array(train, features).alias("x")
    ).where("x is not null")
    asks = queries.select(F.col(query_id).cast("long").alias("query_id"), _as_array(queries, features).alias("x")).where("x is not null")
    size = ref.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        return asks.select("query_id", F.expr(f"cast(array() as {HITS})").alias("hits"))
    dim = size["d"]
    ship_package(train.sparkSession)
    width = (dim + 2) * 8
    blocks = max(1, -(-size["n"] * width // block_bytes))
    slots = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    groups = max(1, -(-asks.count() * width // group_bytes), -(-slots // blocks))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        rows = _matrix(left.column("x").combine_chunks(), dim) if len(left) else np.zeros((0, dim))
        ids, labels = left.column("id").to_numpy(), left.column("label").to_numpy()
        squares = (rows * rows).sum(1)
        step = per_step(len(rows))
        for a in range(0, len(right), step):
            part = right.slice(a, step)
            skip = part.column("query_id").to_numpy() if exclude_self else None
            queries = _matrix(part.column("x").combine_chunks(), dim)
            hits = [
                [
                    {"distance": d, "neighbor_id": i, "label": None if np.isnan(y) else y}
                    for d, i, y in zip(dist.tolist(), ids[at].tolist(), labels[at].tolist(), strict=True)
                ]
                for at, dist in _nearest(queries, rows, squares, ids, skip, k)
            ]
            out.append(pa.table({"query_id": part.column("query_id"), "hits": pa.array(hits, _HIT_TYPE)}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "hits": pa.array([], _HIT_TYPE)})

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = ref.select("*", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).alias("block"), every(groups).alias("group"))
    right = asks.select("*", F.pmod(F.xxhash64("query_id", "x"), F.lit(groups)).alias("group"), every(blocks).alias("block"))
    out = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(score, f"query_id long, hits {HITS}")
    if blocks == 1:
        return out
    merged = out.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    return merged.select("query_id", F.slice("hits", 1, k).alias("hits"))


def knn_search(train: DataFrame, queries: DataFrame, k: int = 5, train_id: str = "id", query_id: str = "id",
               features: str = "features", exclude_self: bool = False, **kwargs) -> DataFrame:
    """``(query_id, neighbor_id, distance, rank)`` of the ``k`` nearest reference rows by Euclidean
    distance."""
    hits = knn_hits(train, queries, k, train_id, query_id, features, None, exclude_self, **kwargs)
    return hits.select("query_id", F.posexplode("hits").alias("pos", "hit")).select(
        "query_id", "hit.neighbor_id", "hit.distance", (F.col("pos") + 1).alias("rank")
    )


def knn_predict(train: DataFrame, queries: DataFrame, k: int = 5, train_id: str = "id", query_id: str = "id",
                features: str = "features", label: str = "label", exclude_self: bool = False,
                task: str = "classification", **kwargs) -> DataFrame:
    """``(query_id, prediction)``: majority label of the ``k`` neighbours (ties: the smallest label)
    for classification, mean label for regression; null without neighbours."""
    hits = knn_hits(train, queries, k, train_id, query_id, features, label, exclude_self, **kwargs)
    return votes(hits, task, train.schema[label].dataType)


def votes(hits: DataFrame, task: str, kind: T.DataType) -> DataFrame:
    """``(query_id, prediction)`` of hits with labels, as ``knn_predict`` says."""
    labels = F.transform("hits", lambda h: h["label"])
    if task == "regression":
        mean = F.aggregate(labels, F.lit(0.0), lambda a, y: a + y) / F.nullif(F.size("hits"), F.lit(0))
        return hits.select("query_id", mean.alias("prediction"))
    counted = F.transform(
        F.array_distinct(labels),
        lambda y: F.struct(F.size(F.filter(labels, lambda other: other == y)).alias("votes"), (-y).alias("minus")),
    )
    return hits.select("query_id", (-F.array_max(counted)["minus"]).cast(kind).alias("prediction"))
