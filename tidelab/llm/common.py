"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelab.session import drop_path, scratch_dir
from tidelab.session import ship_package as ship

__all__ = ["components", "drop_path", "free_name", "local_forest", "parallel_slots", "scratch_dir", "ship", "stored", "utf8"]

#: Spark removes the shuffle files of a query at its end, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet (with writer ``options``) in the shared folder and read it back: cuts
    lineage and survives the loss of executors. The shuffle files of the write go with its end, so that
    those of the next one do not stand beside them. Returns the frame and its folder (for ``drop_path``
    when done)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def parallel_slots(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def utf8(text: Column | str) -> Column:
    """A text column with null as the empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores put before it until it clashes with no column."""
    have = {c.lower() for c in columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between values, thinned to one link from each value to the smallest value of its
    component (its own component's root gets none). Connectivity is the same."""
    if len(a) == 0:
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, new[root])
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(node, root)`` for every node
    that is not its component's smallest node, ``root`` being that smallest node.

    Alternating large-star and small-star rounds: in a large-star step each node hands its larger
    neighbours to the smallest node it knows, in a small-star step its smaller ones. Both are a
    ``min`` aggregate (combined map-side) and a join that AQE may split, so a hub with very many
    neighbours is never gathered in a task. Rounds grow with the logarithm of the nodes; each is
    written to the shared folder. Self links and nulls are dropped; an empty input gives no rows."""
    spark = edges.sparkSession
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e, path = stored(e, name)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt, new_path = stored(nxt, name)
        drop_path(spark, path)
        path = new_path
        # A forest of depth one: every node has one parent and no parent is itself a child.
        many = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        deep = nxt.select(F.col("v").alias("u")).join(nxt.select("u"), "u", "left_semi")
        e = nxt
        if many.unionByName(deep).isEmpty():
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
