"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest reference points (pivots), taken from a bounded sample of the
vectors. Two vectors are candidates if they share at least ``share`` of their ``nearest`` pivots;
candidates are verified by their cosine in double precision.

The inverted lists are rows: a vector goes to the list of (label, pivot) for each of its pivots that
can be the smallest shared one. Lists longer than ``tile`` are keyed once more, where two pivots must be shared, by
the two smallest shared ones, which shortens them by the share of vectors that have the second too; what
is still long (a large group of near copies) is cut into tiles of bounded size, all pairs of which are
worked on in tasks of their own. Inside a tile shared pivots are counted for all its rows at once; a
pair counts only in the list of its smallest shared pivots, so it is found once. Tasks give back a
count and one link per vector, never pairs. Equal vectors are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.llm.common import components, local_forest, parallel_slots, ship, stored


def _matrix(column, dim: int) -> np.ndarray:
    """A list column as doubles, cut or padded with zeros to ``dim`` (only to describe vectors)."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        out[i, : min(dim, len(v))] = v[:dim]
    return out


def _levelled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, so that the largest component lies in [0.5, 1): their norms
    neither overflow nor vanish, and no digit changes."""
    most = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    return np.ldexp(x, -np.frexp(most)[1])


def spread_out(sample: np.ndarray, count: int, apart: float = 0.7) -> np.ndarray:
    """Up to ``count`` reference points of a sample, farthest first: each next one has the least
    largest cosine to those chosen. Ends when all that is left lies within ``apart`` of one, as points
    out of one group of near copies would tell its members apart by noise alone."""
    unit = _levelled(sample)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(count, len(sample)):
        nxt = int(nearest.argmin())
        if nearest[nxt] >= apart:
            break
        chosen.append(nxt)
        nearest = np.maximum(nearest, unit @ unit[nxt])
    return sample[chosen]


def describe(classes: DataFrame, pivots: np.ndarray, nearest: int, kind: str) -> DataFrame:
    """``(cid, grp, n, vec binary, near array<int>)``: ``near`` are the numbers of the nearest pivots
    by cosine, sorted for the lists; ``vec`` holds the components as numpy ``kind``, the width they
    came in."""
    dim = pivots.shape[1]
    unit = _levelled(pivots)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    k = min(nearest, len(unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.empty((len(batch), k), np.int32)
            for at in range(0, len(batch), 4096):
                x = _levelled(_matrix(batch.column(3).slice(at, 4096), dim))
                near[at : at + 4096] = np.argsort(-(x @ unit.T), axis=1, kind="stable")[:, :k]
            near.sort(axis=1)
            vecs = [np.asarray(v, kind).tobytes() for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(vecs, pa.binary()), pa.array(list(near), pa.list_(pa.int32()))],
                ["cid", "grp", "n", "vec", "near"],
            )

    return classes.select("cid", "grp", "n", "vector").mapInArrow(
        run, "cid long, grp long, n long, vec binary, near array<int>"
    )


def _tile_links(rows: dict, mine: np.ndarray, theirs: np.ndarray, heads: list[int], pivots: int, share: int, least: float):
    """Links between two index sets of a tile: candidates share ``share`` pivots of which the
    smallest are ``heads``; then the cosine decides. Yields index pairs."""
    near, unit = rows["near"], rows["unit"]
    weight = np.zeros(pivots, np.float32)
    weight[:] = 1
    weight[: heads[-1]] = 4096  # a smaller shared pivot: the pair belongs to another list
    weight[heads] = 1
    right = np.zeros((len(theirs), pivots), np.float32)
    np.put_along_axis(right, near[theirs], 1, axis=1)
    for at in range(0, len(mine), 1024):
        part = mine[at : at + 1024]
        left = np.zeros((len(part), pivots), np.float32)
        np.put_along_axis(left, near[part], 1, axis=1)
        common = (left * weight) @ right.T
        i, j = np.nonzero((common >= share) & (common < 4096))
        for a in range(0, len(i), 1 << 16):
            x, y = part[i[a : a + (1 << 16)]], theirs[j[a : a + (1 << 16)]]
            close = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            yield x[close], y[close]


def _work(table: pa.Table, pivots: int, share: int, least: float, kind: str) -> pa.Table:
    """All tiles of a unit of work: per class with links, how many vectors they lead to and one link
    to the smallest class its tile connects it with."""
    keys = np.column_stack([table.column(c).to_numpy() for c in ("grp", "p1", "p2", "row", "col")])
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    cid, n = table.column("cid").to_numpy()[order], table.column("n").to_numpy()[order]
    side = table.column("part").to_numpy()[order]
    near = np.array(table.column("near").to_pylist(), np.int64).reshape(len(cid), -1)[order]
    raw = table.column("vec").to_pylist()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if b - a < 2:
            continue
        _, p1, p2, row, col = keys[a]
        heads = [int(p1)] if p2 < 0 else [int(p1), int(p2)]
        vec = np.frombuffer(b"".join(raw[i] for i in order[a:b]), kind).reshape(b - a, -1).astype(np.float64)
        vec = _levelled(vec)
        rows = {"near": near[a:b], "unit": vec / np.linalg.norm(vec, axis=1, keepdims=True)}
        here = np.arange(b - a)
        mine, theirs = (here, here) if row == col else (here[side[a:b] == row], here[side[a:b] == col])
        links = np.zeros(b - a, np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in _tile_links(rows, mine, theirs, heads, pivots, share, least):
            if row == col:
                x, y = x[x != y], y[x != y]
                np.add.at(links, x, n[a:b][y])
            else:
                np.add.at(links, x, n[a:b][y])
                np.add.at(links, y, n[a:b][x])
            got.append((x, y))
            if sum(len(g[0]) for g in got) > 1 << 20:
                got = [local_forest(*(np.concatenate(c) for c in zip(*got, strict=True)))]
        if got:
            x, y = local_forest(*(np.concatenate(c) for c in zip(*got, strict=True)))
            root = here.copy()
            root[x] = y
            on = np.flatnonzero(links)
            out.append((cid[a:b][on], cid[a:b][root[on]], links[on]))
    parts = list(zip(*out, strict=True)) if out else [[np.zeros(0, np.int64)]] * 3
    return pa.table({c: pa.array(np.concatenate(p), pa.int64()) for c, p in zip(("cid", "root", "links"), parts, strict=True)})


def pivot_links(described: DataFrame, pivots: int, share: int, least: float, tile: int, kind: str) -> DataFrame:
    """``(cid, root, links)`` rows of all tiles over the inverted lists of ``described``."""
    spark = described.sparkSession
    at = F.expr(f"sequence(0, greatest(size(near) - {share}, 0))")
    lists = described.where(F.size("near") >= 1).select("*", F.explode(at).alias("i")).select(
        "cid", "grp", "n", "vec", "near", "i", F.element_at("near", F.col("i") + 1).alias("p1")
    )
    sizes = lists.groupBy("grp", "p1").agg(F.count(F.lit(1)).alias("m"))
    long = sizes.where((F.col("m") > tile) & F.lit(share >= 2)).select("grp", "p1")  # one shared pivot: no second key
    minus = F.lit(-1).cast("int")
    plain = lists.join(long, ["grp", "p1"], "left_anti").withColumn("p2", minus)
    deeper = (
        lists.join(long, ["grp", "p1"], "left_semi")
        .select("*", F.explode(F.expr(f"sequence(i + 1, greatest(size(near) - {share} + 1, i + 1))")).alias("k"))
        .withColumn("p2", F.element_at("near", F.col("k") + 1))
    )
    cols = ["cid", "grp", "n", "vec", "near", "p1", "p2"]
    keyed = plain.select(*cols).unionByName(deeper.select(*cols))
    grid = (
        plain.select("grp", "p1", "p2").unionByName(deeper.select("grp", "p1", "p2"))
        .groupBy("grp", "p1", "p2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        .select("grp", "p1", "p2", F.ceil(F.col("m") / tile).alias("parts"))
    )
    placed = keyed.join(grid, ["grp", "p1", "p2"]).withColumn("part", F.pmod(F.xxhash64("cid"), "parts"))
    spread = placed.select(
        *cols, "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    ).select(*cols, "part", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"))
    units = parallel_slots(spark) * 4
    return (
        spread.withColumn("unit", F.pmod(F.xxhash64("grp", "p1", "p2", "row", "col"), F.lit(units)))
        .groupBy("unit")
        .applyInArrow(lambda t: _work(t, pivots, share, least, kind), "cid long, root long, links long")
    )


def near_vectors(
    vectors: DataFrame, least: float = 0.93, pivots: int = 256, sample_rows: int = 4096, nearest: int = 8, share: int = 3, tile: int = 2048,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per vector: ``(vec_id, n_links, component_id, kept)``.

    Vectors are compared when their labels are equal and not null (and they have as many components).
    The index is fitted on a bounded sample, ``sample_rows`` distinct vectors chosen by hash, of which
    ``pivots`` become reference points. Null vectors,
    and those that are zero or hold a null or non-finite component, link with nothing. Repeated
    rows link with each other; a null id is passed over when a component's smallest is taken. An empty
    table gives no rows, other columns are not read."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    ) & F.exists("vector", lambda x: x != 0.0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    valid = rows.where("good")
    classes = valid.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes, _ = stored(
        classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("grp", F.xxhash64("label", F.size("vector"))),
        "vector-classes",
    )
    sample = classes.orderBy(F.xxhash64("vector"), "cid").limit(sample_rows).select("vector").collect()
    if sample:
        dim = max(len(r[0]) for r in sample)
        points = np.zeros((len(sample), dim))
        for i, r in enumerate(sample):
            points[i, : len(r[0])] = r[0]
        points = spread_out(points, pivots)
        described, _ = stored(describe(classes, points, nearest, kind), "described")
        links, _ = stored(pivot_links(described, len(points), min(share, len(points)), least, tile, kind), "vector-links")
    else:
        links = spark.createDataFrame([], "cid long, root long, links long")
    found = links.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    joined = (
        classes.join(found, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .select("label", "vector", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("root", "cid").alias("root"))
    )
    least_id = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least_id, "root").select("label", "vector", "n_links", "component_id")
    linked = valid.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
