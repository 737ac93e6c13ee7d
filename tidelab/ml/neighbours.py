"""Nearest neighbours through an index of random projections, with a proof per answer.

Rows are projected on a few random orthonormal directions, and each direction is cut at quantiles of the
reference rows, which makes a grid of cells. A projection on orthonormal directions never lengthens a
distance, so a query's distance to a cell's box is a lower bound of its distance to every row in it. A
query probes the cells whose boxes are nearest; the smallest bound among cells not probed is its
``bound``. Where the k-th neighbour found is nearer than that, no other row can be among the ``k``:
the answer is proven and equals exact search. The rest are answered by exact search (``exact=True``) or
returned as found and marked (``exact=False``).

Reference rows and probes meet by cell in a cogroup. A cell that holds many rows or draws many probes
is dealt into parts on both sides, so that no task holds more than about ``tile`` rows of either; nothing
is capped. The grid grows with the rows (about ``cell_rows`` to a cell), the probes of a query do not.
The driver holds the cuts (one list a direction) and counts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.ml.knn import HITS, _HIT_TYPE, _as_array, _matrix, _nearest, knn_hits, per_step
from tidelab.session import materialize, ship_package


def random_directions(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` orthonormal directions of ``dim`` components, as rows."""
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return basis.T[:count].copy()


def cells_of(projected: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The cell number of each projected row; a row on a cut belongs to the cell above it."""
    cell = np.zeros(len(projected), np.int64)
    for j, c in enumerate(cuts):
        cell = cell * (len(c) + 1) + np.searchsorted(c, projected[:, j], side="right")
    return cell


def probes_of(projected: np.ndarray, cuts: list[np.ndarray], window: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each projected query the ``probes`` cells with the nearest boxes, of those at most
    ``window`` cells off in every direction (-1: no such cell), and a lower bound of the distance to
    every cell left out."""
    n, steps = len(projected), np.arange(-window, window + 1)
    gaps, places, beyond = [], [], np.full(n, np.inf)
    for j, c in enumerate(cuts):
        x = projected[:, j]
        low, high = np.concatenate([[-np.inf], c]), np.concatenate([c, [np.inf]])
        own = np.searchsorted(c, x, side="right")
        at = own[:, None] + steps
        inside = (at >= 0) & (at <= len(c))
        held = np.clip(at, 0, len(c))
        gap = np.maximum(np.maximum(low[held] - x[:, None], x[:, None] - high[held]), 0.0)
        gaps.append(np.where(inside, gap, np.inf))
        places.append(held)
        # The nearest cells outside the window start at its edges.
        first, last = own - window, own + window
        beyond = np.minimum(beyond, np.where(first > 0, x - low[np.clip(first, 0, len(c))], np.inf))
        beyond = np.minimum(beyond, np.where(last < len(c), high[np.clip(last, 0, len(c))] - x, np.inf))
    combos = list(itertools.product(range(len(steps)), repeat=len(cuts)))
    far = np.empty((n, len(combos)))
    cell = np.empty((n, len(combos)), np.int64)
    for i, combo in enumerate(combos):
        total, number = np.zeros(n), np.zeros(n, np.int64)
        for j, s in enumerate(combo):
            total += gaps[j][:, s] ** 2
            number = number * (len(cuts[j]) + 1) + places[j][:, s]
        far[:, i] = np.sqrt(total)
        cell[:, i] = number
    order = np.argsort(far, axis=1, kind="stable")
    far, cell = np.take_along_axis(far, order, axis=1), np.take_along_axis(cell, order, axis=1)
    bound = beyond if len(combos) <= probes else np.minimum(beyond, far[:, probes])
    return np.where(np.isfinite(far[:, :probes]), cell[:, :probes], -1), bound


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each query by (distance, id), in two steps, so that a query with probes in
    a cell of many parts has its lists shortened before they meet."""
    best = lambda df, *by: df.groupBy("query_id", *by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
    return best(best(found.withColumn("share", F.pmod(F.xxhash64("cell", "part"), F.lit(64))), "share"))


def indexed_hits(
    train: DataFrame, queries: DataFrame, k: int = 5, train_id: str = "id", query_id: str = "id", features: str = "features",
    label: str | None = None, exclude_self: bool = False, exact: bool = True, directions: int = 3, window: int = 2,
    probes: int = 12, cell_rows: int = 512, tile: int = 50_000, seed: int = 42,
) -> DataFrame:
    """``(query_id, hits, proven)``: up to ``k`` hits per query row, nearest first, ties by reference id;
    ``proven`` says that the index alone shows them to be the nearest. With ``exact`` the others are
    searched exactly, so all hits equal those of ``knn_hits``.

    Query ids are unique; ``exclude_self`` passes over reference rows with the query's own id. Rows without
    features take no part, and all others have as many components; without reference rows the hits are empty
    and proven. Repeated reference rows are neighbours like any other."""
    spark = train.sparkSession
    ship_package(spark)
    label_col = F.col(label).cast("double") if label else F.lit(None).cast("double")
    ref = train.select(F.col(train_id).cast("long").alias("id"), label_col.alias("label"), _as_array(train, features).alias("x")).where("x is not null")
    asks = queries.select(F.col(query_id).cast("long").alias("query_id"), _as_array(queries, features).alias("x")).where("x is not null")
    size = ref.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        return asks.select("query_id", F.expr(f"cast(array() as {HITS})").alias("hits"), F.lit(True).alias("proven"))
    dim = size["d"]
    axes = random_directions(dim, min(directions, dim), seed)

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x @ axes.T), pa.list_(pa.float64()))], ["id", "label", "x", "p"])

    placed = materialize(ref.mapInArrow(project, "id long, label double, x array<double>, p array<double>"), "projected")
    per_axis = max(1, round((size["n"] / cell_rows) ** (1 / len(axes))))
    shares = [i / per_axis for i in range(1, per_axis)]
    cuts = [np.zeros(0)] * len(axes)
    if shares:
        row = placed.agg(*[F.percentile_approx(F.col("p")[j], shares, 10 * per_axis).alias(f"c{j}") for j in range(len(axes))]).first()
        cuts = [np.unique(np.asarray(row[j], float)) for j in range(len(axes))]

    def place(batches):
        for batch in batches:
            p = _matrix(batch.column(3), len(axes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells_of(p, cuts))], ["id", "label", "x", "cell"])

    def probe(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                cells, bound = probes_of(_matrix(part.column(1), dim) @ axes.T, cuts, window, probes)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(cells), pa.list_(pa.int64())), pa.array(bound)], ["query_id", "x", "cells", "bound"]
                )

    rows = placed.mapInArrow(place, "id long, label double, x array<double>, cell long")
    asked = materialize(asks.mapInArrow(probe, "query_id long, x array<double>, cells array<long>, bound double"), "probes")
    probed = asked.select("query_id", "x", F.explode("cells").alias("cell")).where("cell >= 0")
    parts = (
        rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("r"))
        .join(probed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("q")), "cell")
    )
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.join(parts, "cell").select("id", "label", "x", "cell", F.pmod(F.xxhash64("id", "x"), "r").alias("part"), upto("q").alias("side"))
    right = probed.join(parts, "cell").select("query_id", "x", "cell", F.pmod(F.xxhash64("query_id"), "q").alias("side"), upto("r").alias("part"))

    def score(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        cell, part = key[0].as_py(), key[1].as_py()
        out = []
        if len(mine) and len(theirs):
            ref_x = _matrix(mine.column("x").combine_chunks(), dim)
            ids, labels = mine.column("id").to_numpy(), mine.column("label").to_numpy()
            squares = (ref_x * ref_x).sum(1)
            step = per_step(len(ref_x))
            for a in range(0, len(theirs), step):
                some = theirs.slice(a, step)
                skip = some.column("query_id").to_numpy() if exclude_self else None
                x = _matrix(some.column("x").combine_chunks(), dim)
                hits = [
                    [
                        {"distance": d, "neighbor_id": i, "label": None if np.isnan(y) else y}
                        for d, i, y in zip(dist.tolist(), ids[at].tolist(), labels[at].tolist(), strict=True)
                    ]
                    for at, dist in _nearest(x, ref_x, squares, ids, skip, k)
                ]
                out.append(pa.table({"query_id": some.column("query_id"), "hits": pa.array(hits, _HIT_TYPE),
                                     "cell": pa.array([cell] * len(hits), pa.int64()), "part": pa.array([part] * len(hits), pa.int64())}))
        empty = {"query_id": pa.array([], pa.int64()), "hits": pa.array([], _HIT_TYPE), "cell": pa.array([], pa.int64()), "part": pa.array([], pa.int64())}
        return pa.concat_tables(out) if out else pa.table(empty)

    found = left.groupBy("cell", "part", "side").cogroup(right.groupBy("cell", "part", "side")).applyInArrow(
        score, f"query_id long, hits {HITS}, cell long, part long"
    )
    hits = asked.select("query_id", "bound").join(_merged(found, k), "query_id", "left").select(
        "query_id", F.coalesce("hits", F.expr(f"cast(array() as {HITS})")).alias("hits"), "bound"
    )
    # Strictly nearer by more than rounding can hide: a row at the same distance may have a smaller id.
    last = F.when(F.size("hits") >= k, F.element_at("hits", -1)["distance"])
    proven = (F.col("bound") == float("inf")) | F.coalesce(last * (1 + 1e-9) + 1e-12 < F.col("bound"), F.lit(False))
    answers = materialize(hits.select("query_id", "hits", proven.alias("proven")), "answers")
    if not exact:
        return answers
    left_over = asked.select("query_id", "x").join(answers.where(~F.col("proven")).select("query_id"), "query_id", "left_semi")
    searched = knn_hits(ref, left_over, k, "id", "query_id", "x", "label", exclude_self)
    return answers.where("proven").unionByName(searched.select("query_id", "hits", F.lit(False).alias("proven")))


def indexed_search(train: DataFrame, queries: DataFrame, k: int = 5, **kwargs) -> DataFrame:
    """``(query_id, neighbor_id, distance, rank)`` of ``indexed_hits``."""
    return indexed_hits(train, queries, k, **kwargs).select("query_id", F.posexplode("hits").alias("pos", "hit")).select(
        "query_id", "hit.neighbor_id", "hit.distance", (F.col("pos") + 1).alias("rank")
    )
