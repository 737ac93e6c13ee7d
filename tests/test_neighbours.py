"""The projection index against exact search: bounds, proofs, hot cells, odd rows."""

import numpy as np
import pytest

from tidelab.ml.neighbours import cells_of, indexed_hits, indexed_search, probes_of, random_directions


def brute(ref, asks, k, skip_self=False):
    out = {}
    for q, x in asks:
        d = sorted((float(np.sqrt(((np.array(y) - np.array(x)) ** 2).sum())), i) for i, y in ref if y is not None and not (skip_self and i == q))
        out[q] = [(i, pytest.approx(v, abs=1e-9)) for v, i in d[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.neighbor_id, r.distance))
    return out


def test_bounds_hold_for_every_row_not_probed():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(3000, 5)), rng.normal(size=(60, 5)) * 1.5
    axes = random_directions(5, 3, 1)
    assert np.allclose(axes @ axes.T, np.eye(3))
    p = x @ axes.T
    cuts = [np.quantile(p[:, j], [0.2, 0.4, 0.6, 0.8]) for j in range(3)]
    cell = cells_of(p, cuts)
    for window, probes in ((1, 5), (1, 27), (2, 40), (4, 1000)):
        probed, bound = probes_of(q @ axes.T, cuts, window, probes)
        for i in range(len(q)):
            out = ~np.isin(cell, probed[i])
            nearest = np.sqrt(((x[out] - q[i]) ** 2).sum(1)).min(initial=np.inf)
            assert nearest >= bound[i] - 1e-12


def test_equals_exact_search_with_hot_cells_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    ref = [(i, rng.normal(size=4).round(3).tolist()) for i in range(1500)]
    ref += [(1500 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(700)]  # repeated rows: one hot cell
    ref += [(3000, None)]
    asks = [(i, x) for i, x in ref if i % 20 == 0 and x is not None] + [(9000, [50.0, 50.0, 50.0, 50.0])]
    schema = "id long, features array<double>"
    train, queries = spark.createDataFrame(ref, schema), spark.createDataFrame([*asks, (9001, None)], schema)
    small = {"cell_rows": 100, "tile": 60}
    want = brute(ref, asks, 4, True)
    assert answers(indexed_search(train, queries, 4, exclude_self=True, **small)) == want
    rough = indexed_hits(train, queries, 4, exclude_self=True, exact=False, **small).collect()
    found = sum(h.neighbor_id in {i for i, _ in want[r.query_id]} for r in rough for h in r.hits)
    assert len(rough) == len(asks) and found >= 0.9 * sum(len(v) for v in want.values())
    for r in rough:
        if r.proven:
            assert [(h.neighbor_id, h.distance) for h in r.hits] == want[r.query_id]
    assert sum(r.proven for r in rough) >= 0.3 * len(rough)


def test_small_and_empty_tables(spark):
    schema = "id long, features array<double>"
    three = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1.0])], schema)
    assert answers(indexed_search(three, three, 5, exclude_self=True)) == {1: [(2, 1.0), (3, 1.0)], 2: [(3, 0.0), (1, 1.0)], 3: [(2, 0.0), (1, 1.0)]}
    none = three.where("false")
    assert indexed_search(three, none).count() == 0 and indexed_hits(none, three).where("proven and size(hits) = 0").count() == 3


def test_a_step_of_scores_stays_small():
    import tracemalloc

    from tidelab.ml.knn import _nearest, per_step

    rng = np.random.default_rng(6)
    rows = rng.normal(size=(20_000, 8))
    query, squares, ids = rng.normal(size=(2000, 8)), (rows * rows).sum(1), np.arange(20_000)
    tracemalloc.start()
    try:
        for a in range(0, 200, per_step(len(rows))):
            list(_nearest(query[a : a + per_step(len(rows))], rows, squares, ids, None, 3))
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()


def test_benchmark_neighbours_through_the_index_are_the_same(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from tidelab.ml import runner

    rng = np.random.default_rng(8)
    rows = [(i, i, Vectors.dense(x.tolist()), float(x[0] > 0)) for i, x in enumerate(rng.normal(size=(600, 3)).round(2))]
    df = spark.createDataFrame(rows, ["_key", "_rid", "features", "label"])
    train, test = df.where("_key % 4 > 0"), df.where("_key % 4 = 0")
    want = sorted(map(tuple, runner.neighbour_predictions(train, test, 5, "classification", 450 * 150).collect()))
    met = []
    monkeypatch.setattr(runner, "indexed_hits", lambda *a: met.append(1) or indexed_hits(*a))
    monkeypatch.setattr(runner, "MOST_DISTANCES", 0)
    assert sorted(map(tuple, runner.neighbour_predictions(train, test, 5, "classification", 450 * 150).collect())) == want and met


def test_rows_are_dealt_by_number_not_by_bytes(spark):
    from tidelab.ml import runner

    df = spark.range(runner.PART_ROWS * 3 + 5).coalesce(1)
    out = runner.dealt(df, df.count())
    assert out.rdd.getNumPartitions() == 4 and out.distinct().count() == runner.PART_ROWS * 3 + 5
    assert runner.dealt(df, 10) is df
