"""Second-order gradient boosting.

Trees are grown level by level on histograms of gradients and Hessians over binned rows:

* Rows are binned once (a byte a feature, 255 for missing) and stored with their margins. A level is one
  pass: each task sums gradient and Hessian by (class, node, feature, bin); Spark adds the tasks' sums
  per (class, node, run of features), and the same task picks that cell's best split, so neither a
  final sum nor the driver ever sees a histogram. The driver gets one candidate a cell.
* A split's gain is ``(GL²/(HL+λ) + GR²/(HR+λ) − G²/(H+λ)) / 2 − γ``; both sides need ``min_child_weight`` of
  Hessian. Rows without a value go to the side that gains more, found per split; without
  such rows the side is right.
* A leaf's value is ``−η G/(H+λ)``. Ties go to the smaller feature, then the smaller threshold, then
  missing to the left.
* Losses: ``logistic`` (two classes), ``softmax`` (a tree a class and round, all classes in one pass) and
  ``squared``. Margins start at 0 (``squared``: at the mean).

Margins are stored anew every ``REFRESH`` rounds; between them a pass adds the trees grown since, so
work a round and lineage stay constant. Candidate thresholds are approximate quantiles, or given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelab.session import drop_path, scratch_dir, ship_package

MISSING = 255
#: Bins in a run of features whose sums travel together.
RUN_BINS = 1 << 14
_BEST = (
    "tree int, node int, feature int, gain double, bin int, missing_left boolean, gl double, hl double, gr double, hr double"
)


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of ``n`` are ``2n`` (left) and ``2n + 1``."""

    splits: dict[int, tuple] = field(default_factory=dict)  # node: (feature, bin, missing left, threshold, gain)
    leaves: dict[int, float] = field(default_factory=dict)
    sums: dict[int, tuple[float, float]] = field(default_factory=dict)  # node: (G, H)

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row after at most ``levels`` splits."""
        at = np.ones(len(bins), np.int64)
        step = 0
        while levels is None or step < levels:
            moved = False
            for node in np.unique(at).tolist():
                if node in self.splits and node.bit_length() == step + 1:
                    j, b, missing_left, *_ = self.splits[node]
                    rows = np.flatnonzero(at == node)
                    v = bins[rows, j]
                    left = np.where(v == MISSING, missing_left, v <= b)
                    at[rows] = 2 * node + ~left
                    moved = True
            if not moved:
                break
            step += 1
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(1 + max(self.leaves, default=1))
        for node, v in self.leaves.items():
            out[node] = v
        return out[self.nodes(bins)] if self.leaves else np.zeros(len(bins))


def gradients(loss: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian per row and tree of a round; ``margin`` has a column a tree."""
    if loss == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y[:, None], p * (1 - p)
    e = np.exp(margin - margin.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (y[:, None] == np.arange(margin.shape[1])), p * (1 - p)


def to_bins(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many thresholds lie below it; a value on a threshold goes left."""
    out = np.empty(x.shape, np.uint8)
    for j, t in enumerate(thresholds):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(t, x[:, j], side="left"))
    return out


def best_split(g: np.ndarray, h: np.ndarray, reg: float, gamma: float, least: float) -> tuple | None:
    """Best split of one feature's histogram (last entry: missing): ``(gain, bin, missing left, GL, HL, GR,
    HR)``, or None without an allowed split."""
    total_g, total_h = g.sum(), h.sum()
    parent = total_g * total_g / (total_h + reg)
    best = None
    gl, hl = np.cumsum(g[:-1])[:-1], np.cumsum(h[:-1])[:-1]
    for missing_left in ((True, False) if h[-1] > 0 else (False,)):
        left_g, left_h = (gl + g[-1], hl + h[-1]) if missing_left else (gl, hl)
        right_g, right_h = total_g - left_g, total_h - left_h
        allowed = (left_h >= least) & (right_h >= least) & (left_h > 0) & (right_h > 0)
        if not allowed.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 0.5 * (left_g * left_g / (left_h + reg) + right_g * right_g / (right_h + reg) - parent) - gamma
        gain = np.where(allowed, gain, -np.inf)
        b = int(np.argmax(gain))
        if best is None or (gain[b], -b) > (best[0], -best[1]):
            best = (float(gain[b]), b, missing_left, float(left_g[b]), float(left_h[b]), float(right_g[b]), float(right_h[b]))
    return best


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    loss = Param(Params._dummy(), "loss", "logistic, softmax or squared", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty of leaf values", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain of a split", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least Hessian of a child", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins a feature", TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "classes of softmax", TypeConverters.toInt)


class SecondOrderBoosting(Estimator, _BoostParams):
    """Boosted trees over ``featuresCol`` (a vector, or an array of doubles where null and NaN are missing).

    ``thresholds``: ascending candidate thresholds per feature, at most 254 each; without them, approximate
    quantiles (``maxBins`` bins). A row without features counts as all missing; rows without a label
    take no part. An empty input gives a model without trees."""

    REFRESH = 8

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", loss="logistic", rounds=100,
                 learningRate=0.1, maxDepth=6, regLambda=1.0, gamma=0.0, minChildWeight=1.0, maxBins=64, numClasses=2, thresholds=None):
        kwargs = dict(self._input_kwargs)
        super().__init__()
        self.thresholds = kwargs.pop("thresholds", None)
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", loss="logistic", rounds=100, learningRate=0.1,
                         maxDepth=6, regLambda=1.0, gamma=0.0, minChildWeight=1.0, maxBins=64, numClasses=2)
        self._set(**kwargs)

    def _fit(self, dataset: DataFrame) -> "SecondOrderBoostingModel":
        spark = dataset.sparkSession
        ship_package(spark)
        get = self.getOrDefault
        loss, trees = get(self.loss), get(self.numClasses) if get(self.loss) == "softmax" else 1
        if not 2 <= get(self.maxBins) <= 255 or any(len(t) > 254 for t in self.thresholds or []):
            raise ValueError("a feature has 2 to 255 bins")
        data = dataset.select(_as_doubles(dataset, self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).where("y is not null")
        d, start = _shape(data, loss)
        thresholds = [np.asarray(t, float) for t in self.thresholds] if self.thresholds else _quantiles(data, d, get(self.maxBins))
        if len(thresholds) != d:
            raise ValueError(f"{len(thresholds)} lists of thresholds for {d} features")
        rounds: list[list[Tree]] = []
        rows, path = self._bin(data, d, thresholds, start, trees)
        fresh = 0  # rounds that the stored margins hold
        for _ in range(get(self.rounds)):
            if len(rounds) - fresh == self.REFRESH:
                rows, new = self._refresh(rows, d, trees, rounds[fresh:])
                drop_path(spark, path)
                path, fresh = new, len(rounds)
            grown = self._grow(rows, d, trees, loss, rounds[fresh:], thresholds)
            if not any(t.splits for t in grown):
                break
            rounds.append(grown)
        drop_path(spark, path)
        model = SecondOrderBoostingModel(thresholds, rounds, start, loss)
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return model

    def _bin(self, data: DataFrame, d: int, thresholds: list, start: float, trees: int) -> tuple[DataFrame, str]:
        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = to_bins(_matrix(batch.column(0), d), thresholds)
                margin = np.full((batch.num_rows, trees), start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in bins], pa.binary()), batch.column(1), pa.array([r.tobytes() for r in margin], pa.binary())],
                    ["bins", "y", "margin"],
                )

        return _store(data.mapInArrow(put, "bins binary, y double, margin binary"))

    def _refresh(self, rows: DataFrame, d: int, trees: int, recent: list[list[Tree]]) -> tuple[DataFrame, str]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    _, _, margin = _unpack(batch, d, trees, recent)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in margin], pa.binary())], ["bins", "y", "margin"]
                    )

        return _store(rows.mapInArrow(add, "bins binary, y double, margin binary"))

    def _grow(self, rows: DataFrame, d: int, trees: int, loss: str, recent: list[list[Tree]], thresholds: list) -> list[Tree]:
        get = self.getOrDefault
        reg, gamma, least, eta = get(self.regLambda), get(self.gamma), get(self.minChildWeight), get(self.learningRate)
        widths = [len(t) + 2 for t in thresholds]  # bins, then missing
        offsets = np.concatenate([[0], np.cumsum(widths)]).astype(int).tolist()
        runs = [0]  # first features of the runs
        for j in range(d):
            if j > runs[-1] and offsets[j + 1] - offsets[runs[-1]] > RUN_BINS:
                runs.append(j)
        runs.append(d)
        names = [c.split(" ")[0] for c in _BEST.split(", ")]
        grown = [Tree() for _ in range(trees)]
        growing = {(k, 1) for k in range(trees)}
        for level in range(get(self.maxDepth)):

            def sums(batches: Iterator[pa.RecordBatch], level=level, grown=grown, growing=growing) -> Iterator[pa.RecordBatch]:
                held: dict[tuple, np.ndarray] = {}
                first = np.array(offsets[:-1])
                missing = np.array(widths) - 1
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    bins, y, margin = _unpack(batch, d, trees, recent)
                    g, h = gradients(loss, margin, y)
                    place = first + np.where(bins == MISSING, missing, bins)
                    for k, tree in enumerate(grown):
                        at = tree.nodes(bins, level)
                        for node in np.unique(at).tolist():
                            if (k, node) in growing:
                                mine = np.flatnonzero(at == node)
                                cells = place[mine].ravel()
                                both = held.setdefault((k, node), np.zeros((2, offsets[-1])))
                                both[0] += np.bincount(cells, np.repeat(g[mine, k], d), offsets[-1])
                                both[1] += np.bincount(cells, np.repeat(h[mine, k], d), offsets[-1])
                keys = [(k, node, r) for k, node in held for r in range(len(runs) - 1)]
                cut = [held[k, node][:, offsets[runs[r]] : offsets[runs[r + 1]]] for k, node, r in keys]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([key[i] for key in keys], pa.int32()) for i in range(3)), pa.array([c.tobytes() for c in cut], pa.binary())],
                    ["tree", "node", "run", "sums"],
                )

            def pick(parts: pa.Table) -> pa.Table:
                tree, node, run = (parts.column(c)[0].as_py() for c in ("tree", "node", "run"))
                both = np.sum([np.frombuffer(b, float).reshape(2, -1) for b in parts.column("sums").to_pylist()], axis=0)
                best = None
                for j in range(runs[run], runs[run + 1]):
                    g, h = both[:, offsets[j] - offsets[runs[run]] : offsets[j + 1] - offsets[runs[run]]]
                    found = best_split(g, h, reg, gamma, least) or (-math.inf, 0, False, float(g.sum()), float(h.sum()), 0.0, 0.0)
                    if best is None or found[0] > best[1]:
                        best = (j, *found)
                kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.bool_()] + [pa.float64()] * 4
                return pa.table([pa.array([v], k) for v, k in zip((tree, node, *best), kinds, strict=True)], names)

            found = (
                rows.mapInArrow(sums, "tree int, node int, run int, sums binary")
                .groupBy("tree", "node", "run").applyInArrow(pick, _BEST).collect()
            )
            best: dict[tuple, tuple] = {}
            for r in found:
                key = (r["tree"], r["node"])
                grown[key[0]].sums[key[1]] = (r["gl"] + r["gr"], r["hl"] + r["hr"])
                if r["gain"] > 0 and (key not in best or (r["gain"], -r["feature"]) > (best[key]["gain"], -best[key]["feature"])):
                    best[key] = r
            growing = set()
            for (k, node), r in best.items():
                grown[k].splits[node] = (r["feature"], r["bin"], r["missing_left"], float(thresholds[r["feature"]][r["bin"]]), r["gain"])
                for child, (g, h) in ((2 * node, (r["gl"], r["hl"])), (2 * node + 1, (r["gr"], r["hr"]))):
                    grown[k].sums[child] = (g, h)
                    growing.add((k, child))
            if not growing:
                break
        for tree in grown:
            for node, (g, h) in tree.sums.items():
                if node not in tree.splits:
                    tree.leaves[node] = -eta * g / (h + reg)
        return grown


def _as_doubles(df: DataFrame, column: str):
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(column).cast("array<double>")
    return vector_to_array(F.col(column))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of ``d`` values, NaN for missing ones."""
    out = np.full((len(column), d), np.nan)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    out[there] = flat.reshape(-1, d)
    return out


def _unpack(batch: pa.RecordBatch, d: int, trees: int, recent: list[list[Tree]]):
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, d)
    margin = np.frombuffer(b"".join(batch.column(2).to_pylist()), float).reshape(-1, trees).copy()
    for grown in recent:
        for k, tree in enumerate(grown):
            margin[:, k] += tree.values(bins)
    return bins, batch.column(1).to_numpy(), margin


def _store(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_dir(df.sparkSession, "boosting")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _shape(data: DataFrame, loss: str) -> tuple[int, float]:
    row = data.agg(F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("least"), F.avg("y").alias("mean")).first()
    d = max(row["d"] or 0, 0)
    if row["d"] is not None and row["least"] not in (d, -1, None):
        raise ValueError(f"rows with {row['least']} and with {d} features")
    return d, float(row["mean"] or 0.0) if loss == "squared" else 0.0


def _quantiles(data: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature's values; the largest value is no threshold."""
    shares = [i / bins for i in range(1, bins)]
    got = data.select(F.posexplode("x").alias("j", "v")).where("v is not null and not isnan(v)").groupBy("j").agg(
        F.percentile_approx("v", shares, 10_000).alias("t"), F.max("v").alias("top")
    ).collect()
    out = [np.zeros(0)] * d
    for r in got:
        t = np.unique(np.array(r["t"], float))
        out[r["j"]] = t[t < r["top"]]
    return out


class SecondOrderBoostingModel(Model, _BoostParams):
    """Adds ``rawPrediction`` (margins), ``probability`` (classes) and the prediction."""

    def __init__(self, thresholds=None, rounds=None, start=0.0, loss="logistic"):
        super().__init__()
        self.thresholds, self.rounds, self.start, self.loss = thresholds or [], rounds or [], start, loss

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.thresholds)
        trees = len(self.rounds[0]) if self.rounds else 1
        out = np.full((len(x), trees), self.start)
        for grown in self.rounds:
            for k, tree in enumerate(grown):
                out[:, k] += tree.values(bins)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        d, margins, loss = len(self.thresholds), self.margins, self.loss

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def margin(v: pd.Series) -> pd.Series:
            return pd.Series(list(margins(_matrix(pa.array(v, pa.list_(pa.float64())), d))))

        raw = margin(_as_doubles(dataset, self.getFeaturesCol()))
        if loss == "squared":
            return dataset.withColumn(self.getPredictionCol(), raw[0])
        out = dataset.withColumn("_margin", raw)
        if loss == "logistic":
            p = 1 / (1 + F.exp(-F.col("_margin")[0]))
            out = out.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin")[0], F.col("_margin")[0])))
            out = out.withColumn("probability", array_to_vector(F.array(1 - p, p)))
            return out.withColumn(self.getPredictionCol(), F.when(F.col("_margin")[0] > 0, 1.0).otherwise(0.0)).drop("_margin")
        top = F.array_max("_margin")
        e = F.transform("_margin", lambda m: F.exp(m - top))
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("rawPrediction", array_to_vector("_margin")).withColumn("probability", array_to_vector(F.transform(e, lambda v: v / total)))
        return out.withColumn(self.getPredictionCol(), (F.array_position("_margin", top) - 1).cast("double")).drop("_margin")

    def tree_rows(self, spark) -> DataFrame:
        """``(round, tree, node, feature, threshold, missing_left, gain, g, h, leaf)`` of every node."""
        rows = []
        for r, grown in enumerate(self.rounds):
            for k, tree in enumerate(grown):
                for node, (g, h) in sorted(tree.sums.items()):
                    j, _, left, t, gain = tree.splits.get(node, (None,) * 5)
                    rows.append((r, k, node, j, t, left, gain, g, h, tree.leaves.get(node)))
        return spark.createDataFrame(
            rows, "round int, tree int, node int, feature int, threshold double, missing_left boolean, gain double, g double, h double, leaf double"
        )
