"""Support vector machines by dual coordinate ascent with a certificate.

Both problems are ``½‖w‖² + C Σ loss`` over rows with a constant 1 appended (the intercept is penalised
like any weight). A row has one dual variable, and ``w`` is the rows' sum weighted by them:

* classification (labels 0 and 1, signs −1 and 1): hinge loss; ``w = Σ a y x`` with ``0 ≤ a ≤ C``;
* regression: loss beyond ``epsilon``; ``w = Σ a x`` with ``−C ≤ a ≤ C``.

Rows are kept in blocks. In a round every block takes the common ``w``, goes through its own variables a
few times in random order, setting each to its best value, and hands back the change of ``w``. The blocks'
changes are averaged: all of them are taken by the same share, from 0 to 1, at which the dual value is highest
(it is a parabola in that share), so a round never makes it worse. The same pass gives the primal value of
the common ``w`` and the dual value; their difference, the duality gap, bounds how far the solution is from
the optimum, and rounds end once it is below ``tol`` of the primal value. A model that ran out of rounds
says so (``converged``) and has its gap.

Averaging moves each variable by one block's share, so from zero the rounds would grow with the blocks. Where there
is more than one, the first steps come from a smooth problem instead: the loss is rounded off over a width,
which makes the dual variables a function of ``w`` (``smooth_duals``), and Newton steps, one pass over all rows each
and independent of the number of blocks, find the ``w`` that its own variables add up to. The width shrinks until the
rounding costs less than half of ``tol``. These variables are taken by the same best share as any round's
change, and rounds of ascent go on from there until the gap is reached. Passes count as rounds and take at most half of
``maxIter``; rows too wide for a square matrix in a task (``WIDEST``) start from zero.

Blocks are laid out by number and cached once; only dual variables and changes of ``w`` move in a round.
Sums go through partial sums per share of the blocks, so no task adds up all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.session import drop_path, scratch_dir, ship_package

#: Doubles and rows of a block at most.
BLOCK_NUMBERS = 1 << 20
BLOCK_ROWS = 1 << 14
#: Features, the constant included, up to which Newton steps are taken: a task holds their square.
WIDEST = 512


def ascend(x: np.ndarray, y: np.ndarray, a: np.ndarray, w: np.ndarray, C: float, epsilon: float | None, epochs: int,
           rng: np.random.Generator) -> np.ndarray:
    """New dual variables after ``epochs`` passes over a block's rows; ``epsilon`` None is classification."""
    a, w = a.copy(), w.copy()
    square = (x * x).sum(1).tolist()
    y = y.tolist()
    for _ in range(epochs):
        for i in rng.permutation(len(x)).tolist():
            row, old = x[i], float(a[i])
            margin = float(row @ w)
            if epsilon is None:
                new = min(max(old - (y[i] * margin - 1.0) / square[i], 0.0), C)
                step = (new - old) * y[i]
            else:
                u = old - (margin - y[i]) / square[i]
                off = epsilon / square[i]
                new = min(max(u - off, 0.0), C) if u > 0 else max(min(u + off, 0.0), -C)
                step = new - old
            if step:
                w += step * row
                a[i] = new
    return a


def linear_part(y: np.ndarray, a: np.ndarray, epsilon: float | None) -> float:
    """The dual value without ``-½‖w‖²``."""
    return float(a.sum()) if epsilon is None else float((y * a).sum() - epsilon * np.abs(a).sum())


def losses(x: np.ndarray, y: np.ndarray, w: np.ndarray, C: float, epsilon: float | None) -> float:
    """A block's part of the primal value."""
    margin = x @ w
    return float(C * (np.maximum(0.0, 1.0 - y * margin) if epsilon is None else np.maximum(0.0, np.abs(y - margin) - epsilon)).sum())


def smooth_duals(margin: np.ndarray, y: np.ndarray, C: float, epsilon: float | None, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Dual variables that belong to margins when the loss is rounded off over ``width``, and each row's
    distance into the loss (below 0: no loss)."""
    depth = 1.0 - y * margin if epsilon is None else np.abs(y - margin) - epsilon
    a = C * np.clip(depth / width, 0.0, 1.0)
    return (a if epsilon is None else a * np.sign(y - margin)), depth


def smooth_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, C: float, epsilon: float | None, width: float) -> np.ndarray:
    """A block's part of: loss, rounded loss, dual terms' gap, row lengths, ``w`` as the variables make it up, the same of
    the rows in the rounded part alone, and the curvature of the rounded loss."""
    a, depth = smooth_duals(x @ w, y, C, epsilon, width)
    size, over = np.abs(a), np.maximum(depth, 0.0)
    at = (depth >= 0.0) & (depth <= width)
    near, weight = x[at], a * (y if epsilon is None else 1.0)
    rounded = size * over - 0.5 * width * size * size / C if C > 0 else np.zeros(len(y))
    return np.concatenate([
        [C * over.sum(), rounded.sum(), ((C - size) * over).sum(), np.sqrt((x * x).sum(1)).sum()],
        x.T @ weight, near.T @ weight[at], (C / width * (near.T @ near)).ravel(),
    ])


class _DualParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    C = Param(Params._dummy(), "C", "weight of the losses", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "insensitive tube half-width", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "duality gap to reach, as a share of the primal value", TypeConverters.toFloat)
    epochs = Param(Params._dummy(), "epochs", "passes over a block's rows in a round", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "order of the rows", TypeConverters.toInt)

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)


class _DualMachine(Estimator, _DualParams):
    """``keyCol``: a long column that names rows in the model's ``duals`` (optional). Rows without features
    or label take no part; an empty input gives weights of zero."""

    regression = False

    def _fit(self, dataset: DataFrame) -> "DualModel":
        spark = dataset.sparkSession
        ship_package(spark)
        get, fc, key = self.getOrDefault, self.getFeaturesCol(), self.keyCol
        C, epsilon = get(self.C), get(self.epsilon) if self.regression else None
        signed = F.col(self.getLabelCol()).cast("double") if self.regression else F.when(F.col(self.getLabelCol()) > 0, 1.0).otherwise(-1.0)
        data = dataset.where(F.col(self.getLabelCol()).isNotNull() & F.col(fc).isNotNull()).select(
            vector_to_array(F.col(fc)).alias("x"), signed.alias("y"), (F.col(key) if key else F.lit(0)).cast("long").alias("key")
        )
        first = data.select(F.size("x").alias("d")).first()
        d = (first["d"] if first else 0) + 1
        rows = max(64, min(BLOCK_ROWS, BLOCK_NUMBERS // d))

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held, n = TaskContext.get().partitionId() << 32, [], 0
            def put(table: pa.Table) -> pa.RecordBatch:
                x = np.ones((len(table), d))
                x[:, :-1] = table.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)
                parts = [x.tobytes(), table.column(1).to_numpy().tobytes(), table.column(2).to_numpy().tobytes()]
                return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], ["block", "x", "y", "key"])
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                while n >= rows:
                    table = pa.Table.from_batches(held)
                    yield put(table.slice(0, rows))
                    held, n, number = table.slice(rows).to_batches(), n - rows, number + 1
            if n:
                yield put(pa.Table.from_batches(held))

        blocks, home = _store(data.mapInArrow(lay, "block long, x binary, y binary, key binary"))
        slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
        laid = blocks.repartition(slots, "block").persist(StorageLevel.MEMORY_AND_DISK)
        duals = path = None
        try:
            n = laid.count()
            w, rounds, gap, primal, taken = np.zeros(d), 0, 0.0, 0.0, 0.0
            start, passes = self._start(laid, d, C, epsilon) if n > 1 and d <= WIDEST else (None, 0)  # n: blocks
            while n:
                begin = start if duals is None else None
                out, new = _store(self._round(laid, duals, taken, w, d, C, epsilon, passes + rounds, begin))
                got = _sums(out)
                square, change = float(w @ w), got["change"].toArray()
                primal, gap = 0.5 * square + got["loss"], square + got["loss"] - got["dual"]  # before this round's steps
                if gap <= get(self.tol) * max(primal, 1e-12) or passes + rounds >= get(self.maxIter):
                    taken = 0.0
                    keep = new
                else:
                    taken = float(np.clip((got["dual_new"] - got["dual"] - w @ change) / max(float(change @ change), 1e-300), 0.0, 1.0))
                    w, keep, rounds = w + taken * change, new, rounds + 1
                if path:
                    drop_path(spark, path)
                duals, path = out.select("block", "a", "new"), keep
                if taken == 0.0:
                    break
        finally:
            laid.unpersist()
        if not key:
            for p in (home, path):
                if p:
                    drop_path(spark, p)
        model = DualModel(w, {"rounds": passes + rounds, "gap": gap, "primal": primal, "converged": gap <= get(self.tol) * max(primal, 1e-12)}, self.regression)
        model.duals = _dual_rows(blocks, duals, w, d) if key and n else None
        model._set(featuresCol=fc, predictionCol=self.getPredictionCol())
        return model

    def _start(self, laid: DataFrame, d: int, C: float, epsilon: float | None) -> tuple[tuple[np.ndarray, float] | None, int]:
        """Weights and width of a smooth problem near this one, solved, and the passes it took; None without any."""
        tol, most = self.getOrDefault(self.tol), self.getOrDefault(self.maxIter) // 2
        if not most or C <= 0:
            return None, 0

        def look(w: np.ndarray, width: float):
            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(4 + 2 * d + d * d)
                for batch in batches:
                    for i in range(batch.num_rows):
                        x, y = (np.frombuffer(c[i].as_py()) for c in batch.columns)
                        total += smooth_sums(x.reshape(-1, d), y, w, C, epsilon, width)
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

            sums = laid.select("x", "y").mapInArrow(part, "sums array<double>").agg(Summarizer.sum(array_to_vector("sums")).alias("s")).first()["s"].toArray()
            loss, rounded, between, lengths = sums[:4]
            half = 0.5 * float(w @ w)
            return half + loss, half + rounded, between, lengths, w - sums[4 : 4 + d], sums[4 + d : 4 + 2 * d], sums[4 + 2 * d :].reshape(d, d) + np.eye(d)

        w, width, passes, step, best = np.zeros(d), 1.0, 1, None, None
        now = look(w, width)
        if epsilon is not None and now[0] > 0:  # of classification every loss is 1 at the start
            count = float(laid.select((F.length("y") / 8).alias("n")).agg(F.sum("n")).first()[0])
            width, passes = now[0] / (C * count), 2
            now = look(w, width)
        while passes < most:
            primal, value, between, lengths, slope, inner, curve = now
            settled = C * lengths * float(np.sqrt(slope @ slope)) <= 0.1 * tol * primal
            if settled:
                best = (w, width)
                if between <= 0.5 * tol * primal:
                    break
                # Where the same rows stay in the rounded part, w moves with the width along a straight line.
                smaller = width * min(0.5, max(0.05, float(np.sqrt(0.4 * tol * primal / between))))
                w, width = w + (width - smaller) / width * np.linalg.solve(curve, inner), smaller
                now, passes, step = look(w, width), passes + 1, None
                continue
            move = -np.linalg.solve(curve, slope)
            step = 1.0 if step is None else step
            there, passes = look(w + step * move, width), passes + 1
            if there[1] <= value + 1e-4 * step * float(slope @ move) + 1e-12 * abs(value):
                w, now, step = w + step * move, there, None
            else:
                step *= 0.4
        return best or (w, width), passes

    def _round(self, laid: DataFrame, duals: DataFrame | None, taken: float, w: np.ndarray, d: int, C: float, epsilon: float | None, rounds: int,
               begin: tuple[np.ndarray, float] | None = None) -> DataFrame:
        epochs, seed = self.getOrDefault(self.epochs), self.getOrDefault(self.seed)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block, x, y, a, new = (c[i].as_py() for c in batch.columns)
                    x, y = np.frombuffer(x).reshape(-1, d), np.frombuffer(y)
                    a = np.frombuffer(a) + taken * (np.frombuffer(new) - np.frombuffer(a)) if a else np.zeros(len(y))
                    if begin is None:
                        new = ascend(x, y, a, w, C, epsilon, epochs, np.random.default_rng([seed, rounds, block]))
                    else:
                        new = smooth_duals(x @ begin[0], y, C, epsilon, begin[1])[0]
                    change = x.T @ ((new - a) * (y if epsilon is None else 1.0))
                    numbers = (losses(x, y, w, C, epsilon), linear_part(y, a, epsilon), linear_part(y, new, epsilon))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.array([a.tobytes()], pa.binary()), pa.array([new.tobytes()], pa.binary()),
                         pa.array([change.tolist()], pa.list_(pa.float64())), *(pa.array([v]) for v in numbers)],
                        ["block", "a", "new", "change", "loss", "dual", "dual_new"],
                    )

        rows = laid.select("block", "x", "y")
        if duals is None:
            rows = rows.select("*", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("new"))
        else:
            rows = rows.join(duals, "block")
        return rows.mapInArrow(step, "block long, a binary, new binary, change array<double>, loss double, dual double, dual_new double")


def _store(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_dir(df.sparkSession, "dual")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _sums(out: DataFrame):
    """Sums over the blocks by way of 64 shares."""
    numbers = ("loss", "dual", "dual_new")
    parts = out.groupBy(F.pmod(F.hash("block"), F.lit(64))).agg(
        Summarizer.sum(array_to_vector("change")).alias("change"), *(F.sum(c).alias(c) for c in numbers)
    )
    return parts.agg(Summarizer.sum(F.col("change")).alias("change"), *(F.sum(c).alias(c) for c in numbers)).first()


def _dual_rows(blocks: DataFrame, duals: DataFrame, w: np.ndarray, d: int) -> DataFrame:
    """``(key, y, a, margin)`` of every row, margin under the final weights."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, key, a = (c[i].as_py() for c in batch.columns)
                y = np.frombuffer(y)
                a = np.frombuffer(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(key, np.int64)), pa.array(y), pa.array(a), pa.array(np.frombuffer(x).reshape(-1, d) @ w)],
                    ["key", "y", "a", "margin"],
                )

    return blocks.join(duals, "block").select("x", "y", "key", "a").mapInArrow(unfold, "key long, y double, a double, margin double")


class DualSVC(_DualMachine):
    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, maxIter=100, tol=1e-3, epochs=3, seed=42, keyCol=None):
        kwargs = dict(self._input_kwargs)
        super().__init__()
        self.keyCol = kwargs.pop("keyCol", None)
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, epsilon=0.0, maxIter=100, tol=1e-3, epochs=3, seed=42)
        self._set(**kwargs)


class DualSVR(_DualMachine):
    regression = True

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, epsilon=0.1, maxIter=100, tol=1e-3, epochs=3, seed=42, keyCol=None):
        kwargs = dict(self._input_kwargs)
        super().__init__()
        self.keyCol = kwargs.pop("keyCol", None)
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, epsilon=0.1, maxIter=100, tol=1e-3, epochs=3, seed=42)
        self._set(**kwargs)


class DualModel(Model, _DualParams):
    """``facts``: rounds, duality gap, primal value, whether the gap was reached; ``duals``: ``(key, y, a, margin)``
    where a key column was named."""

    def __init__(self, weights=None, facts=None, regression=False):
        super().__init__()
        self.weights, self.facts, self.regression, self.duals = weights, facts or {}, regression, None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        coef = F.array(*[F.lit(float(v)) for v in self.weights[:-1]]) if len(self.weights) > 1 else F.expr("cast(array() as array<double>)")
        x = vector_to_array(F.col(self.getFeaturesCol()))
        dot = F.aggregate(F.zip_with(x, coef, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v) + F.lit(float(self.weights[-1]))
        if self.regression:
            return dataset.withColumn(self.getPredictionCol(), dot)
        out = dataset.withColumn("rawPrediction", array_to_vector(F.array(-dot, dot)))
        return out.withColumn(self.getPredictionCol(), F.when(vector_to_array("rawPrediction")[1] > 0, 1.0).otherwise(0.0))
