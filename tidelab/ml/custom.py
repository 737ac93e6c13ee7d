"""Estimators Spark ML lacks, written as Spark ML ``Estimator``/``Model`` subclasses so they plug
into ``Pipeline``:

* ``RandomFourierFeatures`` — approximate RBF/polynomial kernel map (Rahimi & Recht) applied per
  Arrow batch; turns kernel SVM/SVR into linear models over the mapped features.
* ``LinearSVR`` — ε-insensitive linear support-vector regression, full-batch sub-gradient descent;
  each iteration is one distributed pass (per-partition numpy partial gradients, one short vector a
  task, summed by the ``Summarizer`` aggregate), the model vector is broadcast with the closure.
* ``AdaBoostClassifier`` — SAMME over decision stumps, one distributed histogram pass per round over
  rows binned once.

Inputs too wide for what a task or the driver holds are refused with an error, never narrowed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelab.session import drop_path, materialize



#: Doubles that go with a task or come back from one (128 MB).
MOST_NUMBERS = 16 << 20


class _Setters:
    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setLabelCol(self, value):
        return self._set(labelCol=value)

    def setPredictionCol(self, value):
        return self._set(predictionCol=value)


class _RffParams(_Setters, HasFeaturesCol, HasSeed):
    outputCol = Param(Params._dummy(), "outputCol", "mapped features", TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "RBF gamma (<= 0: 1 / n_features)", TypeConverters.toFloat)


class RandomFourierFeatures(Estimator, _RffParams):
    @keyword_only
    def __init__(self, featuresCol="features", outputCol="rff", numFeatures=200, gamma=0.0, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", outputCol="rff", numFeatures=200, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RandomFourierModel":
        first = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("v")).limit(1).collect()
        d = len(first[0]["v"]) if first else 1
        gamma = self.getOrDefault(self.gamma)
        gamma = gamma if gamma > 0 else 1.0 / max(d, 1)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        D = self.getOrDefault(self.numFeatures)
        if d * D > MOST_NUMBERS:
            raise ValueError(f"{d} features x {D} random features are more than go with a task")
        W = rng.normal(0.0, math.sqrt(2 * gamma), size=(d, D))
        b = rng.uniform(0, 2 * math.pi, size=D)
        m = RandomFourierModel(W, b)
        m._set(featuresCol=self.getFeaturesCol(), outputCol=self.getOrDefault(self.outputCol))
        return m


class RandomFourierModel(Model, _RffParams):
    def __init__(self, W=None, b=None):
        super().__init__()
        self.W, self.b = W, b

    def _transform(self, dataset: DataFrame) -> DataFrame:
        W, b = self.W, self.b
        scale = math.sqrt(2.0 / W.shape[1])

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(v: pd.Series) -> pd.Series:
            X = np.stack(v.to_numpy()) if len(v) else np.zeros((0, W.shape[0]))
            Z = scale * np.cos(X @ W + b)
            return pd.Series(list(Z))

        out = self.getOrDefault(self.outputCol)
        return dataset.withColumn(out, array_to_vector(rff(vector_to_array(F.col(self.getFeaturesCol())))))


class _SvrParams(_Setters, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    C = Param(Params._dummy(), "C", "inverse regularisation", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "insensitive tube half-width", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "initial step", TypeConverters.toFloat)


class LinearSVR(Estimator, _SvrParams):
    """ε-insensitive linear SVR: minimises ½‖w‖² + C·Σ max(0, |y − w·x − b| − ε).

    Start: the ridge solution ``(XᵀX + I/C)⁻¹Xᵀy`` from one distributed pass (per-partition
    ``XᵀX``/``Xᵀy`` summed by the ``Summarizer`` aggregate — d² numbers per partition). Then
    ``maxIter`` full-batch sub-gradient passes with normalised, decaying steps; each pass also
    returns the objective, and the best iterate is kept.
    """

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, epsilon=0.1, maxIter=30, stepSize=0.1):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, epsilon=0.1, maxIter=30, stepSize=0.1)
        self._set(**self._input_kwargs)

    @staticmethod
    def _sum_arrays(df: DataFrame, fn, width: int) -> np.ndarray:
        rows = df.mapInPandas(fn, "g array<double>").select(array_to_vector("g").alias("g"))
        out = rows.agg(Summarizer.sum(F.col("g")).alias("s")).collect()[0]["s"]
        return np.zeros(width) if out is None else out.toArray()

    def _fit(self, dataset: DataFrame) -> "LinearSVRModel":
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        data = dataset.select(vector_to_array(F.col(fc)).alias("x"), F.col(lc).cast("double").alias("y")).persist()
        try:
            first = data.limit(1).collect()
            d = len(first[0]["x"]) if first else 0
            if (d + 1) ** 2 > MOST_NUMBERS:
                raise ValueError(f"{d} features: the start of the SVR needs a {d + 1} x {d + 1} matrix in each task")
            C, eps = self.getOrDefault(self.C), self.getOrDefault(self.epsilon)

            def gram(batches):
                acc = np.zeros((d + 1) * (d + 1) + (d + 1))
                for pdf in batches:
                    if not len(pdf):
                        continue
                    X = np.hstack([np.stack(pdf["x"].to_numpy()), np.ones((len(pdf), 1))])
                    y = pdf["y"].to_numpy()
                    acc[: (d + 1) ** 2] += (X.T @ X).ravel()
                    acc[(d + 1) ** 2 :] += X.T @ y
                yield pd.DataFrame({"g": [acc.tolist()]})

            acc = self._sum_arrays(data, gram, (d + 1) ** 2 + d + 1)
            A = acc[: (d + 1) ** 2].reshape(d + 1, d + 1)
            reg = np.eye(d + 1) / max(C, 1e-12)
            reg[d, d] = 1e-12  # the intercept is not penalised
            wb = np.linalg.solve(A + reg, acc[(d + 1) ** 2 :])

            def objective_and_grad(wb):
                def part(batches, wb=wb):
                    g = np.zeros(d + 2)
                    for pdf in batches:
                        if not len(pdf):
                            continue
                        X = np.stack(pdf["x"].to_numpy())
                        r = pdf["y"].to_numpy() - (X @ wb[:-1] + wb[-1])
                        s = np.where(r > eps, -1.0, np.where(r < -eps, 1.0, 0.0))
                        g[:d] += X.T @ s
                        g[d] += s.sum()
                        g[d + 1] += np.maximum(np.abs(r) - eps, 0.0).sum()
                    yield pd.DataFrame({"g": [g.tolist()]})

                out = self._sum_arrays(data, part, d + 2)
                grad = C * out[: d + 1]
                grad[:d] += wb[:d]
                return 0.5 * float(wb[:d] @ wb[:d]) + C * out[d + 1], grad

            best_obj, grad = objective_and_grad(wb)
            best = wb.copy()
            scale = self.getOrDefault(self.stepSize) * max(1.0, float(np.linalg.norm(wb)))
            for it in range(self.getOrDefault(self.maxIter)):
                norm = float(np.linalg.norm(grad))
                if norm == 0:
                    break
                wb = wb - (scale / math.sqrt(it + 1)) * grad / norm
                obj, grad = objective_and_grad(wb)
                if obj < best_obj:
                    best_obj, best = obj, wb.copy()
        finally:
            data.unpersist()
        m = LinearSVRModel(best[:-1], float(best[-1]))
        m._set(featuresCol=fc, predictionCol=self.getPredictionCol())
        return m


class LinearSVRModel(Model, _SvrParams):
    def __init__(self, w=None, b=0.0):
        super().__init__()
        self.w, self.b = w, b

    def _transform(self, dataset: DataFrame) -> DataFrame:
        coef = F.array(*[F.lit(float(v)) for v in self.w])
        x = vector_to_array(F.col(self.getFeaturesCol()))
        dot = F.aggregate(F.zip_with(x, coef, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)
        return dataset.withColumn(self.getPredictionCol(), dot + F.lit(float(self.b)))


class _AdaParams(_Setters, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numRounds = Param(Params._dummy(), "numRounds", "boosting rounds", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", TypeConverters.toFloat)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes (0: infer)", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "candidate thresholds per feature", TypeConverters.toInt)


class AdaBoostClassifier(Estimator, _AdaParams):
    """SAMME boosting of decision stumps, one distributed pass per round.

    Candidate thresholds are per-feature approximate quantiles (one ``percentile_approx`` pass). Each
    row is binned once, a byte per feature, and stored with its weight's exponent in the shared folder.
    A round reads those, adds the stumps found since the exponents were last stored (at most
    ``REFRESH``), and counts weighted class histograms per (feature, bin); the driver picks the split
    with the lowest weighted error, which is also the round's error. Every ``REFRESH`` rounds the
    exponents are stored anew, so work per round and lineage stay constant. A task sends features x
    bins x classes numbers to one final sum; more than ``MOST_CELLS`` of them is an error.
    """

    REFRESH = 10
    MOST_CELLS = 4 << 20

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", numRounds=50,
                 learningRate=1.0, numClasses=0, maxBins=32, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", numRounds=50,
                         learningRate=1.0, numClasses=0, maxBins=32, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "AdaBoostModel":
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        data = dataset.select(vector_to_array(F.col(fc)).alias("x"), F.col(lc).cast("double").alias("y"))
        first = data.limit(1).collect()
        d = len(first[0]["x"]) if first else 0
        k = self.getOrDefault(self.numClasses) or int(data.agg(F.max("y")).collect()[0][0] or 0) + 1
        k = max(k, 2)
        bins = self.getOrDefault(self.maxBins)
        probs = [i / bins for i in range(1, bins)]
        q = data.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
            F.percentile_approx("v", probs, 1000).alias("t")).collect()  # d rows of ≤ bins-1 thresholds
        thresholds = [np.array([])] * d
        for r in q:
            thresholds[r["j"]] = np.unique(np.array(r["t"], dtype=float))
        width = max((len(t) for t in thresholds), default=0) + 1
        if width > 256 or d * width * k > self.MOST_CELLS:
            raise ValueError(f"{d} features x {width} bins x {k} classes are more histogram cells than a task may hold")
        lr = self.getOrDefault(self.learningRate)

        def to_bins(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                X = np.stack(pdf["x"].to_numpy())
                B = np.column_stack([np.searchsorted(thresholds[j], X[:, j], side="left") for j in range(d)]).astype(np.uint8)
                yield pd.DataFrame({"bins": [r.tobytes() for r in B], "y": pdf["y"].astype(int), "miss": 0.0})

        def missed(pdf, recent):
            """Bins, labels and exponents with the recent stumps added."""
            B = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), d)
            y, miss = pdf["y"].to_numpy(), pdf["miss"].to_numpy(copy=True)
            for j, s, left, right, alpha in recent:
                miss += alpha * (np.where(B[:, j] <= s, left, right) != y)
            return B, y, miss

        spark = dataset.sparkSession
        binned = materialize(data.mapInPandas(to_bins, "bins binary, y long, miss double"), "boosting")
        held = binned.inputFiles()
        stumps: list = []
        recent: list = []
        offsets = np.arange(d) * width * k
        for _ in range(self.getOrDefault(self.numRounds)):
            if len(recent) == self.REFRESH:

                def refresh(batches, recent=tuple(recent)):
                    for pdf in batches:
                        if len(pdf):
                            yield pd.DataFrame({"bins": pdf["bins"], "y": pdf["y"], "miss": missed(pdf, recent)[2]})

                binned, old = materialize(binned.mapInPandas(refresh, "bins binary, y long, miss double"), "boosting"), held
                held = binned.inputFiles()
                if old:
                    drop_path(spark, old[0].rsplit("/", 1)[0])
                recent = []
            shift = sum(a for *_, a in stumps)  # largest exponent possible: weights lie in (0, 1], on one scale

            def hist(batches, recent=tuple(recent), shift=shift):
                H = np.zeros(d * width * k)
                for pdf in batches:
                    if not len(pdf):
                        continue
                    B, y, miss = missed(pdf, recent)
                    cells = offsets[None, :] + B.astype(np.int64) * k + y[:, None]
                    H += np.bincount(cells.ravel(), np.repeat(np.exp(miss - shift), d), len(H))
                yield pd.DataFrame({"g": [H.tolist()]})

            H = self._histograms(binned, hist, d, width, k)
            total = H.sum(axis=(1, 2))[0] if d else 0.0
            if total <= 0:
                break
            best = None
            for j in range(d):
                left = np.cumsum(H[j], axis=0)[:-1]  # split after bin s: bins ≤ s go left
                right = H[j].sum(axis=0)[None, :] - left
                err = total - left.max(axis=1) - right.max(axis=1)
                s = int(np.argmin(err))
                if len(thresholds[j]) and (best is None or err[s] < best[0]):
                    best = (float(err[s]), j, s, int(left[s].argmax()), int(right[s].argmax()))
            if best is None:
                break
            e = best[0] / total
            if e >= 1.0 - 1.0 / k:
                break
            alpha = lr * (math.log((1.0 - e) / max(e, 1e-12)) + math.log(k - 1))
            stumps.append((best[1], float(thresholds[best[1]][best[2]]), best[3], best[4], alpha))
            recent.append((best[1], best[2], best[3], best[4], alpha))
            if e <= 0:
                break
        model = AdaBoostModel(stumps, k)
        model._set(featuresCol=fc, predictionCol=self.getPredictionCol())
        return model

    @staticmethod
    def _histograms(data: DataFrame, fn, d: int, width: int, k: int) -> np.ndarray:
        rows = data.mapInPandas(fn, "g array<double>").select(array_to_vector("g").alias("g"))
        out = rows.agg(Summarizer.sum(F.col("g")).alias("s")).collect()[0]["s"]
        return np.zeros((d, width, k)) if out is None else out.toArray().reshape(d, width, k)


class AdaBoostModel(Model, _AdaParams):
    def __init__(self, stumps=None, k=2):
        super().__init__()
        self.stumps, self.k = stumps or [], k

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.getFeaturesCol()))
        votes = [F.lit(0.0)] * self.k
        for j, t, left, right, alpha in self.stumps:
            cls = F.when(x[j] <= F.lit(t), F.lit(left)).otherwise(F.lit(right))
            votes = [v + F.when(cls == c, F.lit(alpha)).otherwise(F.lit(0.0)) for c, v in enumerate(votes)]
        best, best_v = F.lit(0.0), votes[0]
        for c in range(1, self.k):
            best = F.when(votes[c] > best_v, F.lit(float(c))).otherwise(best)
            best_v = F.greatest(best_v, votes[c])
        return dataset.withColumn(self.getPredictionCol(), best)
