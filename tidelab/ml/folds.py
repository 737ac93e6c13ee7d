"""Cross-validation of the linear regressions (G30 with G1-G3) from sums that add up over folds.

One pass takes, per fold, the products of all pairs of columns: a constant, each numeric feature with
missing cells as 0, its missing mark, each level of each categorical feature, the target. Numeric
columns are shifted by a mean of some rows, which keeps the products small and changes no result; where
there are categorical features, two aggregates before find their levels. The sums of a fold's training rows are the total less the fold's own, and everything a fit
needs follows from them: a mean-imputed column is its values plus the mean times its mark, its
deviation scales it, and the levels that the training rows hold, but the first in order, are its one-hot
columns. So every fold and every penalty is fitted and scored without a further pass over the data, and
equals the fit on that fold's rows prepared as ``ml/features.py`` does.

Tasks hand over one matrix a fold; matrices are added 32 at a time in a tree, so no task or driver holds
one for every task. More than ``MOST_COLUMNS`` columns are an error: a matrix then no longer is a small
row, and ``runner.cross_validate`` does the job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.functions.hashing import md5_key
from tidelab.ml.features import _cat, _num, split_features
from tidelab.session import ship_package

MOST_COLUMNS = 512
_FAN = 32
_CHUNK = 4096  # rows turned into a dense block at a time


def _pilot(df: DataFrame, columns: list[str]) -> list[float]:
    """A value near each numeric column's values: the mean over some rows, 0 without any."""
    if not columns:
        return []
    row = df.select(*[F.col(f"`{c}`") for c in columns]).limit(1000).agg(*[F.avg(f"`{c}`").alias(c) for c in columns]).first()
    return [float(v) if v is not None and np.isfinite(v) else 0.0 for v in row]


def fold_products(rows: DataFrame, numeric: int, pilots: list[float], levels: list[list[str]]) -> dict[int, np.ndarray]:
    """``fold -> matrix`` of summed products over ``rows(_fold, n0.., c0.., _y)``; the columns of the
    matrix are the constant, the numeric values, their missing marks, the levels and the target."""
    ship_package(rows.sparkSession)
    width = 2 + 2 * numeric + sum(map(len, levels))
    if width > MOST_COLUMNS:
        raise ValueError(f"{width} columns are more than the {MOST_COLUMNS} that fold statistics hold; use cross_validate")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        sets = [pa.array(lv, pa.string()) for lv in levels]
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                block = np.zeros((part.num_rows, width))
                block[:, 0] = 1
                for j in range(numeric):
                    v = part.column(1 + j).to_numpy(zero_copy_only=False).astype(float)
                    missing = ~np.isfinite(v)
                    block[:, 1 + j] = np.where(missing, 0.0, v - pilots[j])
                    block[:, 1 + numeric + j] = missing
                first = 1 + 2 * numeric
                for j, known in enumerate(sets):
                    place = pc.index_in(part.column(1 + numeric + j), value_set=known).to_numpy(zero_copy_only=False).astype(float)
                    seen = np.flatnonzero(~np.isnan(place))
                    block[seen, first + place[seen].astype(int)] = 1
                    first += len(known)
                block[:, -1] = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False) - pilots[-1]
                folds = part.column(0).to_numpy(zero_copy_only=False)
                for fold in np.unique(folds):
                    mine = block[folds == fold]
                    sums[int(fold)] = sums.get(int(fold), 0) + mine.T @ mine
        task = TaskContext.get().partitionId()
        for fold, matrix in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold], pa.int32()), pa.array([task], pa.int32()), pa.array([matrix.tobytes()], pa.binary())],
                ["fold", "part", "sums"],
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width * width)
        for raw in pdf["sums"]:
            total += np.frombuffer(raw)
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "part": [pdf["part"].iloc[0]], "sums": [total.tobytes()]})

    schema = "fold int, part int, sums binary"
    sums = rows.mapInArrow(products, schema)
    for _ in range(3):
        sums = sums.withColumn("part", F.floor(F.col("part") / _FAN).cast("int")).groupBy("fold", "part").applyInPandas(add, schema)
    out: dict[int, np.ndarray] = {}
    for r in sums.select("fold", "sums").collect():
        out[r["fold"]] = out.get(r["fold"], 0) + np.frombuffer(r["sums"]).reshape(width, width)
    return out


def _prepared(train: np.ndarray, numeric: int, levels: list[list[str]]) -> np.ndarray:
    """``T``: the features as linear combinations of the matrix's columns, as the training rows' sums
    give them; a feature is a column of ``T`` and has mean 0 over the training rows."""
    width, n = len(train), train[0, 0]
    cols = []
    for j in range(numeric):
        value, mark = 1 + j, 1 + numeric + j
        t = np.zeros(width)
        known = n - train[0, mark]
        mean = train[0, value] / known if known else 0.0
        t[value], t[mark], t[0] = 1.0, mean, -mean
        scatter = t @ train @ t
        spread = np.sqrt(max(scatter, 0.0) / (n - 1)) if n > 1 else 0.0
        small = 1e-12 * np.sqrt(max(train[value, value], 0.0) / n) if n else 0.0
        cols.append(t / spread if spread > small else np.zeros(width))
    first = 1 + 2 * numeric
    for known in levels:
        held = [first + i for i in range(len(known)) if train[0, first + i] > 0]
        for c in held[1:]:
            t = np.zeros(width)
            t[c], t[0] = 1.0, -train[0, c] / n
            cols.append(t)
        first += len(known)
    return np.array(cols).T if cols else np.zeros((width, 0))


def lasso_from_products(gram: np.ndarray, cross: np.ndarray, penalty: float, tol: float = 1e-12, sweeps: int = 100_000) -> np.ndarray:
    """``argmin w'Gw / 2 - c'w + penalty |w|_1`` by coordinate descent; raises where it does not settle."""
    w, left = np.zeros(len(cross)), cross.astype(float).copy()
    size = np.diag(gram)
    bar = tol * max(np.abs(cross).max(initial=0.0), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(size > 0):
            rho = left[j] + size[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - penalty, 0.0) / size[j]
            if new != w[j]:
                left -= gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * size[j])
                w[j] = new
        if moved <= bar:
            return w
    raise ArithmeticError("the lasso's coordinate descent did not settle")


def _fit(model: str, alpha: float, gram: np.ndarray, cross: np.ndarray, n: float) -> np.ndarray:
    if model == "Lasso" and alpha > 0:
        return lasso_from_products(gram / n, cross / n, alpha)
    if model == "Ridge" and alpha > 0:
        return np.linalg.solve(gram + alpha * np.eye(len(cross)), cross)
    return np.linalg.lstsq(gram, cross, rcond=1e-12)[0]


def cross_validate_linear(
    df: DataFrame, target: str, model: str = "Ridge", alphas: list[float] | None = None, folds: int = 3,
    features: list[str] | None = None, seed: int = 42, key: str | None = None, max_levels: int = MOST_COLUMNS,
) -> DataFrame:
    """``(fold, alpha, n_train, n_test, mse, rmse, r2)`` for every fold and penalty, and per penalty the
    means over folds as ``fold = -1``. ``model`` is Linear Regression, Ridge or Lasso; folds are dealt as
    in ``runner.cross_validate``. Absolute errors do not follow from the sums and are not given.

    Rows without a finite target are left out; a missing cell (null, NaN or infinite) takes the training
    mean, a missing category is a level. Rows with a null key are of fold 0. A fold without test or training rows has null scores, as has ``r2`` where the
    test targets are all alike. Repeated rows count each; an empty table gives the folds with zeros."""
    from tidelab.ml.runner import content_key

    if model not in ("Linear Regression", "Ridge", "Lasso"):
        raise ValueError(f"{model!r} does not follow from sums; use cross_validate")
    alphas = [0.0] if model == "Linear Regression" else [float(a) for a in (alphas or [1.0])]
    if any(a < 0 for a in alphas):
        raise ValueError("a penalty is 0 or more")
    features = features or [c for c in df.columns if c not in (target, key)]
    labelled = df.where(F.col(f"`{target}`").isNotNull())
    num, cat = split_features(labelled, features)
    fold = F.coalesce(F.pmod(md5_key(seed, "_key"), F.lit(folds)).cast("int"), F.lit(0)).alias("_fold")
    rows = labelled.select(
        (F.col(key) if key else content_key(labelled, features + [target])).alias("_key"),
        *[_num(labelled, c).alias(f"n{j}") for j, c in enumerate(num)],
        *[_cat(c).alias(f"c{j}") for j, c in enumerate(cat)],
        F.col(f"`{target}`").cast("double").alias("_y"),
    ).select(fold, *[f"n{j}" for j in range(len(num))], *[f"c{j}" for j in range(len(cat))], "_y").where(
        F.col("_y").isNotNull() & ~F.isnan("_y") & (F.abs("_y") < float("inf"))
    )
    levels: list[list[str]] = []
    if cat:
        sizes = rows.agg(*[F.approx_count_distinct(f"c{j}", 0.01).alias(f"c{j}") for j in range(len(cat))]).first()
        if wide := [c for j, c in enumerate(cat) if (sizes[j] or 0) > max_levels * 1.05]:
            raise ValueError(f"columns with more than {max_levels} levels: {wide}; use cross_validate with hash_cols")
        found = rows.agg(*[F.collect_set(f"c{j}").alias(f"c{j}") for j in range(len(cat))]).first()
        levels = [sorted(found[j] or []) for j in range(len(cat))]
    pilots = _pilot(rows, [*[f"n{j}" for j in range(len(num))], "_y"])
    sums = fold_products(rows, len(num), pilots, levels)
    width = 2 + 2 * len(num) + sum(map(len, levels))
    empty = np.zeros((width, width))
    total = sum(sums.values(), empty)
    found_rows = []
    for k in range(folds):
        test = sums.get(k, empty)
        train = sum((m for f, m in sums.items() if f != k), empty)
        n_train, n_test = round(train[0, 0]), round(test[0, 0])
        scores = {}
        if n_train and n_test:
            to = _prepared(train, len(num), levels)
            y = np.zeros(width)
            y[-1], y[0] = 1.0, -train[0, -1] / train[0, 0]
            gram, cross = to.T @ train @ to, to.T @ train @ y
            ybar = y.copy()
            ybar[0] = -test[0, -1] / test[0, 0]
            spread = ybar @ test @ ybar
            for a in alphas:
                miss = y - to @ _fit(model, a, gram, cross, train[0, 0])
                sse = max(float(miss @ test @ miss), 0.0)
                scores[a] = (sse / n_test, float(np.sqrt(sse / n_test)), float(1 - sse / spread) if spread > 0 else None)
        found_rows += [(k, a, n_train, n_test, *scores.get(a, (None, None, None))) for a in alphas]
    for a in alphas:
        mine = [r for r in found_rows if r[1] == a]
        mean = lambda i: float(np.mean([r[i] for r in mine if r[i] is not None])) if any(r[i] is not None for r in mine) else None  # noqa: E731,B023
        found_rows.append((-1, a, None, round(total[0, 0]), mean(4), mean(5), mean(6)))
    return df.sparkSession.createDataFrame(
        found_rows, "fold int, alpha double, n_train long, n_test long, mse double, rmse double, r2 double"
    )
