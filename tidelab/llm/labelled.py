"""What the two classifiers share: bounded samples of labelled rows, held-out rows, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo ``modulus``, is ``remainder``. A null
    id has no label to learn from and is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int, per_class: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, dict[int, float]]:
    """``(doc_id, text, label)`` of at most ``per_class`` labelled rows of each class, chosen by a
    hash of the id, and how many labelled rows each of a class stands for. Repeated labels of an id
    count once, conflicting ones as the larger; null labels and ids are left out. Of rows that share an id
    one counts, that with the smallest hash of its text, so the bound holds for rows as well. At most
    ``2 * per_class`` ids of 8 bytes are broadcast; the texts are read once, and of each id's rows one a
    task is shuffled."""
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(~held_out("doc_id", modulus, remainder))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = part(0).unionByName(part(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    weight = {y: max(1.0, counts.get(y, 0) / per_class) for y in (0, 1)}
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("row")
    picked = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one)
    return picked.select("doc_id", "row.text", "row.label"), weight


def fit_platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """``a, b`` of ``sigmoid(a * margin + b)`` by Newton's method with halved steps, on weighted and
    smoothed targets. Margins are standardised for the fit."""
    if len(margin) == 0:
        return 1.0, 0.0
    centre, spread = float(margin.mean()), float(margin.std()) or 1.0
    pos, neg = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([(margin - centre) / spread, np.ones(len(margin))])

    def loss(theta):
        z = np.clip(x @ theta, -500, 500)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * (theta @ theta))

    theta = np.array([1.0, 0.0])
    best = loss(theta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-6 and loss(theta - size * move) >= best:
            size /= 2
        if size <= 1e-6:
            break
        theta = theta - size * move
        best = loss(theta)
    a = float(theta[0]) / spread
    return a, float(theta[1]) - a * centre


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))

