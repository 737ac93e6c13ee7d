"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their smoothed counts in the two classes, and a
linear model with hinge loss is fitted on them by dual coordinate descent. N-grams run over word
shapes (letter case, digits, signs, and whether a word repeats the one before it), which show debris
of layout in any language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.llm.common import ship, utf8
from tidelab.llm.labelled import fit_platt, held_out, sigmoid, training_sample

_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b"\t\n\v\f\r " else c
    for c in range(256)
)
_RUN = re.compile(rb"([^ ])\1+")
BITS = 20


def shapes_of(text: bytes) -> list[bytes]:
    """The shape of each word: runs of a class shrink to one sign; ``=`` in front of a word that
    repeats the one before it."""
    shapes = _RUN.sub(rb"\1", text.translate(_SHAPE)).split()
    words = text.split()
    return [b"=" + s if a == b else s for s, a, b in zip(shapes, words, [b"", *words], strict=False)]


def ngrams(text: bytes, cache: dict[bytes, int]) -> set[int]:
    """Hashed indicators: shape n-grams of one to three words."""
    shapes = shapes_of(text)
    grams = set(shapes)
    grams.update(map(b" ".join, zip(shapes, shapes[1:], strict=False)))
    grams.update(map(b" ".join, zip(shapes, shapes[1:], shapes[2:], strict=False)))
    if len(cache) > 200_000:
        cache.clear()
    for g in grams.difference(cache):
        cache[g] = crc32(g) & ((1 << BITS) - 1)
    return {cache[g] for g in grams}


def log_count_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float, alpha: float = 1.0) -> np.ndarray:
    """Per feature the log of its smoothed share in class 1 over that in class 0."""
    return np.log((pos + alpha) / (n_pos + 2 * alpha)) - np.log((neg + alpha) / (n_neg + 2 * alpha))


def dual_coordinate_descent(
    rows: list[np.ndarray], scale: np.ndarray, label: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Weights (on unscaled indicators) and bias of the L2-regularised hinge-loss model whose inputs
    are the indicators times ``scale``, each row brought to unit length."""
    y = np.where(label == 1, 1.0, -1.0)
    w = np.zeros(len(scale))
    bias = 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-9) for r in rows]
    square = np.array([(v * v).sum() + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


class Model:
    """A fitted model: scale and weight of each feature, bias and calibration."""

    def __init__(self, scale: np.ndarray, weight: np.ndarray, bias: float, a: float, b: float):
        self.scale, self.weight = scale.astype(np.float32), weight.astype(np.float32)
        self.bias, self.a, self.b = bias, a, b

    def margin(self, ids: np.ndarray) -> float:
        v = self.scale[ids]
        size = np.sqrt((v * v).sum())
        return float(self.weight[ids] @ v / size + self.bias) if size > 0 else self.bias

    def score(self, ids: np.ndarray) -> float:
        return sigmoid(self.a * self.margin(ids) + self.b)


def fit_model(
    rows: list[np.ndarray], label: np.ndarray, weight: dict[int, float], least_df: int = 5, cost: float = 4.0,
) -> Model:
    """Fit ratios and hinge loss on four fifths of the sample, the calibration on the rest."""
    calib = np.arange(len(rows)) % 5 == 0
    each = np.where(label == 1, weight[1], weight[0])
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, y, out in zip(rows, label, calib, strict=True):
        if not out:
            (pos if y == 1 else neg)[r] += 1
    scale = log_count_ratio(pos, neg, max(1, (label[~calib] == 1).sum()), max(1, (label[~calib] == 0).sum()))
    scale[pos + neg < least_df] = 0.0
    train = np.flatnonzero(~calib)
    w, bias = dual_coordinate_descent(
        [rows[i] for i in train], scale, label[train], cost * np.ones(len(train))
    )
    model = Model(scale, w, bias, 1.0, 0.0)
    margin = np.array([model.margin(rows[i]) for i in np.flatnonzero(calib)])
    model.a, model.b = fit_platt(margin, label[calib], each[calib])
    return model


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 8000, modulus: int = 5, remainder: int = 0,
    label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class that are not held out. Features are
    taken from whole texts in tasks; the driver gets the sample's hashed indicators alone. With one
    class or none labelled, the model gives the same score to all."""
    ship(docs.sparkSession)
    sample, weight = training_sample(docs, labels, label_col, modulus, remainder, per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            ids = [sorted(ngrams(t.as_py(), cache)) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "label", "ids"]
            )

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, ids array<int>")
    got = sorted(rows.collect(), key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    if len({r["label"] for r in got}) < 2:
        same = 0.0 if got and got[0]["label"] == 0 else 1.0
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 4.0 if same else -4.0)
    return fit_model([np.array(r["ids"], np.int64) for r in got], np.array([r["label"] for r in got]), weight)


def score_quality(
    docs: DataFrame, model: Model, modulus: int = 5, remainder: int = 0, threshold: float = 0.3,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, from its whole text alone. Null texts
    count as empty and get the score of a text without n-grams; repeated rows each get their row;
    other columns are not read; an empty table gives no rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            scores = [
                model.score(np.fromiter(grams, np.int64, len(grams)))
                for t in batch.column(1).cast(pa.binary())
                for grams in (ngrams(t.as_py(), cache),)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, score double")
    return scored.select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
