"""Evaluation metrics as Spark aggregates.

Everything is a map-side-combinable aggregate (``count_if``/``sum``) over the prediction frame;
nothing is collected but the final one-row results. ROC AUC is computed exactly without a global
window: per distinct score the positive/negative counts are pre-aggregated, the distinct scores are
range-partitioned in score order, each partition accumulates its local Mann–Whitney sum in one
Arrow-batched pass, and partition totals (one row per partition) are combined with prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelab.functions.text import round_value
from tidelab.session import ship_package

DIGITS = 4


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _f1(p, r):
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def binary_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction", positive=1) -> DataFrame:
    y, yh = F.col(label), F.col(prediction)
    return pred.agg(
        F.count_if((y == positive) & (yh == positive)).alias("tp"),
        F.count_if((y != positive) & (yh == positive)).alias("fp"),
        F.count_if((y == positive) & (yh != positive)).alias("fn"),
        F.count_if((y != positive) & (yh != positive)).alias("tn"),
    )


def classification_metrics(
    pred: DataFrame, label: str = "label", prediction: str = "prediction", positive=1, average: str = "binary"
) -> DataFrame:
    """One row: ``accuracy, precision, recall, f1, score`` (score = f1), rounded to 4 decimals.

    ``average="binary"`` scores the ``positive`` class; ``"weighted"`` / ``"macro"`` average the
    per-class report.
    """
    if average == "binary":
        c = binary_counts(pred, label, prediction, positive)
        tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
        p = _safe_div(tp, tp + fp)
        r = _safe_div(tp, tp + fn)
        return c.select(
            round_value(_safe_div(tp + tn, tp + fp + fn + tn), DIGITS).alias("accuracy"),
            round_value(p, DIGITS).alias("precision"),
            round_value(r, DIGITS).alias("recall"),
            round_value(_f1(p, r), DIGITS).alias("f1"),
        ).withColumn("score", F.col("f1"))
    rep = class_report(pred, label, prediction, rounded=False, with_tp=True)
    if average == "weighted":
        w = F.col("support").cast("double")
        agg = rep.agg(
            (F.sum(F.col("precision") * w) / F.sum(w)).alias("precision"),
            (F.sum(F.col("recall") * w) / F.sum(w)).alias("recall"),
            (F.sum(F.col("f1") * w) / F.sum(w)).alias("f1"),
            _safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        )
    elif average == "macro":
        agg = rep.agg(
            F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
            _safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        )
    else:
        raise ValueError(f"unknown average {average!r}")
    # Accuracy comes from the same per-class table (Σ tp / Σ support): one aggregate, no join.
    return agg.select(
        *[round_value(F.col(m), DIGITS).alias(m) for m in ("accuracy", "precision", "recall", "f1")]
    ).withColumn("score", F.col("f1"))


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction", rounded: bool = True,
                 with_tp: bool = False) -> DataFrame:
    """Per class: ``class, precision, recall, f1, support`` (a class never predicted or never
    present gets 0 for the undefined ratios). The predictions are read once: each row counts for its
    label and for its prediction, combined map-side per class."""
    y, yh = F.col(label), F.col(prediction).cast(pred.schema[label].dataType)
    sides = pred.select(F.inline(F.array(
        F.struct(y.alias("class"), F.lit(1).alias("s"), (y == yh).cast("int").alias("t"), F.lit(0).alias("p")),
        F.struct(yh.alias("class"), F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(1).alias("p")),
    )))
    j = sides.groupBy("class").agg(
        F.sum("s").alias("support"), F.coalesce(F.sum("t"), F.lit(0)).alias("tp"), F.sum("p").alias("predicted")
    )
    p = _safe_div(F.col("tp"), F.col("predicted"))
    r = _safe_div(F.col("tp"), F.col("support"))
    f = _f1(p, r)
    rnd = (lambda c: round_value(c, DIGITS)) if rounded else (lambda c: c)
    extra = [F.col("tp")] if with_tp else []
    return j.select("class", rnd(p).alias("precision"), rnd(r).alias("recall"), rnd(f).alias("f1"), F.col("support").cast("long"), *extra)


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction", classes: list | None = None) -> DataFrame:
    """``label`` × predicted class counts. With a list of classes, one column ``pred_<c>`` for each;
    without one the long form (``confusion_long``), which holds any number of classes."""
    if classes is None:
        return confusion_long(pred, label, prediction)
    pv = pred.groupBy(F.col(label).alias("label")).pivot(prediction, classes).agg(F.count(F.lit(1)))
    return pv.select("label", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(f"pred_{c}") for c in classes])


def confusion_long(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def _auc_partition(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pid = TaskContext.get().partitionId()
    neg_seen = 0
    pos_total = 0
    neg_total = 0
    local = 0.0
    for pdf in it:
        pos = pdf["pos"].to_numpy(dtype=np.int64)
        neg = pdf["neg"].to_numpy(dtype=np.int64)
        before = neg_seen + np.cumsum(neg) - neg
        local += float(np.sum(pos * (before + 0.5 * neg)))
        neg_seen += int(neg.sum())
        pos_total += int(pos.sum())
        neg_total += int(neg.sum())
    yield pd.DataFrame({"pid": [pid], "p": [pos_total], "n": [neg_total], "u": [local]})


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Exact ROC AUC (ties count one half), one row ``roc_auc`` rounded to 4 decimals; null when a
    class is missing."""
    ship_package(pred.sparkSession)
    per_score = pred.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == positive).alias("pos"), F.count_if(F.col(label) != positive).alias("neg")
    )
    ranged = per_score.repartitionByRange("s").sortWithinPartitions("s")
    parts = ranged.mapInPandas(_auc_partition, "pid int, p long, n long, u double")
    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.withColumn("neg_before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    tot = parts.agg(
        F.sum(F.col("u") + F.col("p") * F.col("neg_before")).alias("u"),
        F.sum("p").alias("p"),
        F.sum("n").alias("n"),
    )
    return tot.select(
        F.when((F.col("p") == 0) | (F.col("n") == 0), F.lit(None).cast("double"))
        .otherwise(round_value(F.col("u") / (F.col("p").cast("double") * F.col("n")), DIGITS))
        .alias("roc_auc")
    )


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: ``rmse, mae, r2, score`` (score = r2), 4 decimals. ``var_pop`` keeps the total sum of
    squares numerically stable (merged per-partition moments, not Σy² − nȳ²)."""
    e = F.col(prediction).cast("double") - F.col(label).cast("double")
    a = pred.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
        (F.var_pop(F.col(label).cast("double")) * F.count(F.lit(1))).alias("sst"),
    )
    r2 = F.when(F.col("sst") == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.col("sse") / F.col("sst"))
    return a.select(
        round_value(F.sqrt("mse"), DIGITS).alias("rmse"),
        round_value(F.col("mae"), DIGITS).alias("mae"),
        round_value(r2, DIGITS).alias("r2"),
    ).withColumn("score", F.col("r2"))


def metrics_long(metrics_row: DataFrame) -> DataFrame:
    """One-row metric frame → ``(metric_name, metric_value)`` rows."""
    cols = metrics_row.columns
    return metrics_row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric_name"), F.col(c).cast("double").alias("metric_value")) for c in cols]))
    )
