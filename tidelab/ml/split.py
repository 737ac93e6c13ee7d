"""Train/test splits (G15, G16) keyed by a hash of (seed, key): reproducible, independent of the
partitioning and of the order rows arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.functions.hashing import md5_key
from tidelab.plans.ranking import rank_within

HASH_SPACE = 16 ** 15  # md5_key takes 15 hex digits


def split_threshold(train_pct: float) -> int:
    """Integer threshold on the hash key for a ``train_pct`` percent split (exact integer math)."""
    pct = max(0.0, min(float(train_pct), 100.0))
    return int(pct * HASH_SPACE // 100)


def hash_split(df: DataFrame, key: str, train_pct: float = 80, seed: int = 42) -> DataFrame:
    """Add ``is_train``: ``md5(seed|key)`` below the percentile threshold. One narrow projection —
    no shuffle, each row decided on its own; the train share is ``train_pct`` in expectation."""
    return df.withColumn("is_train", md5_key(seed, key) < F.lit(split_threshold(train_pct)))


def exact_split(df: DataFrame, key: str, train_pct: float = 80, seed: int = 42, label: str | None = None) -> DataFrame:
    """Add ``is_train`` with exactly ``floor(n · pct / 100)`` train rows (per ``label`` stratum when
    given): rows ordered by ``(md5(seed|key), key)``, the first ones train. Ranking is skew-safe
    (``rank_within``), so a dominant class does not land in one task."""
    h = md5_key(seed, key)
    groups = [label] if label else []
    ranked = rank_within(df.withColumn("_h", h), groups, ["_h", key])
    pct = int(round(float(train_pct) * 100))  # hundredths of a percent, integer math below
    return ranked.withColumn("is_train", F.col("_rank") <= F.floor(F.col("_group_n") * F.lit(pct) / F.lit(10000))).drop(
        "_h", "_rank", "_group_n"
    )


def stratified_split(df: DataFrame, label: str, key: str, train_pct: float = 80, seed: int = 42) -> DataFrame:
    """Exact per-class split (``stratify=y``)."""
    return exact_split(df, key, train_pct, seed, label=label)
