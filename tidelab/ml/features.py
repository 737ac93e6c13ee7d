"""Tabular feature preparation (G17) as one Spark ML ``Estimator``.

``fit`` takes one statistics pass — per numeric column the mean, sample deviation and non-null count
of the training rows, per categorical column a HyperLogLog level count — and, when categorical
columns or classes exist, a second pass collecting the level sets the sketch has proven small
(≤ ``maxLevels``; what ``StringIndexer`` would collect too). A wider column is an error, unless the
caller names it in ``hashCols``: those are hashed into ``hashFeatures`` slots (``FeatureHasher``), at
any number of levels, so no column changes its encoding as the data grows. ``transform`` is plain
column expressions: numerics mean-imputed and standardised (the deviation is that of the imputed
column, as an imputer followed by a scaler would give), categoricals indexed in descending order and
one-hot encoded with the last index dropped — so the alphabetically first level and unseen or
missing levels are the all-zero baseline — and the label indexed in ascending class order.
Compared with an Imputer → StandardScaler → StringIndexer chain it saves passes over the data and
never brings an unbounded level set to the driver.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
MISSING = "__missing__"


def split_features(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    num, cat = [], []
    for f in features:
        dt = df.schema[f].dataType
        (num if isinstance(dt, _NUMERIC + _TIME) else cat).append(f)
    return num, cat


def _num(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, _TIME):
        return F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def _cat(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


class _FeatureParams(Params):
    featureCols = Param(Params._dummy(), "featureCols", "input columns", TypeConverters.toListString)
    maxLevels = Param(Params._dummy(), "maxLevels", "largest level set collected for one-hot encoding", TypeConverters.toInt)
    hashCols = Param(Params._dummy(), "hashCols", "categorical columns to hash instead of one-hot encoding", TypeConverters.toListString)
    hashFeatures = Param(Params._dummy(), "hashFeatures", "hashed slots for high-cardinality columns", TypeConverters.toInt)
    labelCol = Param(Params._dummy(), "labelCol", "target column", TypeConverters.toString)
    task = Param(Params._dummy(), "task", "regression | classification", TypeConverters.toString)
    trainCol = Param(Params._dummy(), "trainCol", "boolean column marking rows to learn statistics from", TypeConverters.toString)


class TabularFeatures(Estimator, _FeatureParams):
    @keyword_only
    def __init__(self, featureCols=None, labelCol="label", task="regression", trainCol="", maxLevels=10_000, hashCols=None,
                 hashFeatures=1 << 18):
        super().__init__()
        self._setDefault(featureCols=[], labelCol="label", task="regression", trainCol="", maxLevels=10_000, hashCols=[],
                         hashFeatures=1 << 18)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TabularFeaturesModel":
        feats = self.getOrDefault(self.featureCols)
        target = self.getOrDefault(self.labelCol)
        task = self.getOrDefault(self.task)
        train_col = self.getOrDefault(self.trainCol)
        train = F.col(train_col) if train_col else F.lit(True)
        num, cat = split_features(dataset, feats)
        max_levels = self.getOrDefault(self.maxLevels)
        aggs = [F.count_if(train).alias("_n")]
        for i, c in enumerate(num):
            v = F.when(train, _num(dataset, c))
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.count(v).alias(f"k{i}")]
        for i, c in enumerate(cat):
            aggs.append(F.approx_count_distinct(F.when(train, _cat(c)), 0.01).alias(f"a{i}"))
        if task == "classification":
            aggs.append(F.approx_count_distinct(F.col(target)).alias("_a_classes"))
        row = dataset.agg(*aggs).collect()[0]  # one row: statistics and level-count sketches
        n = row["_n"] or 0
        # Level sets are collected only where the sketch proves them small (2% slack over the 1%
        # error of the sketch).
        chosen = set(self.getOrDefault(self.hashCols))
        hashed = [c for c in cat if c in chosen]
        small = [c for c in cat if c not in chosen]
        if wide := [c for i, c in enumerate(cat) if c in small and (row[f"a{i}"] or 0) > max_levels * 0.98]:
            raise ValueError(f"columns with more than {max_levels} levels: {wide}; name them in hash_cols (hashCols of this stage) or drop them")
        sets = [F.collect_set(F.when(train, _cat(c))).alias(f"l{i}") for i, c in enumerate(small)]
        if task == "classification":
            if (row["_a_classes"] or 0) > max_levels * 0.98:
                raise ValueError(f"target {target!r} has more than {max_levels} classes")
            sets.append(F.collect_set(F.col(target).cast("string")).alias("_classes"))
        lv_row = dataset.agg(*sets).collect()[0] if sets else None
        scale = {}
        for i, c in enumerate(num):
            mean, sd, k = row[f"m{i}"], row[f"s{i}"], row[f"k{i}"] or 0
            # Mean imputation adds rows at the mean: their deviation is zero, the count grows to n.
            var = (sd or 0.0) ** 2 * (k - 1) / (n - 1) if n > 1 and k > 1 else 0.0
            scale[c] = (mean if mean is not None else 0.0, math.sqrt(var))
        levels = {c: sorted(lv_row[f"l{i}"] or [], reverse=True) for i, c in enumerate(small)}
        classes = sorted(lv_row["_classes"] or []) if task == "classification" else None
        model = TabularFeaturesModel(num, small, scale, levels, classes, dataset.sparkSession, hashed,
                                     self.getOrDefault(self.hashFeatures))
        model._set(featureCols=feats, labelCol=target, task=task, trainCol=train_col)
        return model


class TabularFeaturesModel(Model, _FeatureParams):
    def __init__(self, num=None, cat=None, scale=None, levels=None, classes=None, spark=None, hashed=None, hash_slots=1 << 18):
        super().__init__()
        self.num, self.cat = num or [], cat or []
        self.scale, self.levels, self.classes = scale or {}, levels or {}, classes
        self.hashed, self.hash_slots = hashed or [], hash_slots
        self._ohe = None
        if self.cat and spark is not None:
            # The encoder learns its sizes from column metadata: fitted on an empty frame, no job.
            fields = [F.lit(0.0).alias(f"x__{c}", metadata=self._nominal(c)) for c in self.cat]
            empty = spark.range(0).select(*fields)
            self._ohe = OneHotEncoder(inputCols=[f"x__{c}" for c in self.cat], outputCols=[f"o__{c}" for c in self.cat],
                                      dropLast=True).fit(empty)

    def _nominal(self, c: str) -> dict:
        return {"ml_attr": {"type": "nominal", "num_vals": max(len(self.levels[c]), 1), "name": f"x__{c}"}}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        target = self.getOrDefault(self.labelCol)
        out = []
        for c in self.num:
            mean, sd = self.scale[c]
            z = (F.coalesce(_num(dataset, c), F.lit(mean)) - F.lit(mean)) / F.lit(sd) if sd > 0 else F.lit(0.0)
            out.append(z.alias(f"z__{c}"))
        for c in self.cat:
            lv = self.levels[c]
            pos = F.array_position(F.array(*[F.lit(v) for v in lv]), _cat(c)) if lv else F.lit(0)
            last = max(len(lv), 1) - 1
            idx = F.when(pos == 0, F.lit(last)).otherwise(pos - 1).cast("double")
            out.append(idx.alias(f"x__{c}", metadata=self._nominal(c)))
        if target in dataset.columns:
            if self.classes is not None:
                p = F.array_position(F.array(*[F.lit(v) for v in self.classes]), F.col(target).cast("string"))
                label = F.when(p > 0, (p - 1).cast("double"))
            else:
                label = F.col(target).cast("double")
            out.append(label.alias("label"))
        out += [_cat(c).alias(f"h__{c}") for c in self.hashed]
        df = dataset.select("*", *out)
        if self._ohe is not None:
            df = self._ohe.transform(df)
        inputs = [f"z__{c}" for c in self.num] + [f"o__{c}" for c in self.cat]
        if self.hashed:
            df = FeatureHasher(inputCols=[f"h__{c}" for c in self.hashed], outputCol="_hashed",
                               numFeatures=self.hash_slots).transform(df)
            inputs.append("_hashed")
        df = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(df)
        if not self.hashed:
            return df
        # The assembler names every slot in the column's metadata, which then goes into each plan, task and
        # file: of a hashed vector only the size is kept.
        size = len(self.num) + sum(max(len(self.levels[c]) - 1, 0) for c in self.cat) + self.hash_slots
        return df.withColumn("features", F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": size}}))
