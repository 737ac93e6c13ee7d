"""Preprocessing pipeline (G17, G18) and estimator construction.

Preprocessing is a ``pyspark.ml.Pipeline`` whose statistics come from the training rows only:
numeric features are mean-imputed and standardised, categorical ones indexed and one-hot encoded;
the label is indexed for classification (see ``ml/features.py``). Estimators map the workbench's (scikit-learn style) hyper-parameters onto Spark
ML's: an L2 penalty ``alpha·‖w‖²`` over ``n`` rows becomes ``regParam = alpha·σ_y / n`` (Spark
scales the label internally), ``C`` becomes ``regParam = 1 / (C·n)``.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame

from tidelab.ml.boosting import SecondOrderBoosting
from tidelab.ml.custom import AdaBoostClassifier, LinearSVR, RandomFourierFeatures
from tidelab.ml.dual import DualSVC, DualSVR
from tidelab.ml.features import TabularFeatures, split_features  # noqa: F401 - re-exported
from tidelab.ml.registry import merge_params, normalise_kernel

def build_preprocessing(df: DataFrame, features: list[str], target: str, task: str, train_col: str = "",
                        hash_cols: list[str] | None = None) -> Pipeline:
    """Preprocessing as a Pipeline stage producing ``features`` (vector) and ``label`` (double):
    one ``TabularFeatures`` estimator (single statistics pass, expression-based transform).
    Columns of ``hash_cols`` are hashed instead of one-hot encoded, for more levels than that takes."""
    return Pipeline(stages=[TabularFeatures(featureCols=list(features), labelCol=target, task=task, trainCol=train_col,
                                            hashCols=[c for c in hash_cols or [] if c in features])])


def _depth(wanted) -> int:
    """Spark's trees go 30 levels deep; a run that asks for more fails instead of training less."""
    depth = int(wanted)
    if depth > 30:
        raise ValueError(f"max_depth {depth} is more than the 30 levels that Spark's trees support")
    return depth


def build_estimator(task: str, name: str, params: dict | None = None, n_train: int = 1, label_std: float = 1.0, num_classes: int = 2):
    """Spark ML estimator for a registry model (``featuresCol=features``, ``labelCol=label``).
    KNN is not an ``Estimator`` here; the benchmark runs it through ``knn_predict``."""
    p = merge_params(name, params)
    n = max(int(n_train), 1)
    multi = num_classes > 2
    if task == "regression":
        if name == "Linear Regression":
            return LinearRegression(regParam=0.0)
        if name == "Ridge":
            return LinearRegression(elasticNetParam=0.0, regParam=float(p["alpha"]) * max(label_std, 1e-12) / n,
                                    standardization=False, solver="l-bfgs", tol=1e-10, maxIter=500)
        if name == "Lasso":
            return LinearRegression(elasticNetParam=1.0, regParam=float(p["alpha"]), standardization=False, maxIter=500)
        if name == "SVR":
            solver = DualSVR if p.get("solver") == "dual" else LinearSVR
            svr = solver(C=float(p.get("C", 1)), epsilon=float(p.get("epsilon", 0.1)))
            if normalise_kernel(p.get("kernel")) == "linear":
                return svr
            return Pipeline(stages=[RandomFourierFeatures(outputCol="_rff", numFeatures=int(p.get("n_components", 200))),
                                    svr.setFeaturesCol("_rff")])
        if name == "Decision Tree":
            return DecisionTreeRegressor(maxDepth=_depth(p["max_depth"]),
                                         minInstancesPerNode=max(1, math.ceil(int(p["min_samples_split"]) / 2)))
        raise ValueError(f"unknown regression model {name!r}")
    if name == "Logistic Regression":
        return LogisticRegression(regParam=1.0 / (float(p["C"]) * n), elasticNetParam=0.0, standardization=False,
                                  maxIter=int(p["max_iter"]))
    if name == "SVM":
        if p.get("solver") == "dual" and not multi:  # with a certificate; the intercept is penalised
            svc = DualSVC(C=float(p.get("C", 1)))
        else:
            svc = LinearSVC(regParam=1.0 / (float(p.get("C", 1)) * n), maxIter=200)
        kernel = normalise_kernel(p.get("kernel"))
        if kernel == "rbf":
            svc.setFeaturesCol("_rff")
            pre = [RandomFourierFeatures(outputCol="_rff", numFeatures=int(p.get("n_components", 200)))]
        elif kernel == "poly":
            svc.setFeaturesCol("_poly")
            pre = [PolynomialExpansion(degree=int(p.get("degree", 3)), inputCol="features", outputCol="_poly")]
        else:
            pre = []
        clf = OneVsRest(classifier=svc, featuresCol=svc.getFeaturesCol()) if multi else svc
        return Pipeline(stages=pre + [clf]) if pre else clf
    if name == "Naive Bayes":
        return NaiveBayes(modelType="gaussian")
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=int(p["n_estimators"]), maxDepth=_depth(p["max_depth"]), seed=42)
    if name == "XGBoost":
        return SecondOrderBoosting(loss="softmax" if multi else "logistic", numClasses=max(num_classes, 2), rounds=int(p["n_estimators"]),
                                   learningRate=float(p["learning_rate"]), maxDepth=_depth(p["max_depth"]),
                                   regLambda=float(p.get("reg_lambda", 1)), gamma=float(p.get("gamma", 0)),
                                   minChildWeight=float(p.get("min_child_weight", 1)))
    if name == "AdaBoost":
        return AdaBoostClassifier(numRounds=int(p["n_estimators"]), learningRate=float(p["learning_rate"]), numClasses=num_classes)
    if name == "Decision Tree":
        return DecisionTreeClassifier(maxDepth=_depth(p.get("max_depth", 5)))
    raise ValueError(f"unknown classification model {name!r}")
