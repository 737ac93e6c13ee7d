"""Model registry (G13) and parameter merge."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# The model catalogue and default hyper-parameters, per task.
REGRESSION_MODELS = {
    "Linear Regression": {},
    "Ridge": {"alpha": 1},
    "Lasso": {"alpha": 1},
    "SVR": {"C": 1, "epsilon": 0.1, "kernel": "rbf"},
    "Decision Tree": {"max_depth": 5, "min_samples_split": 2},
}
CLASSIFICATION_MODELS = {
    "Logistic Regression": {"C": 1, "max_iter": 1000},
    "KNN": {"n_neighbors": 5},
    "SVM": {"C": 1, "kernel": "rbf"},
    "Naive Bayes": {},
    "Random Forest": {"n_estimators": 100, "max_depth": 10},
    "XGBoost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6},
    "AdaBoost": {"n_estimators": 50, "learning_rate": 1},
}
TASKS = ("regression", "classification")
# Kernel slider positions.
KERNEL_CODES = {0: "linear", 1: "rbf", 2: "poly"}


def models_for(task: str) -> dict[str, dict]:
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    return REGRESSION_MODELS if task == "regression" else CLASSIFICATION_MODELS


def default_models(task: str) -> list[str]:
    return list(models_for(task))


def default_params(name: str) -> dict:
    return dict({**REGRESSION_MODELS, **CLASSIFICATION_MODELS}.get(name, {}))


def merge_params(name: str, overrides: dict | None) -> dict:
    """Defaults overlaid by per-model overrides (unknown keys are kept, as the original does)."""
    return {**default_params(name), **(overrides or {})}


def normalise_kernel(value) -> str:
    """Accept the name or the slider number (0 linear, 1 rbf, 2 poly)."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return KERNEL_CODES.get(int(value), "rbf")
    return str(value or "rbf").lower()


def model_registry(spark: SparkSession) -> DataFrame:
    """``(task, model_name, default_params_json)`` — the catalogue as a small table."""
    rows = [(t, name, json.dumps(p, sort_keys=True)) for t in TASKS for name, p in models_for(t).items()]
    return spark.createDataFrame(rows, "task string, model_name string, default_params_json string")
