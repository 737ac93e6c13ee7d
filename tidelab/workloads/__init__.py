"""Registered workloads: each is ``fn(spark, sf_dir) -> DataFrame`` over the supplied tables, with
an optional equivalent DuckDB SQL text used as an independent oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Workload = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Workload] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Workload) -> Workload:
        if name in REGISTRY:
            raise ValueError(f"duplicate workload {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


MODULES = ("charts", "schema", "profile", "prep", "sqllab", "ingest", "ml", "learners", "experiments", "catalog")


def load_all() -> tuple[dict[str, Workload], dict[str, str]]:
    for mod in MODULES:  # imported for their registrations
        importlib.import_module(f"tidelab.workloads.{mod}")
    return dict(REGISTRY), dict(ORACLE)
