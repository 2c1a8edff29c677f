"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_ctes

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("possession", "basics", "spatial", "keypoints", "tracking", "teams", "tactics", "alerting", "storage")


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by tests only."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"pitchlake.plans.{module}_queries")


_VIEWS: dict[tuple[str, str], Views] = {}


def views(spark: SparkSession, sf_dir: str) -> Views:
    """One set of views per application and folder, so shared results are written once."""
    return _VIEWS.setdefault((spark.sparkContext.applicationId, sf_dir), Views(spark, sf_dir))


def queries(share: bool = True) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries. With `share` off every call starts from the tables (for timing)."""
    load()

    def bound(fn):
        return lambda spark, sf_dir: fn(views(spark, sf_dir) if share else Views(spark, sf_dir))

    return {name: bound(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
