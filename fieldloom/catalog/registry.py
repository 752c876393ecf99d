"""Collects the registered queries of all areas."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from fieldloom.plans.ship import ship_package
from fieldloom.sources.derived import Tables, twin_sql

_AREAS = (
    "capture",
    "records",
    "statistics",
    "entities",
    "extraction",
    "publishing",
    "search",
    "changes",
    "configuration",
    "jobs",
    "streams",
    "versions",
)
_QUERIES: dict[str, Callable] = {}
_TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(tables)``; ``sql`` is its twin over the same tables."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        _QUERIES[name] = run
        if sql is not None:
            _TWINS[name] = twin_sql(sql, ctes)
        return fn

    return wrap


def _load() -> None:
    for area in _AREAS:
        importlib.import_module(f"fieldloom.catalog.{area}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_TWINS)
