"""Registration of named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depotlens.sources.tables import with_views

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Build], Build]:
    """Registers a query; ``views`` names the model views its SQL reads."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return build

    return register
