"""Registry of named queries: a Spark builder and (optionally) a DuckDB twin.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables.  The SQL twin, when present, is an independent formulation the
driver runs in DuckDB over the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None
    ids: tuple[str, ...]


_REGISTRY: dict[str, Entry] = {}


def register(name: str, ids: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``."""
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Entry(name, fn, sql, tuple(ids.split()))
        return fn
    return deco


def entries() -> dict[str, Entry]:
    """All registered queries (the catalog modules register on import)."""
    from . import (catalog, catalog_alerts, catalog_calibrate, catalog_derive,  # noqa: F401
                   catalog_io, catalog_prep, catalog_stream)
    return dict(_REGISTRY)
