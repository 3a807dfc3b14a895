"""Registered queries: each pairs a Spark plan over the given tables with an oracle in SQL."""

from __future__ import annotations

import functools
import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory ids it exercises."""

    def add(fn):
        if name in SPARK:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf)

        SPARK[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load_all() -> None:
    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
