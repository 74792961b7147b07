"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name`` with its SQL counterpart."""

    def add(fn):
        REGISTERED[name] = Query(fn, sql)
        return fn

    return add
