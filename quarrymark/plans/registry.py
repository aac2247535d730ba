"""Named queries: a Spark builder plus, where SQL can express it, an independent SQL statement of the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarrymark.sources.tables import Tables


@dataclass(frozen=True)
class NamedQuery:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, NamedQuery] = {}


def named(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def add(build):
        if name in CATALOGUE:
            raise ValueError(f"query {name} registered twice")
        CATALOGUE[name] = NamedQuery(name, build, sql)
        return build

    return add


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: NamedQuery):
        return lambda spark, folder: q.build(Tables(spark, folder))

    return {name: bind(q) for name, q in CATALOGUE.items()}


def statements() -> dict[str, str]:
    return {name: q.sql for name, q in CATALOGUE.items() if q.sql is not None}
