"""The query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shutterlake.plans.library import Library, with_tables
from shutterlake.session import ship_package


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Library], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return self.build(Library(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, extra: dict[str, str] | None = None):
    """Registers the function under its name, with the SQL that gives the same rows."""

    def register(build: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, build, with_tables(sql, extra) if sql else None)
        return build

    return register
