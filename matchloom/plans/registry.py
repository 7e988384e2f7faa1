"""Named queries: a Spark plan over the input tables plus, where possible, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.plans.duck import with_ctes
from matchloom.plans.inputs import Inputs
from matchloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, fn: Callable[[Inputs], DataFrame]) -> DataFrame:
    ship(spark)
    return fn(Inputs(spark, sf_dir))


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, fn)
        if sql is not None:
            ORACLES[name] = with_ctes(sql, ctes)
        return fn

    return add
