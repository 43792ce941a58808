"""Where catalogues register queries: a name, a function of the knowledge tables, and the oracle's SQL (or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwell.plans.adapters import Knowledge, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, plan: Callable[[Knowledge], DataFrame], sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: plan(Knowledge(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = oracle(sql)
