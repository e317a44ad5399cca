"""Named queries: operators bound to the driver tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def bound(name: str, sql: str | None = None):
    """Registers a query under a name, with the SQL that must give the same rows."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    from driftlane.bindings import (  # noqa: F401
        cards, community, cohort, ingest, interactions, longitudinal, session, snapshot,
    )
