"""The register of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.standins import standin, with_standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_standins(sql)
        return f

    return keep


class Tables:
    """Tables and stand-ins by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = (spark, sf_dir)

    def __getitem__(self, name: str) -> DataFrame:
        return self._at[0].read.parquet(f"{self._at[1]}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return standin(*self._at, name)
