"""Registration of the driver queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Add a query (spark, sf_dir) -> DataFrame and, where SQL can express it, its DuckDB text."""
    def keep(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str]) -> str:
    """A column name that none of ``taken`` equals, whatever its case."""
    low, name = {c.lower() for c in taken}, "_own"
    while name in low:
        name += "_"
    return name
