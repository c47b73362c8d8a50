"""Registry of the driver queries: Spark builder + DuckDB oracle per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (both engines round the same way)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        QUERIES[key].__doc__ = fn.__doc__
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers its queries)."""
    from rtq.plans import q_align, q_features, q_io, q_lexicon, q_ml, q_scoring, q_text  # noqa: F401
