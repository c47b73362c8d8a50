"""Sources and sinks: SRC1, SRC2, SNK1-SNK3.

Explicit schemas (no inference); Parquet by default for results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rtq.session import scratch_path  # noqa: F401  (re-exported)

SEGMENT_SCHEMA = ("id STRING, lp STRING, system STRING, src STRING, mt STRING, ref STRING, score DOUBLE, "
                  "raw DOUBLE, annotators INT, domain STRING, trg STRING")
FEATURE_COLUMNS = ["EXTRA", "MISS", "STOPWORD", "INFL", "DERI", "SENSE"]


def read_segments(spark: SparkSession, path: str, schema: str = SEGMENT_SCHEMA) -> DataFrame:
    """SRC1: CSV of segments, UTF-8, header, quoted multi-line fields."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("encoding", "UTF-8").csv(path))


def read_scored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC2: a feature CSV keyed by ``id`` (kept as an ordinary column)."""
    schema = schema or (SEGMENT_SCHEMA + ", " + ", ".join(f"{c} DOUBLE" for c in FEATURE_COLUMNS))
    return read_segments(spark, path, schema)


def write_features(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partition_by: list[str] | None = None) -> None:
    """SNK1: write a result table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)


def write_batches(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ("lp", "batch_no")) -> None:
    """SNK2: one output partition per (language pair, batch); re-running a batch
    overwrites only its own partitions (restart points, Q10)."""
    (df.repartition(*partition_cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def materialize_lexicon(df: DataFrame, path: str, key: str, num_buckets: int | None = None,
                        table: str | None = None) -> DataFrame:
    """SNK3: persist looked-up lexicon rows for later runs, bucketed and sorted by
    the lookup key, and read them back as a table of the session's catalog: a join
    on ``key`` shuffles the looked-up side only.  One task writes one bucket."""
    spark = df.sparkSession
    n = num_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = table or "lexicon_" + uuid.uuid4().hex
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").mode("overwrite")
     .option("path", path).saveAsTable(table))
    return spark.table(table)


def attach_lexicon(spark: SparkSession, path: str, schema: str, key: str, num_buckets: int, table: str | None = None) -> DataFrame:
    """SNK3: the bucketed table that an earlier run wrote to ``path``, in this
    session's catalog (``schema`` and ``num_buckets`` as written)."""
    table = table or "lexicon_" + uuid.uuid4().hex
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
              f"INTO {num_buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_segment_columns(df: DataFrame) -> DataFrame:
    """Fill the reference segment schema from a (pair_id, lp, src, trg) fixture."""
    return df.select(F.col("pair_id").cast("string").alias("id"), "lp", F.lit(None).cast("string").alias("system"),
                     "src", F.col("trg").alias("mt"), F.lit(None).cast("string").alias("ref"),
                     F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("raw"),
                     F.lit(None).cast("int").alias("annotators"), F.lit(None).cast("string").alias("domain"),
                     F.col("trg").alias("trg"))
