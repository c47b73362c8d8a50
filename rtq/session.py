"""Session helpers: one place for the conf this library relies on, and for
intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "rtq") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the ambient session."""
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RTQ_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A folder given to ``setCheckpointDir`` counts first, then the
    ``spark.checkpoint.dir`` setting.  Only a local session (one machine) gets a
    scratch folder of its own; on a cluster an unset folder is an error, since
    executors could not see each other's local disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="rtq-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir()
    return current


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), "rtq-" + spark.sparkContext.applicationId)


_SCOPES: list[str] = []


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    return os.path.join(scratch_root(spark), *_SCOPES[-1:], f"{name}-{uuid.uuid4().hex}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession, name: str = "scope") -> Iterator[None]:
    """Intermediate tables made inside go to a folder of their own, deleted at the
    end.  What is to stay must be written elsewhere before that."""
    _SCOPES.append(f"{name}-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, os.path.join(scratch_root(spark), _SCOPES.pop()))


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables.  The owner of a result
    calls it once the result is written: until then lazy plans read them."""
    _delete(spark, scratch_root(spark))


def cut_lineage(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage of a plan: write the rows once as a parquet table in the
    shared checkpoint folder (it survives executor loss) and read them back.
    One pass, unlike an uncached ``Dataset.checkpoint`` which computes the plan
    twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
