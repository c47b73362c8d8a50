"""Scoring and evaluation: PRJ1-PRJ6, AGG10-AGG13, ML1-ML5, SET1, TOP1.

Global statistics (min, max, counts) are scalar subqueries, never a window
over the whole table and never a cross join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rtq.operators import boosting
from rtq.session import ensure_checkpoint_dir

FEATURES = ["EXTRA", "MISS", "STOPWORD", "INFL", "DERI", "SENSE"]
#: Training rows that one task passes over: at least, and at most where there are more rows than slots take.
ROWS_PER_TASK, MOST_PER_TASK = 20000, 500_000


# --------------------------------------------------------------------- PRJ --

def assign_batches(df: DataFrame, batch_size: int, order_cols: list[str] | str = "id",
                   num_partitions: int | None = None) -> DataFrame:
    """PRJ1: consecutive batches of ``batch_size`` rows in the order of a unique key.

    Distributed row numbering: range-partition and sort by the key, read each
    row's local index from ``monotonically_increasing_id`` (partition id in the
    upper bits), add the row count of all earlier partitions.  The offset table
    has one row per partition, so its broadcast is bounded by the partition
    count, not by the data.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_mid", F.monotonically_increasing_id())
         .withColumn("_p", F.spark_partition_id()))
    s = s.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_p").cast("bigint"), 33)).persist()
    counts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # <= #partitions rows
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)).cast("bigint"))
    out = s.join(F.broadcast(offsets.select("_p", "_off")), "_p")
    rn = F.col("_off") + F.col("_local")  # 0-based row number
    return out.withColumn("batch_no", F.floor(rn / F.lit(batch_size)).cast("int")).drop(
        "_mid", "_p", "_local", "_off")


def resume_from(df: DataFrame, start_batch: int = 0) -> DataFrame:
    """PRJ2: keep batches from ``start_batch`` on (default 0, Q10)."""
    return df.filter(F.col("batch_no") >= F.lit(start_batch))


def language_pairs(df: DataFrame) -> DataFrame:
    """PRJ4: the language pairs present."""
    return df.select("lp").distinct()


def filter_language_pair(df: DataFrame, lp: str) -> DataFrame:
    """PRJ4: the rows of one pair (partition pruning when stored by ``lp``)."""
    return df.filter(F.col("lp") == F.lit(lp))


def clamp_score(df: DataFrame, col: str = "score") -> DataFrame:
    """PRJ5: negative scores -> 0; null stays null."""
    return df.withColumn(col, F.when(F.col(col) < 0, F.lit(0.0)).otherwise(F.col(col)))


def select_features(df: DataFrame, keep: list[str] = (), features: list[str] = FEATURES,
                    vector_col: str | None = None) -> DataFrame:
    """PRJ6: the six feature columns by name (optionally as an ML vector)."""
    out = df.select(*keep, *features)
    if vector_col:
        from pyspark.ml.feature import VectorAssembler
        out = VectorAssembler(inputCols=list(features), outputCol=vector_col, handleInvalid="keep").transform(out)
    return out


# --------------------------------------------------------------------- AGG --

def minmax_0_100(df: DataFrame, col: str = "score") -> DataFrame:
    """AGG10: (x - min) / (max - min) * 100 with this table's own range;
    null when max = min."""
    mn = df.select(F.min(col)).scalar()
    mx = df.select(F.max(col)).scalar()
    val = F.when(mx > mn, (F.col(col) - mn) / (mx - mn) * F.lit(100.0))
    return df.withColumn(col, val.cast("double"))


def system_scores(df: DataFrame, system: str = "system", score: str = "score", pred: str = "pred") -> DataFrame:
    """AGG11: mean score and mean prediction per system, divided by 10."""
    return df.groupBy(system).agg((F.avg(score) / 10).alias("score"), (F.avg(pred) / 10).alias("pred"))


def pearson(df: DataFrame, a: str = "pred", b: str = "score") -> DataFrame:
    """AGG12: Pearson correlation (one row); null when either side does not vary."""
    spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return df.agg((F.covar_pop(a, b) / spread).alias("pearson"))


def mse(df: DataFrame, y: str = "score", p: str = "prediction") -> DataFrame:
    """AGG13: mean squared error (one row)."""
    return df.agg(F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("mse"))


# ---------------------------------------------------------------------- ML --

def train_val_split(df: DataFrame, key: str = "id", seed: int = 42, val_fraction: float = 0.2):
    """ML1: deterministic hash split; the same rows in every engine and on every
    partitioning (``randomSplit`` depends on partitioning)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10)
    bucket = (h.cast("bigint") % 10000)
    flagged = df.withColumn("is_val", bucket < F.lit(int(round(val_fraction * 10000))))
    return flagged.filter(~F.col("is_val")).drop("is_val"), flagged.filter(F.col("is_val")).drop("is_val")


def in_few_tasks(rows: DataFrame, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same rows over one task per ``per_task`` rows: boosting runs a job per
    level of each tree, so the time goes with the tasks of a job, not with the rows."""
    return rows.repartition(max(1, -(-rows.count() // per_task)))


def training_rows(assembled: DataFrame, label: str = "score") -> DataFrame:
    """``(features, label)`` of the labelled rows, checkpointed: each of the jobs sends and
    unpacks the whole lineage of its rows, which costs more than passing over them."""
    spark = assembled.sparkSession
    ensure_checkpoint_dir(spark)
    rows = assembled.filter(F.col(label).isNotNull()).select("features", label)
    # No more tasks than run at once: each tree's jobs start them all anew.
    at_once = -(-rows.count() // spark.sparkContext.defaultParallelism)
    return in_few_tasks(rows, max(ROWS_PER_TASK, min(MOST_PER_TASK, at_once))).checkpoint()


def fit_gbt(train: DataFrame, label: str = "score", features: list[str] = FEATURES, max_iter: int = 500,
            max_depth: int = 7, step_size: float = 0.1, seed: int = 42):
    """ML2: gradient-boosted trees (reference config: 500 trees, depth 7, rate 0.1, seed 42).
    Up to ``ONE_TASK_ROWS`` rows are trained in one task, more of them by Spark's jobs."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                       stepSize=step_size, seed=seed)
    rows = training_rows(va.transform(train), label)
    small = 0 < rows.count() <= boosting.ONE_TASK_ROWS
    return PipelineModel([va, boosting.fit_in_one_task(rows, gbt, len(features)) if small else gbt.fit(rows)])


def predict(model, df: DataFrame) -> DataFrame:
    """ML3."""
    return model.transform(df).drop("features")


def feature_importances(model, features: list[str] = FEATURES, spark=None) -> DataFrame:
    """ML4: one row per feature (driver-side list of six numbers)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = spark or __import__("pyspark").sql.SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def evaluate_systems(test_pred: DataFrame, system: str = "system", score: str = "score",
                     pred: str = "prediction") -> DataFrame:
    """ML5 tail: system means (AGG11) -> Pearson (AGG12), plus test MSE (AGG13)."""
    sys_means = system_scores(test_pred, system, score, pred)
    corr = pearson(sys_means, "pred", "score")
    return corr.select("pearson", mse(test_pred, score, pred).select("mse").scalar().alias("mse"))


# ------------------------------------------------------------ SET / TOP ----

def union_batches(batches: list[DataFrame]) -> DataFrame:
    """SET1: append batch results (columns matched by name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def preview(df: DataFrame, order_col: str = "id", n: int = 5) -> DataFrame:
    """TOP1: first rows in key order (a top-k, not a full sort)."""
    return df.orderBy(order_col).limit(n)
