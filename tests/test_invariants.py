"""Invariants: importances, min-max edge cases, metamorphic features."""

import pytest
from pyspark.sql import functions as F

from rtq.operators import scoring as S
from rtq.plans.q_features import same_position_features

from conftest import SF001


def test_minmax_constant_gives_null(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id long, score double")
    assert [r.score for r in S.minmax_0_100(df).collect()] == [None, None]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(1, -2.0), (2, None), (3, 4.0)], "id long, score double")
    assert [r.score for r in S.clamp_score(df).orderBy("id").collect()] == [0.0, None, 4.0]


def test_importances_sum_to_one(spark):
    rows = [(i, f"s{i % 3}", float(i % 7), *[float((i * (k + 3)) % 11) for k in range(6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, system string, score double, " + ", ".join(f"{f} double" for f in S.FEATURES))
    m = S.fit_gbt(df, max_iter=5, max_depth=3)
    imp = S.feature_importances(m, spark=spark).collect()
    assert len(imp) == 6 and sum(r.importance for r in imp) == pytest.approx(1.0)


def test_identical_texts_give_zero_features(spark):
    segs = spark.createDataFrame([(1, "en-de", "The cat sat on the mat", "The cat sat on the mat")],
                                 "pair_id long, lp string, src string, trg string")
    out = same_position_features(spark, SF001, segs).first()
    assert [out[f] for f in S.FEATURES] == [0.0] * 6


def test_assign_batches_consecutive(spark):
    df = spark.range(0, 1234).withColumnRenamed("id", "id")
    b = S.assign_batches(df, 100, "id", num_partitions=7)
    bad = b.filter(F.col("batch_no") != F.floor(F.col("id") / 100)).count()
    assert bad == 0
