"""Metric index for near-identical vectors against the full product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rtq.functions import vectors as V
from rtq.operators import align as A

SCHEMA = "cls long, embedding array<double>"


def brute(rows):
    kept = [(c, np.array(v, float)) for c, v in rows if v is not None and np.all(np.isfinite(np.array(v, float))) and np.linalg.norm(v) > 0]
    u = np.array([v / np.linalg.norm(v) for _, v in kept])
    near = u @ u.T > 0.999
    return {(kept[i][0], kept[j][0]) for i in range(len(kept)) for j in range(len(kept)) if near[i, j]}


def clustered(seed, n, dim):
    """Random vectors, near and equal copies of some, and all of one cell of raw coordinates."""
    g = np.random.default_rng(seed)
    base = g.normal(size=(n, dim))
    base[: n // 3, :3] = 5.0
    near = base[::4] * g.uniform(0.5, 2, size=(len(base[::4]), 1)) + g.normal(scale=0.02, size=base[::4].shape)
    rows = [*base, *near, *base[::7]]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("seed,n,dim", [(1, 120, 16), (2, 60, 3), (3, 5, 64)])
def test_index_equals_product(spark, seed, n, dim):
    rows = clustered(seed, n, dim)
    got = V.near_identical_classes(spark.createDataFrame(rows, SCHEMA)).select("a", "b").collect()
    assert len(got) == len(set(got))
    assert {(r.a, r.b) for r in got} == brute(rows)


def test_odd_vectors_have_no_class(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [-1.0, -0.0]), (7, [1.0, None])]
    got = V.near_identical_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.a, r.b) for r in got} == {(1, 1), (1, 5), (5, 1), (5, 5), (6, 6)}
    assert V.near_identical_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_vectors_are_not_expanded(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000, [3.0, -1.0, 0.5])]
    members, compared = V.near_identical_index(spark.createDataFrame(rows, SCHEMA))
    assert members.filter("rep = 0").count() == 300 and compared.count() == 0
    assert V.near_identical_halves(members, compared).count() == 301


def test_tokens_match_through_representatives(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.01, 1.0])], SCHEMA)
    units = spark.createDataFrame([(9, "src", 0, "x", 1), (9, "src", 1, "y", 3), (9, "src", 2, "z", None),
                                   (9, "trg", 0, "x", 2), (9, "trg", 1, "y", 4), (9, "trg", 2, "z", None)],
                                  "pair_id long, side string, pos int, piece string, cls long")
    got = A.near_identical_tokens(units, vec)
    given = A.near_identical_tokens(units, vec, ni=V.near_identical_classes(vec))
    assert {(r.i, r.j) for r in got.collect()} == {(0, 0), (1, 1)} == {(r.i, r.j) for r in given.select(F.col("i"), F.col("j")).collect()}


def test_far_pivots_are_not_kept(spark):
    rng = np.random.default_rng(3)
    units = rng.normal(size=(900, 3))
    units /= np.linalg.norm(units, axis=1)[:, None]
    reps = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(units)], "rep long, unit array<double>")
    got = V._near_pivots(reps, 1024, 0.1).collect()
    assert len(got) == 900 and all(r._home in r._near and len(r._guards) == V.GUARDS for r in got)
    assert all(r._least <= d <= r._least + 0.1 for r in got for d in r._at)
    assert sum(len(r._near) for r in got) < 900 * 8  # of 30 pivots each
