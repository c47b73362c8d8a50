"""Operator 12 against whole-number brute force and a library eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rtq.llm import whitening
from rtq.llm.queries import QUERIES

from conftest import SF001

KEY = "op12_embedding_whitening"


def brute(rows):
    """(id, vector) rows to (id, component) -> (n, deviation, |whitened|, explained)."""
    keep = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(keep), len(keep[0][1])
    s = [sum(x[j] for _, x in keep) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(d)] for _, x in keep])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, x), z in zip(keep, centred, strict=True):
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        for k in range(min(32, d)):
            if values[k] > 1e-9 * values[0]:
                out.setdefault((i, k + 1), []).append((n, dev, abs(z @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def check(got, want):
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, dev, white, share = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(abs(r.whitened) - white) < 1e-7 * max(1, white) and abs(r.explained - share) < 1e-9
        assert r.identity_error < 1e-9


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES[KEY](spark, SF001).collect()
    check(got, brute(rows))
    signs = {}
    for r in got:  # one sign for all rows: whitened columns have mean zero
        signs.setdefault(r.component, []).append(r.whitened)
    assert all(abs(sum(v)) < 1e-6 * len(v) for v in signs.values())


def query(spark, rows, monkeypatch, kind="array<double>"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumns({c: F.lit(1) for c in ("v", "i", "whitened", "deviation", "c0")})
    monkeypatch.setattr(whitening, "table", lambda *a: frame)
    return QUERIES[KEY](spark, "").collect()


def test_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [1.0, None, 2.0]), (3, [nan, 0.0, 0.0]), (4, [0.0, inf, 0.0]), (5, [1.0, 2.0]), (None, [0.5, -3.25, 7.0]),
            (6, [0.5, -3.25, 7.0]), (6, [0.5, -3.25, 7.0]), (7, [100.0, 2.0, -1.0]), (8, [3.0, 3.0, 3.0]), (9, [-90.0, 40.0, 0.01])]
    check(query(spark, rows, monkeypatch), brute([r for r in rows if r[0] != 5]))


def test_no_variance_or_no_rows(spark, monkeypatch):
    assert query(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], monkeypatch) == []
    assert query(spark, [(1, None)], monkeypatch) == []
    assert query(spark, [], monkeypatch) == []


def test_large_entries_stay_whole(spark, monkeypatch):
    rows = [(i, [float(i) * 2 ** 30, float(i * i), 1.0 / (i + 1)]) for i in range(6)]
    got = query(spark, rows, monkeypatch)
    want = brute(rows)
    for r in got:
        n, dev, _, _ = want[r.vec_id, r.component][0]
        assert r.n == n and r.deviation == (dev if dev < 2 ** 63 else None)
    beyond = query(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0])], monkeypatch)
    assert {r.deviation for r in beyond} == {None}


def test_extra_columns_stay(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 3.0], "b")], "v long, embedding array<double>, c0 string")
    out = whitening.whiten(frame, whitening.fit(frame))
    assert out.columns == ["v", "embedding", "c0", "deviation", "whitened"]
    assert sorted((r.v, r.c0) for r in out.collect()) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("spectrum", [range(1, 41), [5.0] * 10 + [1.0] * 10, [10.0 ** -k for k in range(16)], [1.0, 1.0 + 1e-9, 2.0], [0.0] * 5 + [1.0]])
def test_divide_and_conquer(spectrum):
    rng = np.random.default_rng(1)
    values = np.sort(np.array(list(spectrum), float))[::-1]
    q, _ = np.linalg.qr(rng.standard_normal((len(values),) * 2))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.eigen(a)
    assert np.abs(got - values).max() < 1e-13 * values[0] * len(values)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(vectors @ a - got[:, None] * vectors).max() < 1e-12 * values[0]
