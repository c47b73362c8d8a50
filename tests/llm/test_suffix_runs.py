"""Operator 11 against all windows in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rtq.llm import suffix_runs
from rtq.llm.queries import QUERIES
from rtq.llm.suffix_runs import Run, Shape, decide, dedupe, merged

from conftest import SF001

KEY = "op11_suffix_dedup"
SMALL = Shape(12, 4)


def brute(texts, window):
    """Per text: (bytes, removed, spans, digest)"""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i: i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i: i + window]] > 1:
                gone[i: i + window] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        out.append((len(d), int(gone.sum()), len(edge), hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def result(frame):
    return sorted((r[0], len((r.text or "").encode()), sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                  for r in frame.collect())


def expected(rows, window):
    return sorted((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], window), strict=True))


def mixed(rng, n, letters="ab"):
    """Texts pasted from a few pieces, so repeats of all lengths and overlaps occur."""
    pieces = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(6)]
    return [(i, "".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choices(letters + "cdé", k=rng.randint(1, 9)))
                        for _ in range(rng.randint(0, 6)))) for i in range(n)]


def test_merge_keeps_order_and_lcp():
    rng = np.random.default_rng(3)
    width, runs, every = 16, [], []
    for base in range(0, 700, 100):
        ctx = rng.integers(0, 2, (100, width)).astype(np.uint8)
        ctx[:, :4] = 7
        every += [bytes(r) for r in ctx]
        out = suffix_runs._front_coded(ctx, np.zeros(100, np.int64), *(np.zeros(100, np.int64),) * 2, np.zeros(100, np.int32))
        assert out.num_rows == 1
        runs.append(Run(width, out.column("lcp")[0].as_py(), out.column("rest")[0].as_py(), base))
    got = list(merged(runs))
    assert sorted(set(every)) == sorted({c for c, _, _ in got}) and [c for c, _, _ in got] == sorted(c for c, _, _ in got)
    for (a, _, _), (b, known, _) in zip(got, got[1:]):
        assert known == next((i for i in range(width) if a[i] != b[i]), width)


@pytest.mark.parametrize("seed", range(30))
def test_decide_is_all_pairs(seed):
    rng, shape = random.Random(seed), SMALL
    group = set()
    for _ in range(rng.randint(1, 25)):
        r, left = rng.randint(shape.gram, shape.window), rng.randint(0, shape.left)
        right = ("xxxx" + "".join(rng.choices("ab", k=shape.window)))[:r]
        group.add((right.encode().ljust(shape.window, b"\xff") + "".join(rng.choices("ab", k=left)).encode().ljust(shape.left, b"\xff")))
    ctx = sorted(group)

    def common(a, b):
        return next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))

    lcp = [0] + [common(a, b) for a, b in zip(ctx, ctx[1:])]
    twice = [rng.random() < 0.1 for _ in ctx]
    parts = [(c[shape.window:].rstrip(b"\xff"), c[:shape.window].rstrip(b"\xff")) for c in ctx]
    want = []
    for i, (left, right) in enumerate(parts):
        found = [(common(left, x), common(right, y)) for j, (x, y) in enumerate(parts) if j != i]
        found = [f for f in found if sum(f) >= shape.window] + ([(len(left), len(right))] if twice[i] else [])
        want.append((max((f[0] for f in found), default=0), max((f[1] for f in found), default=0)))
    assert decide(ctx, lcp, twice, shape) == want


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES[KEY](spark, SF001).collect())
    assert got == expected(rows, 200)


@pytest.mark.parametrize("dense,hot,bucket", [(10_000, 200_000, 40_000), (1, 200_000, 40_000), (10_000, 0, 40_000), (3, 20, 5)])
def test_small_windows(spark, monkeypatch, dense, hot, bucket):
    """Repeats of every kind; the same with frequent contexts kept back, with all
    grams as windows, and with few anchors to a bucket."""
    rng = random.Random(dense + hot)
    rows = mixed(rng, 150) + [(1000, "a" * 300), (1001, "ab" * 100), (1002, "é" * 40)]
    monkeypatch.setattr(suffix_runs, "DENSE", dense)
    monkeypatch.setattr(suffix_runs, "HOT", hot)
    monkeypatch.setattr(suffix_runs, "BUCKET", bucket)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(dedupe(frame, shape=SMALL)) == expected(rows, 12)


def test_pieces_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    whole = [np.concatenate(c) for c in zip(*suffix_runs.anchors(data, np.array([0, 1700, 1700, 5000]), SMALL), strict=True)]
    monkeypatch.setattr(suffix_runs, "PIECE", 100)
    cut = [np.concatenate(c) for c in zip(*suffix_runs.anchors(data, np.array([0, 1700, 1700, 5000]), SMALL), strict=True)]
    for found in (whole, cut):  # each window start belongs to one anchor
        starts = np.concatenate([np.arange(p - a, p + b - 12 + 1) for p, a, b in zip(*found[1:4], strict=True)])
        assert sorted(starts.tolist()) == [s for s in range(5000 - 11) if s + 12 <= 1700 or s >= 1700]


def test_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=30_000))
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 199), (4, "x" * 199), (5, "y" * 200), (6, "z" * 201), (7, long), (8, "q" + long[5000:5300]),
            (None, long[:250]), (None, long[:250]), (9, "copy " * 60), (9, "copy " * 60), (10, "é" * 100), (11, "é" * 100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    extra = frame.withColumns({c: F.lit("clash") for c in ("u1", "u2", "found", "spans", "kept", "c0", "h")})
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    out = dedupe(extra)
    assert out.columns == ["doc_id", "text", "u1", "u2", "found", "c0", "h", "spans", "kept"] and {r.u1 for r in out.collect()} == {"clash"}
    got = [(r.doc_id, len((r.text or "").encode()), sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in out.collect()]
    want = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 200), strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert dedupe(frame.limit(0)).count() == 0
