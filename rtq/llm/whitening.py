"""Embedding whitening (operator 12): QDWH spectral divide and conquer.

1. Two passes over the table give the exact sums and the exact covariance of the
   integer vectors x = floor(64 c) + 1000000.  Tasks multiply vectors that are
   centred on the whole number next to the mean; products are summed as whole
   numbers, so the result does not depend on how rows were dealt.  What leaves a
   task is dimension x dimension numbers, whatever its rows.
2. The driver splits the covariance (dimension x dimension): the polar factor of
   the matrix less a shift, by the QR-based dynamically weighted Halley
   iteration, is the sign of its spectrum; (U + I) / 2 and (I - U) / 2 project on
   the invariant subspaces above and below the shift, each of which is split
   again until it is a line: one component.
3. The components (at most ``COMPONENTS`` x dimension numbers) go to every task,
   which projects its rows.  A last pass measures the covariance of the result.

Defined cases: a null or empty vector, or one with a null or non-finite entry, is
dropped; if lengths differ, the most frequent counts (the longer of two) and the
others are dropped; entries beyond 2^56 count as 2^56; components without
variance (numerical rank) cannot be scaled and are left out, so a table of equal
vectors gives no rows; equal variances leave the basis of their subspace open;
repeated rows are whitened one by one; a deviation that no long can hold is null;
an empty table gives no rows; other columns are kept, ``deviation`` and
``whitened`` replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from rtq.llm.queries import register, table

COMPONENTS = 32
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0 ** 62
#: Entries handled at once in a task.
SLICE = 1 << 21
#: Whole numbers below this are exact in a double.
EXACT = 2 ** 53


class Moments(NamedTuple):
    dim: int
    n: int
    sums: list[int]
    centre: list[int]  # the whole number next to each mean
    covariance: np.ndarray

    @property
    def rest(self) -> list[int]:
        """n times the distance of each mean from its centre."""
        return [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]


class Whitening(NamedTuple):
    moments: Moments
    variances: np.ndarray  # falling
    components: np.ndarray  # component x dimension
    explained: np.ndarray


# --- vectors of a batch -------------------------------------------------------

def _integers(column: pa.ListArray, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) of the valid vectors, one dimension at a time, in slices."""
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    size[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    for d in np.unique(size) if dim is None else [dim]:
        rows = np.flatnonzero(size == d)
        if d == 0:
            continue
        step = max(1, SLICE // int(d))
        for a in range(0, len(rows), step):
            part = rows[a: a + step]
            c = values[offsets[part][:, None] + np.arange(d)]
            good = np.isfinite(c).all(axis=1)
            if good.any():
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(SCALE * c[good]), -LARGEST, LARGEST)
                yield part[good], whole.astype(np.int64) + SHIFT


def _total(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    high, low = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)
    return [(int(h) << 31) + int(w) for h, w in zip(high, low, strict=True)]


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y'y as Python integers; doubles do while every sum stays below 2^53."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


# --- exact moments ------------------------------------------------------------

def _vectors(frame: DataFrame, column: str) -> DataFrame:
    return frame.select(F.col(column).cast("array<double>").alias("v"))


_SUMS = "dim int, i int, n long, s decimal(38,0)"
_ROWS = "i int, v array<decimal(38,0)>"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for rows, x in _integers(batch.column("v")):
            n, s = total.get(x.shape[1], (0, [0] * x.shape[1]))
            total[x.shape[1]] = n + len(rows), [a + b for a, b in zip(s, _total(x), strict=True)]
    out = [(d, i, n, Decimal(v)) for d, (n, s) in total.items() for i, v in enumerate(s)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["dim", "i", "n", "s"])


def _matrix_rows(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    values = pa.array([[Decimal(int(x)) for x in r] for r in rows.values()], pa.list_(pa.decimal128(38, 0)))
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), values], ["i", "v"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums equal rows of the partial matrices as they stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
            v = np.array([int(x) for x in v], object)
            total[i] = total[i] + v if i in total else v
    yield _matrix_rows(total)


def moments(frame: DataFrame, column: str = "embedding") -> Moments | None:
    """Count, sums and covariance of all valid vectors (None without any)."""
    vectors = _vectors(frame, column)
    sums = vectors.mapInArrow(_sums, _SUMS).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by: dict[int, list] = {}
    for r in sums.collect():  # one row per dimension
        by.setdefault(r["dim"], []).append(r)
    if not by:
        return None
    dim = max(by, key=lambda d: (by[d][0]["n"], d))
    n = by[dim][0]["n"]
    s = [int(r["s"]) for r in sorted(by[dim], key=lambda r: r["i"])]
    centre = [(2 * v + n) // (2 * n) for v in s]
    middle = np.array(centre, np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for batch in batches:
            for _, x in _integers(batch.column("v"), dim):
                total = total + _products(x - middle)
        yield _matrix_rows(dict(enumerate(total)))

    got = vectors.mapInArrow(partial, _ROWS).repartition("i").mapInArrow(_add_rows, _ROWS).collect()  # dimension rows
    gram = np.empty((dim, dim), object)
    for r in got:
        gram[r["i"]] = [int(x) for x in r["v"]]
    rest = np.array([v - n * c for v, c in zip(s, centre, strict=True)], object)
    exact = n * gram - np.outer(rest, rest)  # n^2 times the covariance
    covariance = np.array([[float(Fraction(int(x), n * n)) for x in row] for row in exact])
    return Moments(dim, n, s, centre, covariance)


# --- spectral divide and conquer ----------------------------------------------

def polar(h: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix: the sign of its spectrum.

    QDWH: X <- X (a I + b X'X) (I + c X'X)^-1, the weights following a lower bound
    of the least singular value, evaluated by a QR factorisation of [sqrt(c) X; I].
    """
    n = len(h)
    x = h / np.linalg.norm(h)
    low, eye = 1e-16, np.eye(n)
    for _ in range(20):
        d = np.cbrt(4 * (1 - low * low) / low ** 4)
        a = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (a + b * low * low) / (1 + c * low * low))
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 1e-15 and moved < 1e-12 * np.sqrt(n):
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    q, _ = np.linalg.qr(projector @ rng.standard_normal((len(projector), rank)))
    return np.linalg.qr(projector @ q)[0]


def _split(a: np.ndarray, floor: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, or None if the spectrum is one point."""
    n = len(a)
    if np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= floor:
        return None
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    shift = float(np.median(np.diag(a)))
    best = None
    for _ in range(80):
        u = polar(a - shift * np.eye(n))
        trace = (np.trace(u) + n) / 2
        rank = round(trace)
        if rank <= 0:
            high = shift
        elif rank >= n:
            low = shift
        elif abs(trace - rank) < 1e-6:
            above, below = _basis((u + np.eye(n)) / 2, rank, rng), _basis((np.eye(n) - u) / 2, n - rank, rng)
            q, _ = np.linalg.qr(np.hstack([above, below]))
            above, below = q[:, :rank], q[:, rank:]
            left = np.linalg.norm(above.T @ a @ below)
            if best is None or left < best[0]:
                best = left, above, below
            if left <= floor:
                break
            shift += (high - low) * 1e-3 * rng.uniform(0.1, 1)  # too close to an eigenvalue
            continue
        shift = low + (high - low) * rng.uniform(0.4, 0.6)
    return best and best[1:]


def eigen(a: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as rows) of a symmetric matrix."""
    n = len(a)
    floor = 32 * n * np.finfo(float).eps * max(np.linalg.norm(a), 1e-300)
    rng, todo, done = np.random.default_rng(seed), [(a, np.eye(n))], []
    while todo:
        part, basis = todo.pop()
        halves = _split(part, floor, rng) if len(part) > 1 else None
        if halves is None:
            done.extend(basis.T)
            continue
        for half in halves:
            inner = half.T @ part @ half
            todo.append(((inner + inner.T) / 2, basis @ half))
    vectors = np.array(done)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    values = np.einsum("ij,jk,ik->i", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[order]
    vectors *= np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])[:, None]
    return values[order], vectors


def fit(frame: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of all valid vectors; None without any."""
    found = moments(frame, column)
    if found is None:
        return None
    values, vectors = eigen(found.covariance)
    rank = int((values > 64 * found.dim * np.finfo(float).eps * max(values[0], 0)).sum()) if values[0] > 0 else 0
    keep = min(components, rank)
    share = values / np.trace(found.covariance) if rank else values
    return Whitening(found, values[:keep], vectors[:keep], share[:keep])


# --- whitening ----------------------------------------------------------------

def _project(x: np.ndarray, model: Whitening) -> np.ndarray:
    m = model.moments
    rest = np.array([float(Fraction(r, m.n)) for r in m.rest])
    z = (x - np.array(m.centre, np.int64)).astype(np.float64) - rest
    return z @ model.components.T / np.sqrt(model.variances)


def _deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    y, rest = x - np.array(m.centre, np.int64), m.rest
    top = m.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
    if top * top * m.dim < 2 ** 63:
        return ((m.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((m.n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def whiten(frame: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """Rows with a valid vector, ``deviation`` (sum of (n x - S)^2) and ``whitened`` (one entry per component)."""
    keep = [f for f in frame.schema.fields if f.name not in ("deviation", "whitened")]
    schema = StructType([*keep, StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    inner = [f"c{i}" for i in range(len(keep))]
    source = frame.select(*(F.col(f"`{f.name}`").alias(c) for f, c in zip(keep, inner, strict=True)),
                          F.col(column).cast("array<double>").alias("v"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _integers(batch.column("v"), model.moments.dim):
                w = _project(x, model)
                offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)) if w.shape[1] else pa.array(np.zeros(len(w) + 1, np.int32))
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(c) for c in inner] + [pa.array(_deviations(x, model.moments), pa.int64()),
                                                        pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))],
                    [*inner, "deviation", "whitened"])

    flat = StructType([*(StructField(c, f.dataType) for f, c in zip(keep, inner, strict=True)), *schema.fields[len(keep):]])
    out = source.mapInArrow(apply, flat)
    return out.select(*(F.col(c).alias(f.name) for f, c in zip(keep, inner, strict=True)), "deviation", "whitened")


def identity_error(frame: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """Largest entry of the whitened vectors' covariance less the identity, measured
    over the table; tasks send sums of components x components numbers."""
    k = len(model.variances)
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, total_2 = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _integers(batch.column("v"), model.moments.dim):
                w = _project(x, model)
                total += w.sum(axis=0)
                total_2 += w.T @ w
        values = [total.tolist(), *total_2.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(values, pa.list_(pa.float64()))], ["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
                total[i] = total.get(i, 0.0) + np.array(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["i", "v"])

    parts = _vectors(frame, column).mapInArrow(partial, "i int, v array<double>").withColumn("task", F.spark_partition_id())
    parts = parts.repartition("i").sortWithinPartitions("i", "task").select("i", "v")
    got = {r["i"]: np.array(r["v"]) for r in parts.mapInArrow(add, "i int, v array<double>").collect()}  # components + 1 rows
    mean = got[0] / model.moments.n
    second = np.array([got[i + 1] for i in range(k)]) / model.moments.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@register("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], _RESULT)
    error = identity_error(vectors, model)
    out = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(v)) for v in model.explained))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.moments.n).cast("long").alias("n"),
                      "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
