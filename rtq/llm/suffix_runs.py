"""Suffix-array dedup (operator 11): sorted suffix runs, front-coded, merged by
loser trees that know common prefixes.

Every byte is removed that a 200-byte string covers which also starts anywhere
else, in the same document or another.

1. Suffixes to sort.  Of the 64-byte grams of a window of 200 bytes the leftmost
   one of least hash is its anchor, so equal windows have anchors at equal
   offsets.  About one suffix in seventy is an anchor.  Its context is what its
   windows span: up to 200 bytes to the right, up to 136 to the left.  Anchors
   whose gram occurs nowhere else cannot lie in a repeated window and end here.
2. Runs.  A task sorts the contexts it holds (right part, then the left part read
   backwards), keeps equal ones once with the list of their places, front-codes
   each against its predecessor and deals the runs by the hash of the gram.
3. Merge.  A bucket's runs meet in a loser tree.  Every head carries the prefix
   length it shares with the last string put out; the longer one wins unseen and
   only equal ones are compared, from that length on.  The merged order comes
   with its LCP array.
4. Decision.  Anchors of one gram are joined along falling LCP; a set is a list in
   order of the left parts, the smaller is put into the larger, and new
   neighbours give the longest left match for the right match at hand.  Left plus
   right of 200 or more is a repeated string.  That takes g log g steps.
5. Bounds.  A context that occurs over ``DENSE`` times is known to repeat (gram and
   context hash, 128 bits): one of its places stands for it in the sort, the others
   are not dealt.  A gram with over ``HOT`` dealt places does not go to one task:
   its windows, 128-bit fingerprints, are counted by a plain aggregation instead.
   So no task holds more than ``HOT`` places of a gram, however frequent it is.

Texts are dealt by key once; runs and result read the same exchange.

Defined cases: a null text is empty; texts under 200 bytes have no window; a
repeated row repeats its text, so all its windows are removed, and so are those
of copies; a run of one character repeats itself; a null doc_id is a key like
any other; a very long text is read in pieces; an empty table gives no rows;
``dedupe`` keeps other columns, ``spans`` and ``kept`` replace those of the name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from rtq.llm.queries import register, table
from rtq.llm.words import U64, _INV, _ODD, buffers, mix, slices
from rtq.session import cut_lineage

#: Places of one context, and of one gram, that are dealt to a task at most.
DENSE, HOT = 10_000, 200_000
#: Contexts that hold over 1/MOST of all anchors, so fewer than MOST, are looked up by a broadcast.
MOST = 1000
#: Anchors of a bucket (on average) and of a sorted run; window starts hashed together.
BUCKET, RUN, PIECE = 40_000, 32_768, 1 << 19
#: Ends a context; no byte of UTF-8.
END = 0xFF

_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_BYTE_2 = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_WEIGHT = np.random.default_rng(12).integers(1, 1 << 63, 4096, dtype=np.int64).astype(U64) | U64(1)


class Shape(NamedTuple):
    window: int = 200
    gram: int = 64  # a power of two

    @property
    def left(self) -> int:
        return self.window - self.gram

    @property
    def width(self) -> int:
        return self.window + self.left


# --- anchors ------------------------------------------------------------------

def _grams(data: np.ndarray, k: int) -> np.ndarray:
    h, n = _BYTE[data], 1
    while n < k:
        more = h[n:]
        h = h[:-n] * U64(pow(_ODD, n, 1 << 64))
        h += more
        n *= 2
    return mix(h)


def _least(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of every ``width`` neighbours and where it stands first."""
    at, n = np.arange(len(g), dtype=np.int32), 1
    while n < width:
        step = min(n, width - n)
        right = g[step:] < g[:-step]
        at = np.where(right, at[step:], at[:-step])
        g = np.minimum(g[step:], g[:-step])
        n += step
    return g, at


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = np.full(n, _ODD, U64), np.full(n, _INV, U64)
    power[0] = inverse[0] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def _sums(value: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any run of bytes."""
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(value * power[:len(value)], out=total[1:])
    return total


def anchors(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place, bytes to the left, bytes to the right, gram hash, context hash) of
    all anchors of rows laid end to end, a piece at a time."""
    last = int(offsets[-1]) - shape.window
    power, inverse = _powers(PIECE + shape.window)
    for c in range(int(offsets[0]), last + 1, PIECE):
        part = data[c: min(c + PIECE, last + 1) + shape.window - 1]
        g = _grams(part, shape.gram)
        _, at = _least(g, shape.window - shape.gram + 1)
        change = np.empty(len(at), bool)
        change[0] = True
        np.not_equal(at[1:], at[:-1], out=change[1:])
        cut = offsets[(offsets > c) & (offsets < c + len(at))] - c
        change[cut] = True
        a = np.flatnonzero(change)
        b = np.append(a[1:], len(at)) - 1
        row = np.searchsorted(offsets, a + c, "right") - 1
        b = np.minimum(b, offsets[row + 1] - c - shape.window)
        good = a <= b
        a, b, row, p = a[good], b[good], row[good], at[a[good]].astype(np.int64)
        total = _sums(_BYTE[part], power)
        whole = (total[b + shape.window] - total[a]) * inverse[a]
        yield row, p + c, p - a, b + shape.window - p, g[p], mix(whole ^ mix(((p - a) << 20 | (b - a)).astype(U64)))


_ANCHORS = "h long, ctx long, u1 long, u2 long, pos int, l short, r short"


def _anchor_rows(shape: Shape):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            u1, u2 = batch.column("u1").to_numpy(), batch.column("u2").to_numpy()
            for a, b in slices(offsets, 1 << 22):
                off = offsets[a: b + 1]
                for row, p, left, right, h, ctx in anchors(data, off, shape):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(u1[a + row]), pa.array(u2[a + row]),
                         pa.array((p - off[row]).astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))],
                        ["h", "ctx", "u1", "u2", "pos", "l", "r"])
    return apply


# --- sorted runs ----------------------------------------------------------------

def _contexts(data: np.ndarray, p: np.ndarray, left: np.ndarray, right: np.ndarray, shape: Shape) -> np.ndarray:
    """One row per anchor: right part, then the left part backwards, both padded."""
    wide = np.lib.stride_tricks.sliding_window_view
    padded = np.concatenate([np.full(shape.left, END, np.uint8), data, np.full(shape.window, END, np.uint8)])
    out = np.empty((len(p), shape.width), np.uint8)
    out[:, :shape.window] = wide(padded, shape.window)[p + shape.left]
    out[:, shape.window:] = wide(padded, shape.left)[p][:, ::-1]
    out[:, :shape.window][np.arange(shape.window) >= right[:, None]] = END
    out[:, shape.window:][np.arange(shape.left) >= left[:, None]] = END
    return out


_RUNS = "bucket long, lcp binary, rest binary, n binary, u1 binary, u2 binary, pos binary"


def _front_coded(ctx: np.ndarray, bucket: np.ndarray, u1: np.ndarray, u2: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Sorts one run and cuts it by bucket; each piece starts with a whole context."""
    width = ctx.shape[1]
    order = np.argsort(np.ascontiguousarray(ctx).view(f"S{width}").ravel(), kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    ctx, bucket = ctx[order], bucket[order]
    differ = ctx[1:] != ctx[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.concatenate([[0], lcp]).astype(np.int64)
    head = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    lcp[head] = 0
    first = np.flatnonzero(lcp < width)  # of equal contexts
    lcp, n = lcp[first], np.diff(np.append(first, len(ctx)))
    rest = ctx[first][np.arange(width) >= lcp[:, None]]
    rest_at = np.concatenate([[0], np.cumsum(width - lcp)])
    piece = np.flatnonzero(head[first])
    piece_end = np.append(piece[1:], len(first))
    place = np.append(first, len(ctx))
    u1, u2, pos = u1[order], u2[order], pos[order]
    rows: list[list] = [[] for _ in range(7)]
    for a, b in zip(piece, piece_end, strict=True):
        x, y = place[a], place[b]
        for out, value in zip(rows, (int(bucket[x]), lcp[a:b].astype(np.int16).tobytes(), rest[rest_at[a]: rest_at[b]].tobytes(),
                                     n[a:b].astype(np.int32).tobytes(), u1[x:y].tobytes(), u2[x:y].tobytes(), pos[x:y].tobytes()), strict=True):
            out.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])],
                                      ["bucket", "lcp", "rest", "n", "u1", "u2", "pos"])


def _spread(prefix: np.ndarray, buckets: int) -> np.ndarray:
    weighted = (prefix.astype(U64) * _WEIGHT[: prefix.shape[1]]).sum(axis=1, dtype=U64)
    return (mix(weighted) % U64(buckets)).astype(np.int64)


class _Places(NamedTuple):
    """Chosen anchors of a batch of texts: row, place, bytes to the left and right."""
    owner: np.ndarray
    p: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _places(batch: pa.RecordBatch) -> _Places:
    found = batch.column("found")
    at = found.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    u2, pos, left, right = (found.values.field(i).to_numpy(zero_copy_only=False)[at[0]: at[-1]].astype(np.int64) for i in range(4))
    mine = u2 == batch.column("u2").to_numpy()[owner]
    return _Places(owner[mine], pos[mine], left[mine], right[mine])


def _run_rows(shape: Shape, buckets: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            u1, u2 = batch.column("u1").to_numpy(), batch.column("u2").to_numpy()
            places = _places(batch)
            start = np.searchsorted(places.owner, np.arange(batch.num_rows + 1))
            for a, b in slices(offsets, 1 << 22):
                for i in range(start[a], start[b], RUN):
                    o, p, left, right = (x[i: min(i + RUN, start[b])] for x in places)
                    ctx = _contexts(data[offsets[a]: offsets[b]], p + offsets[o] - offsets[a], left, right, shape)
                    held.append((ctx, _spread(ctx[:, :shape.gram], buckets), u1[o], u2[o], p.astype(np.int32)))
                    size += len(ctx)
                    if size >= RUN:
                        yield _front_coded(*(np.concatenate(c) for c in zip(*held, strict=True)))
                        held, size = [], 0
        if held:
            yield _front_coded(*(np.concatenate(c) for c in zip(*held, strict=True)))
    return apply


_WINDOWS = "w1 long, w2 long, u1 long, u2 long, lo int"


def _window_rows(shape: Shape):
    """Fingerprints of all windows of anchors, for grams that no one task may hold."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            u1, u2 = batch.column("u1").to_numpy(), batch.column("u2").to_numpy()
            places = _places(batch)
            start = np.searchsorted(places.owner, np.arange(batch.num_rows + 1))
            for row in np.unique(places.owner):
                o, p, left, right = (x[start[row]: start[row + 1]] for x in places)
                for i in range(0, len(o), RUN):
                    first, many = (p - left)[i: i + RUN], (left + right - shape.window + 1)[i: i + RUN]
                    lo = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    low, high = int(lo.min()), int(lo.max()) + shape.window
                    part = data[offsets[row] + low: offsets[row] + high]
                    power, inverse = _powers(len(part) + 1)
                    prints = []
                    for value in (_BYTE[part], _BYTE_2[part]):
                        total = _sums(value, power)
                        prints.append(mix((total[lo - low + shape.window] - total[lo - low]) * inverse[lo - low]).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, prints), pa.array(np.full(len(lo), u1[row])), pa.array(np.full(len(lo), u2[row])), pa.array(lo.astype(np.int32))],
                        ["w1", "w2", "u1", "u2", "lo"])
    return apply


# --- merge ----------------------------------------------------------------------

class Run:
    """A front-coded run, decoded one context at a time."""

    def __init__(self, width: int, lcp: bytes, rest: bytes, base: int):
        self.width, self.lcp, self.rest, self.base = width, np.frombuffer(lcp, np.int16).tolist(), rest, base
        self.i, self.at, self.head, self.known = -1, 0, b"", 0
        self.advance()

    def advance(self) -> None:
        self.i += 1
        if self.i == len(self.lcp):
            self.head, self.known = None, -1
            return
        self.known = self.lcp[self.i]
        end = self.at + self.width - self.known
        self.head = self.head[: self.known] + self.rest[self.at: end]
        self.at = end


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, int]]:
    """(context, prefix shared with the one before, index) in order.

    Losers wait in a tree.  ``known`` of a waiting head is the prefix it shares
    with the winner it lost to, which is the last context put out when it plays
    again; a head that shares more with that one precedes a head that shares less.
    """
    width = runs[0].width
    size = 1 << max(0, len(runs) - 1).bit_length()
    losers: list[Run | None] = [None] * size

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """(winner, loser)"""
        if b is None or b.head is None:
            return a, b
        if a is None or a.head is None:
            return b, a
        if a.known != b.known:
            return (a, b) if a.known > b.known else (b, a)
        k = a.known
        x, y = a.head[k:], b.head[k:]
        if x == y:
            b.known = width
            return a, b
        shared = width - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        if x < y:
            b.known = shared
            return a, b
        a.known = shared
        return b, a

    for run in runs:
        run.known = 0
    level: list[Run | None] = [*runs, *[None] * (size - len(runs))]
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            winner, losers[node + i // 2] = play(level[i], level[i + 1])
            up.append(winner)
        level = up
    best = level[0]
    leaf = {id(r): size + i for i, r in enumerate(runs)}
    while best is not None and best.head is not None:
        yield best.head, best.known, best.base + best.i
        node = leaf[id(best)] // 2
        best.advance()
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def decide(ctx: list[bytes], lcp: list[int], twice: list[bool], shape: Shape) -> list[tuple[int, int]]:
    """Of sorted different contexts of one gram: how far to the left and right of its
    anchor the repeated strings of each reach (0, 0: none).  ``lcp[i]`` is with the
    context before; ``twice`` marks contexts that occur more than once."""
    g, window = len(ctx), shape.window
    ends = [(len(c[window:].rstrip(b"\xff")), len(c[:window].rstrip(b"\xff"))) for c in ctx]
    reach = [e if t else (0, 0) for e, t in zip(ends, twice, strict=True)]
    if g == 1:
        return reach
    left = [int.from_bytes(c[window:], "big") for c in ctx]
    rank = [0] * g
    by_left = sorted(range(g), key=left.__getitem__)
    for k, i in enumerate(by_left):
        rank[i] = k

    def meet(p: int, q: int, right: int) -> None:
        shared = shape.left - ((left[p] ^ left[q]).bit_length() + 7) // 8
        shared, right = min(shared, ends[p][0], ends[q][0]), min(right, ends[p][1], ends[q][1])
        if shared + right >= window:
            reach[p] = max(reach[p][0], shared), max(reach[p][1], right)
            reach[q] = max(reach[q][0], shared), max(reach[q][1], right)

    owner = list(range(g))
    sets: dict[int, list[int]] = {i: [rank[i]] for i in range(g)}

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for i in sorted(range(1, g), key=lcp.__getitem__, reverse=True):
        a, b = find(i - 1), find(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets.pop(b)
        owner[b] = a
        right = min(lcp[i], window)
        for r in small:
            k = bisect_left(large, r)
            if k:
                meet(by_left[r], by_left[large[k - 1]], right)
            if k < len(large):
                meet(by_left[r], by_left[large[k]], right)
            large.insert(k, r)
    return reach


_SPANS = "u1 long, u2 long, lo int, hi int"


def _bucket_spans(rows: list[tuple], shape: Shape) -> pa.RecordBatch:
    """Merges a bucket's runs and names the repeated strings around its anchors."""
    runs, base = [], 0
    for lcp, rest, *_ in rows:
        runs.append(Run(shape.width, lcp, rest, base))
        base += len(runs[-1].lcp)
    n = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows]).astype(np.int64)
    members = n.tolist()
    u1, u2 = (np.concatenate([np.frombuffer(r[i], np.int64) for r in rows]) for i in (3, 4))
    pos = np.concatenate([np.frombuffer(r[5], np.int32) for r in rows])
    left, right = np.zeros(base, np.int32), np.zeros(base, np.int32)
    ctx: list[bytes] = []
    lcps: list[int] = []
    same: list[list[int]] = []

    def close() -> None:
        if len(ctx) > 1 or len(same[0]) > 1 or members[same[0][0]] > 1:
            twice = [len(s) > 1 or members[s[0]] > 1 for s in same]
            for (x, y), who in zip(decide(ctx, lcps, twice, shape), same, strict=True):
                if y:
                    left[who], right[who] = x, y

    for c, lcp, index in merged(runs):
        if lcp == shape.width:
            same[-1].append(index)
            continue
        if lcp < shape.gram and ctx:
            close()
            ctx, lcps, same = [], [], []
        ctx.append(c)
        lcps.append(lcp)
        same.append([index])
    close()
    left, right = np.repeat(left, n), np.repeat(right, n)
    hit = right > 0
    return pa.RecordBatch.from_arrays([pa.array(u1[hit]), pa.array(u2[hit]), pa.array((pos - left)[hit]), pa.array((pos + right)[hit])],
                                      ["u1", "u2", "lo", "hi"])


def _merge_rows(shape: Shape):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if b != bucket:
                    if rows:
                        yield _bucket_spans(rows, shape)
                    bucket, rows = b, []
                rows.append(row)
        if rows:
            yield _bucket_spans(rows, shape)
    return apply


# --- the operator -----------------------------------------------------------------

def repeated_spans(texts: DataFrame, dealt: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Spans (u1, u2, lo, hi; may overlap) of repeated strings around the anchors of
    ``texts`` (u1, u2, text, ...); ``dealt`` holds the same rows by u1."""
    found = cut_lineage(texts.select("u1", "u2", "text").mapInArrow(_anchor_rows(shape), _ANCHORS), "suffix-anchors")
    place = F.xxhash64("u1", "u2", "pos")
    kinds = found.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    dealt_places = F.sum(F.when(F.col("n") > DENSE, 1).otherwise(F.col("n")))
    grams = kinds.groupBy("h").agg(F.sum("n").alias("all"), dealt_places.alias("dealt")).where(F.col("all") > 1)
    shared = cut_lineage(kinds.join(grams, "h").select("h", "ctx", "n", "first", (F.col("dealt") > HOT).alias("hot")), "suffix-shared")

    total = found.count()
    many = F.broadcast(shared.where(F.col("n") * MOST > total))  # fewer than MOST rows
    on = ["h", "ctx"]
    repeats = found.join(many, on).unionByName(found.join(many, on, "left_anti").join(shared.where(F.col("n") * MOST <= total), on))
    repeats = repeats.withColumn("dense", F.col("n") > DENSE).withColumn("dealt", (F.col("n") <= DENSE) | (F.col("first") == place))
    repeats = cut_lineage(repeats.select("u1", "u2", "pos", "l", "r", "hot", "dense", "dealt"), "suffix-chosen")

    def with_places(rows: DataFrame) -> DataFrame:
        return dealt.join(rows.groupBy("u1").agg(F.collect_set(F.struct("u2", "pos", "l", "r")).alias("found")), "u1")

    sums = repeats.agg(F.count_if(F.expr("dealt and not hot")), F.count_if(F.expr("dealt and hot"))).first()
    runs = with_places(repeats.where("dealt and not hot")).mapInArrow(_run_rows(shape, max(1, -(-sums[0] // BUCKET))), _RUNS)
    spans = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge_rows(shape), _SPANS)
    known = repeats.where("dense").select("u1", "u2", (F.col("pos") - F.col("l")).cast("int").alias("lo"), (F.col("pos") + F.col("r")).cast("int").alias("hi"))
    spans = spans.unionByName(known)
    if sums[1]:
        windows = cut_lineage(with_places(repeats.where("dealt and hot")).mapInArrow(_window_rows(shape), _WINDOWS), "suffix-windows")
        twice = windows.groupBy("w1", "w2").count().where("count > 1").drop("count")
        spans = spans.unionByName(windows.join(twice, ["w1", "w2"]).select("u1", "u2", "lo", (F.col("lo") + shape.window).cast("int").alias("hi")))
    return spans


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    start = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[start], hi[np.append(np.flatnonzero(start)[1:], len(lo)) - 1]


def _apply_spans(schema_names: list[str]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            found = batch.column("found")
            at = found.offsets.to_numpy()
            owner, lo, hi = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            u2 = batch.column("u2").to_numpy()
            spans, kept = [], []
            for i in range(batch.num_rows):
                text = data[offsets[i]: offsets[i + 1]]
                mine = np.arange(at[i], at[i + 1])
                mine = mine[owner[mine] == u2[i]]
                if not len(mine):
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                a, b = _union(lo[mine].astype(np.int64), hi[mine].astype(np.int64))
                mark = np.zeros(len(text) + 1, np.int32)
                mark[a] += 1
                mark[b] -= 1
                kept.append(text[np.cumsum(mark[:-1]) == 0].tobytes())
                spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(a, b, strict=True)])
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema_names), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             [*schema_names, "spans", "kept"])
    return apply


def dedupe(docs: DataFrame, text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """``docs`` with ``spans`` (the removed byte runs [lo, hi), in order) and ``kept`` (the other bytes)."""
    fields = [f for f in docs.schema.fields if f.name not in ("spans", "kept")]
    inner = {f.name: "text" if f.name == text else f"c{i}" for i, f in enumerate(fields)}  # the text itself moves once
    doc_id = [F.col("doc_id")] if "doc_id" in docs.columns else []
    rows = docs.select(*(F.col(f"`{f.name}`").alias(inner[f.name]) for f in fields),
                       F.xxhash64(*doc_id, text).alias("u1"), F.xxhash64(F.lit(text), F.col(text), *doc_id).alias("u2"))
    pairs = StructType([StructField("lo", IntegerType()), StructField("hi", IntegerType())])
    added = [StructField("spans", ArrayType(pairs)), StructField("kept", BinaryType())]
    flat = StructType([*(StructField(inner[f.name], f.dataType) for f in fields), *added])
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    long = rows.where(size >= shape.window)
    dealt = long.repartition("u1")
    spans = repeated_spans(long, dealt, shape).groupBy("u1").agg(F.collect_set(F.struct("u2", "lo", "hi")).alias("found"))
    nothing = F.array().cast("array<struct<u2:bigint,lo:int,hi:int>>")
    cleaned = dealt.join(spans, "u1", "left").withColumn("found", F.coalesce("found", nothing)).mapInArrow(_apply_spans(list(inner.values())), flat)
    short = rows.where(size < shape.window).select(
        *inner.values(), F.array().cast(added[0].dataType).alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    out = cleaned.unionByName(short)
    return out.select(*(F.col(c).alias(name) for name, c in inner.items()), "spans", "kept")


@register("op11_suffix_dedup")
def op11_suffix_dedup(spark, sf_dir):
    out = dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
