"""Substring dedup (operator 6): FM-indexes over shards of shared passages.

A window is 20 consecutive words of one document; every word is removed that a
window covers whose words also start earlier (smaller doc_id, or same document
and earlier start).

1. Sharding.  Each window has an anchor, its 8-word run of least hash, so equal
   windows have equal anchors.  Windows that share an anchor place form a
   segment.  Rows per segment (anchor, digest, place) are dealt and sorted by
   anchor: of equal segments all but the first are repeats outright, and an
   anchor whose segments are all equal is settled.  Only first segments that
   share an anchor with a different one go on.
2. Index.  Shards of whole anchors, of bounded size, are indexed by an FM-index:
   suffix array by prefix doubling, BWT, wavelet matrix with packed rank bits.
   Backward search of all windows at once gives their matching statistics; the
   ones that reach 20 words with an interval of two or more are repeats, all but
   the earliest start of the interval.
3. An anchor too large for a shard is settled by sorting its windows themselves
   the way segments are sorted, so no group has to fit into one task.

Defined cases: a null or empty text has no words (digest of the empty string);
texts under 20 words have no window; repeated rows have equal starts, so none is
earlier and they keep their words; a null doc_id counts as the smallest; an
empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtq.llm.queries import register, table
from rtq.llm.words import U64, _INV, _ODD, by_text, gram_hashes, mix
from rtq.session import cut_lineage

WINDOW, ANCHOR = 20, 8
#: Words of a shard, and words of one anchor from which on its windows are sorted instead.
SHARD_WORDS, HOT_WORDS = 200_000, 100_000

_SEGMENT = "doc long, tkey int, w0 int, n int, anchor long, digest long"
_DECIDED = "search boolean, doc long, tkey int, w0 int, n int, anchor long"
_REMOVED = "doc long, tkey int, w0 int, n int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, null as the least long), tkey (32 bits of the text's hash), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
                       F.hash("text").alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))


def _runs(words: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any run of entries."""
    total = np.zeros(len(words) + 1, U64)
    power = np.full(max(1, len(words)), _ODD, U64)
    power[0] = 1
    np.cumsum(words * np.multiply.accumulate(power)[:len(words)], out=total[1:])
    return total


def segments(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor place: (row, first window, windows, anchor, digest)."""
    n_win = len(words) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n_win <= 0:
        return none, none, none, none, none
    g = gram_hashes(words, ANCHOR)
    best, at = g[:n_win].copy(), np.zeros(n_win, np.int64)
    for o in range(1, WINDOW - ANCHOR + 1):
        c = g[o: o + n_win]
        less = c < best
        best[less] = c[less]
        at[less] = o
    pos = np.arange(n_win)
    row = np.searchsorted(first, pos, "right") - 1
    ok = np.flatnonzero(pos + WINDOW <= first[row + 1])
    if not len(ok):
        return none, none, none, none, none
    place, r = ok + at[ok], row[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (place[1:] != place[:-1]) | (r[1:] != r[:-1])
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(ok)))
    w0 = ok[i]
    end = w0 + n + WINDOW - 1
    total = _runs(words)
    back = np.full(len(words) + 1, _INV, U64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    digest = mix((total[end] - total[w0]) * back[w0] + n.astype(U64))
    return r[i], w0, n, best[w0].view(np.int64), digest.view(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, tkey = b.column("doc").to_numpy(), b.column("tkey").to_numpy()
        for a, _, _, _, first, words in by_text(b):
            r, w0, n, anchor, digest = segments(words, first)
            yield pa.RecordBatch.from_arrays([pa.array(doc[r + a]), pa.array(tkey[r + a]), pa.array((w0 - first[r]).astype(np.int32)),
                                              pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(digest)],
                                             names=["doc", "tkey", "w0", "n", "anchor", "digest"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, digest, doc, w0: repeats of a segment are removed; a
    first one is to be searched if its anchor has another segment.  What is kept
    from batch to batch is the current run's first row, and the first segment of
    an anchor while it is the only one."""
    names = ["doc", "tkey", "w0", "n", "anchor", "digest"]
    last, waiting, several = None, [], False
    for b in batches:
        if not b.num_rows:
            continue
        doc, tkey, w0, n, anchor, digest = (b.column(c).to_numpy() for c in names)
        new_a, new_s = np.ones(len(doc), bool), np.ones(len(doc), bool)
        new_a[1:] = anchor[1:] != anchor[:-1]
        new_s[1:] = new_a[1:] | (digest[1:] != digest[:-1])
        if last is not None:
            new_a[0] = anchor[0] != last[0]
            new_s[0] = new_a[0] or digest[0] != last[1]
        if new_a[0]:
            waiting, several = [], False
        run, arun = np.cumsum(new_s), np.cumsum(new_a)
        heads = np.flatnonzero(new_s)
        head_doc = np.concatenate([[last[2] if last else 0], doc[heads]])
        head_w0 = np.concatenate([[last[3] if last else 0], w0[heads]])
        first = (doc == head_doc[run]) & (w0 == head_w0[run])
        count = np.bincount(arun, weights=new_s, minlength=arun[-1] + 1)
        count[0] += 1 if not new_a[0] else 0
        many = count > 1
        if not new_a[0] and several:
            many[0] = True
        pick = first & many[arun]
        if not new_a[0] and many[0]:
            parts = waiting
            waiting = []
        else:
            parts = []
        gone = ~first
        out = [np.concatenate([np.zeros(gone.sum(), bool), np.ones(pick.sum() + len(parts), bool)])]
        for k, col in enumerate((doc, tkey, w0, n, anchor)):
            out.append(np.concatenate([col[gone], col[pick], np.array([p[k] for p in parts], col.dtype)]))
        end = arun[-1]
        several = bool(many[end])
        if several:
            waiting = []
        else:
            keep = np.flatnonzero(first & (arun == end))
            rows = list(zip(doc[keep], tkey[keep], w0[keep], n[keep], anchor[keep], strict=True))
            waiting = (waiting if end == 0 else []) + rows
        last = (anchor[-1], digest[-1], head_doc[run[-1]], head_w0[run[-1]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["search", "doc", "tkey", "w0", "n", "anchor"])


def settle(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "anchor").sortWithinPartitions("anchor", "digest", "doc", "w0")
    return dealt.mapInArrow(_settle, _DECIDED)


def _cut(hot: bool):
    """Words of the listed segments; of a hot anchor one row per window instead."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tkey, lists = b.column("doc").to_numpy(), b.column("tkey").to_numpy(), b.column("at")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            w0s, ns, anchors = (lists.values.field(k).to_numpy() for k in ("w0", "n", "anchor"))
            for a, _, _, _, first, words in by_text(b):
                lo, hi = bounds[a], bounds[a + len(first) - 1]
                r = np.repeat(np.arange(len(first) - 1), np.diff(bounds[a: a + len(first)]))
                w0, n, anchor = w0s[lo:hi].astype(np.int64), ns[lo:hi].astype(np.int64), anchors[lo:hi]
                start = first[r] + w0
                if hot:
                    i = np.repeat(np.arange(len(r)), n)
                    k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                    h = gram_hashes(words, WINDOW)[start[i] + k]
                    h2 = gram_hashes(words, WINDOW, salt=7)[start[i] + k]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc[r[i] + a]), pa.array(tkey[r[i] + a]), pa.array((w0[i] + k).astype(np.int32)),
                        pa.array(np.ones(len(i), np.int32)), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64))],
                        names=["doc", "tkey", "w0", "n", "anchor", "digest"])
                else:
                    texts = [words[s: s + m + WINDOW - 1].tobytes() for s, m in zip(start, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc[r + a]), pa.array(tkey[r + a]), pa.array(w0.astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(anchor), pa.array(texts, pa.binary())], names=["doc", "tkey", "w0", "n", "anchor", "words"])
    return cut


class FMIndex:
    """FM-index of a sequence of small integers, for patterns of at most 32 entries.

    The BWT lies in a wavelet matrix: one packed bit row per bit of the symbols,
    with the count of ones before every 64 bits."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank, k = text.astype(np.int64), 1
        while k < 32:
            ahead = np.zeros(n, np.int64)
            ahead[: n - k] = rank[k:] + 1 if k < n else 0
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) if k > 1 else \
                np.unique(rank * (int(text.max()) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            k *= 2
        self.n = n
        cur = text[np.argsort(rank, kind="stable") - 1].astype(np.int64)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))]).astype(np.int64)
        self.levels, self.zeros, self.bits, self.ones = int(text.max()).bit_length() or 1, [], [], []
        for level in reversed(range(self.levels)):
            bit = (cur >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        symbols = np.arange(len(self.count) - 1)
        self.base = self._walk(symbols, np.zeros(len(symbols), np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            block = i >> 6
            mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
            one = self.ones[k][block] + np.bitwise_count(self.bits[k][block] & mask)
            i = np.where(c >> level & 1, self.zeros[k] + one, i - one)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``c`` put in front."""
        shift = self.count[c] - self.base[c]
        return self._walk(c, lo) + shift, self._walk(c, hi) + shift


def repeated_windows(words: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of the windows of all segments (``sizes`` words each, one after another),
    whether an equal one has a smaller ``order``.  Windows are in text order."""
    ids = np.unique(words, return_inverse=True)[1] + 1
    # A separator after each segment: no window crosses it.
    shift = np.repeat(np.arange(len(sizes)), sizes)
    text = np.zeros(len(words) + len(sizes), np.int64)
    text[np.arange(len(words)) + shift] = ids
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    n_win = sizes - WINDOW + 1
    start = np.repeat(begin - np.concatenate([[0], np.cumsum(n_win)[:-1]]), n_win) + np.arange(n_win.sum())
    index = FMIndex(text)
    live = np.arange(len(start))
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), index.n, np.int64)
    for back in range(WINDOW - 1, -1, -1):
        lo, hi = index.extend(text[start[live] + back], lo, hi)
        keep = hi - lo > 1  # alone: its match ends here
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if not len(live):
            break
    out = np.zeros(len(start), bool)
    if len(live):
        least = np.full(index.n, np.iinfo(np.int64).max)
        np.minimum.at(least, lo, order[live])
        out[live] = order[live] > least[lo]
    return out


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    n = pdf["n"].to_numpy().astype(np.int64)
    words = np.frombuffer(b"".join(pdf["words"]), U64)
    doc, w0 = pdf["doc"].to_numpy(), pdf["w0"].to_numpy().astype(np.int64)
    seg = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    at = w0[seg] + nth
    by = np.lexsort((at, doc[seg]))
    d, p = doc[seg][by], at[by]
    new = np.ones(len(by), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    order = np.empty(len(by), np.int64)
    order[by] = np.cumsum(new)
    gone = repeated_windows(words, n + WINDOW - 1, order)
    edge = gone.copy()
    edge[1:] &= ~(gone[:-1] & (seg[1:] == seg[:-1]))
    i = np.flatnonzero(edge)
    run = np.add.reduceat(gone, i) if len(i) else i  # ones after a run's first up to the next run
    return pd.DataFrame({"doc": doc[seg[i]], "tkey": pdf["tkey"].to_numpy()[seg[i]], "w0": at[i].astype("int32"), "n": run.astype("int32")})


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, n_words, n_removed, digest and text of what stays."""
    for b in batches:
        lists = b.column("at")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        w0s, ns = (lists.values.field(k).to_numpy().astype(np.int64) for k in ("w0", "n"))
        for a, data, starts, ends, first, _ in by_text(b):
            rows = len(first) - 1
            r = np.repeat(np.arange(rows), np.diff(bounds[a: a + rows + 1]))
            w0, n = w0s[bounds[a]: bounds[a + rows]], ns[bounds[a]: bounds[a + rows]]
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, first[r] + w0, 1)
            np.add.at(edge, first[r] + w0 + n + WINDOW - 1, -1)
            keep = np.cumsum(edge)[:-1] == 0
            before = np.concatenate([[0], np.cumsum(keep)])
            kept = before[first[1:]] - before[first[:-1]]
            k = np.flatnonzero(keep)
            tail = np.ones(len(k), bool)
            owner = np.searchsorted(first, k, "right") - 1
            tail[:-1] = owner[1:] != owner[:-1]
            mark = np.zeros(len(data) + 1, np.int8)
            mark[starts[k]] += 1
            np.subtract.at(mark, ends[k], 1)
            show = np.cumsum(mark[:-1]).astype(bool)
            gap = ends[k[~tail]]
            show[gap] = True
            data = data.copy()
            data[gap] = 0x20
            size = np.zeros(rows, np.int64)
            np.add.at(size, owner, ends[k] - starts[k] + ~tail)
            flat, cut = data[show].tobytes(), np.concatenate([[0], np.cumsum(size)])
            texts = [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc").slice(a, rows), pa.array(np.diff(first)), pa.array(np.diff(first) - kept),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
                names=["doc", "n_words", "n_removed", "kept_sha256", "kept"])


def _listed(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.groupBy("doc", "tkey").agg(F.collect_list(F.struct(*fields)).alias("at"))


def repeats(docs: DataFrame) -> DataFrame:
    """Runs of removed windows: doc, tkey, w0 (first), n."""
    texts = keyed(docs)
    decided = cut_lineage(settle(texts.mapInArrow(_segments, _SEGMENT)), "segments")
    todo = decided.where("search")
    size = F.col("n") + WINDOW - 1
    hot = cut_lineage(todo.groupBy("anchor").agg(F.sum(size).alias("size")).where(F.col("size") > HOT_WORDS).select("anchor"), "hot-anchors")
    total = todo.agg(F.sum(size)).first()[0] or 0
    removed = decided.where("NOT search").select("doc", "tkey", "w0", "n")
    if not total:
        return removed
    if hot.isEmpty():
        cold = todo
    else:
        cold = todo.join(hot, "anchor", "left_anti")
        at = _listed(todo.join(hot, "anchor"), "w0", "n", "anchor")
        windows = texts.join(at, ["doc", "tkey"]).dropDuplicates(["doc", "tkey"]).mapInArrow(_cut(True), _SEGMENT)
        removed = removed.unionByName(cut_lineage(settle(windows).where("NOT search").select("doc", "tkey", "w0", "n"), "hot-windows"))
    shards = max(1, total // SHARD_WORDS)
    parts = texts.join(_listed(cold, "w0", "n", "anchor"), ["doc", "tkey"]).dropDuplicates(["doc", "tkey"]).mapInArrow(
        _cut(False), "doc long, tkey int, w0 int, n int, anchor long, words binary")
    found = parts.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInPandas(_search, _REMOVED)
    return removed.unionByName(cut_lineage(found, "found"))


def strip_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and the kept words (``kept``, UTF-8)."""
    at = _listed(repeats(docs), "w0", "n")
    rows = keyed(docs).join(at, ["doc", "tkey"], "left").withColumn(
        "at", F.coalesce("at", F.array().cast("array<struct<w0:int,n:int>>")))
    out = rows.mapInArrow(_strip, "doc long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")


@register("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    return strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
