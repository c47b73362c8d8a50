"""MinHash near-dedup (operator 9): BagMinHash signatures, bands, exact overlap.

A text is the multiset of its 5-word shingles (words as in ``words``, A-Z
lower-cased).  Two texts are linked when the weighted Jaccard similarity of
their multisets is at least 0.8; classes are the connected components.

1. Texts that are equal share one node (MD5), so copies never form pairs.
2. BagMinHash: every shingle owns Poisson processes over dyadic weight ranges
   [0,1), [1,2), [2,4)...; a point counts when its unit cell lies below the
   shingle's weight.  The earliest point per register is its sample, so two
   registers agree with probability equal to the weighted Jaccard similarity.
   Points later than the time by which a text's registers fill are never drawn.
3. Bands of the signature are bucket keys.  First all nodes of a bucket are
   compared with its least node.  Then only buckets that hold nodes of several
   components are open, and there every two nodes of different components are
   compared: in small buckets as pairs, in larger ones by blocks.  So no link
   between different components that meet in a bucket is lost.
4. A pair is compared by registers first, then exactly by multiset overlap.
   A block holds at most about ``2 * BLOCK`` texts; the overlaps of all its
   pairs are taken at once inside the task, and one link per text and component
   leaves it, so the pairs of a large bucket are never rows.

Defined cases: a null text is a class of its own and never linked; equal texts
(also empty ones) are one class; a text with fewer than 5 words is linked to
equal texts only; repeated rows belong to one class; an empty table gives no
rows; extra columns are not carried by ``near_classes`` and kept by ``dedupe``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from rtq.llm.names import guarded
from rtq.llm.queries import register, table
from rtq.llm.words import SLICE_BYTES, U64, buffers, by_text, gram_hashes, mix, slices
from rtq.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 16, 4
REGISTERS = BANDS * BAND_ROWS
#: A candidate goes on to the exact comparison from so many equal registers on
#: (at similarity 0.8 fewer than 34 of 64 has a probability below one in a million).
LEAST_EQUAL = 34
#: A bucket of at most so many nodes is compared as pairs, which bounds its pairs
#: by half as many per node.
SMALL = 64
#: Nodes (16 bytes each) whose texts are looked up by a broadcast.
BROADCAST_NODES = 1_000_000
#: Texts a side of a block of a larger bucket, and shingles compared at once.
BLOCK, COLUMNS = 256, 2048
_GOLD = U64(0x9E3779B97F4A7C15)


def _multisets(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with counts; rows ascending."""
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], g[at], np.diff(np.append(at, len(g)))


def bag_minhash(row: np.ndarray, g: np.ndarray, w: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (n_rows x m of 32 bits) of the multisets given as distinct
    (row, shingle, integer weight); rows without a shingle get zeros."""
    best = np.full(n_rows * m, np.iinfo(np.uint64).max, U64)
    weight = np.bincount(row, weights=w, minlength=n_rows)
    lows, spans = [np.zeros(len(g), np.int64)], [np.ones(len(g), np.int64)]
    at = [np.arange(len(g))]
    low = 1
    while True:  # dyadic ranges above the first that a weight reaches into
        i = np.flatnonzero(w > low)
        if not len(i):
            break
        at.append(i)
        lows.append(np.full(len(i), low, np.int64))
        spans.append(np.full(len(i), low, np.int64))
        low *= 2
    at, lows, spans = np.concatenate(at), np.concatenate(lows), np.concatenate(spans)
    p_row, p_w = row[at], w[at]
    p_key = mix(g[at] ^ (lows.astype(U64) * _GOLD))
    limit = np.zeros(n_rows)
    has = weight > 0
    limit[has] = 1.5 * m * (np.log(m) + 2) / weight[has]
    todo = has
    while todo.any():
        i = np.flatnonzero(todo[p_row])
        x, step = np.zeros(len(i)), 0
        while len(i):
            step += 1
            r = mix(p_key[i] + U64(step * int(_GOLD) % (1 << 64)))
            u = ((r >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
            x = x - np.log(u) / spans[i]
            go = x < limit[p_row[i]]
            i, x, r = i[go], x[go], mix(r[go] ^ U64(0x5851F42D4C957F2D))
            reg = (r >> U64(58)).astype(np.int64) if m == 64 else (r % U64(m)).astype(np.int64)
            cell = lows[i] + ((r & U64(0xFFFFFF)).astype(np.int64) * spans[i] >> 24)
            ok = cell < p_w[i]
            packed = (x[ok].astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (mix(r[ok]) >> U64(32))
            np.minimum.at(best, p_row[i[ok]] * m + reg[ok], packed)
        open_rows = (best.reshape(n_rows, m) == np.iinfo(np.uint64).max).any(axis=1) & has
        limit[open_rows] *= 4
        todo = open_rows
    sig = (best & U64(0xFFFFFFFF)).astype(np.uint32).reshape(n_rows, m)
    sig[~has] = 0
    return sig


def _shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles inside one row: (hash, row)."""
    g = gram_hashes(words, SHINGLE)
    row = np.searchsorted(first, np.arange(len(g)), "right") - 1
    inside = np.arange(len(g)) + SHINGLE <= first[row + 1]
    return g[inside], row[inside]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, _, _, first, words in by_text(batch, "text", lower=True):
            n = len(first) - 1
            sig = bag_minhash(*_multisets(*_shingles(words, first)), n)
            keys = np.tile(np.arange(1, BANDS + 1, dtype=U64), (n, 1))
            for j in range(BAND_ROWS):
                keys = mix(keys * _GOLD + sig[:, j::BAND_ROWS][:, :BANDS].astype(U64) + U64(1))
            has = np.diff(first) >= SHINGLE
            flat = pa.array(keys[has].view(np.int64).ravel())
            lengths = np.where(has, BANDS, 0)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(a, n), batch.column("node").slice(a, n),
                pa.array([s.tobytes() for s in sig.astype(np.uint8)], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                names=["doc_id", "node", "sig", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (MD5 of the text; unique per row for a null), sig (low byte of
    every register: equal registers stay equal), bands."""
    node = F.unhex(F.coalesce(F.md5(F.col("text").cast("binary")), F.md5(F.concat(F.lit("\0null"), F.uuid()).cast("binary"))))
    rows = docs.select("doc_id", node.alias("node"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_sign, f"doc_id {kind}, node binary, sig binary, bands array<long>")


@F.pandas_udf(IntegerType())
def _equal_registers(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series((x == y).sum(axis=1).astype("int32"))


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of pairs whose texts take a few MB together, or one pair."""
    size = sum(np.diff(buffers(batch.column(c))[1]) for c in ("text_a", "text_b"))
    for a, b in slices(np.concatenate([[0], np.cumsum(size)]), 4 * SLICE_BYTES):
        yield batch.slice(a, b - a)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the texts of each pair, exactly."""
    for batch in (part for b in batches for part in _bounded(b)):
        n = batch.num_rows
        sides = []
        for side in ("text_a", "text_b"):
            got = []
            for a, _, _, _, first, words in by_text(batch, side, lower=True):
                g, row = _shingles(words, first)
                got.append((g, row + a))
            sides.append((np.concatenate([g for g, _ in got] or [np.zeros(0, U64)]),
                          np.concatenate([r for _, r in got] or [np.zeros(0, np.int64)])))
        (ra, ga, wa), (rb, gb, wb) = (_multisets(g, r) for g, r in sides)
        row, g, w = np.concatenate([ra, rb]), np.concatenate([ga, gb]), np.concatenate([wa, wb])
        order = np.lexsort((g, row))
        row, g, w = row[order], g[order], w[order]
        same = np.flatnonzero((row[1:] == row[:-1]) & (g[1:] == g[:-1]))
        both = np.bincount(row[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
        union = np.bincount(row, weights=w, minlength=n) - both
        sim = np.divide(both, union, out=np.zeros(n), where=union > 0)
        keep = np.flatnonzero(sim >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)),
                                          pa.array(sim[keep])], names=["a", "b", "similarity"])


def components(edges: DataFrame) -> DataFrame:
    """node -> comp (least node of its component) for the nodes of ``edges (a, b)``.

    Each round every node points to its least neighbour, pointers are followed
    to their ends, and edges are carried over to those."""
    edges = cut_lineage(edges.select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "pointers")
        while True:
            nxt = up.join(up.select(F.col("node").alias("to"), F.col("to").alias("_end")), "to", "left").select(
                "node", F.coalesce("_end", "to").alias("to"), (F.coalesce("_end", "to") != F.col("to")).alias("_moved"))
            nxt = cut_lineage(nxt, "pointers")
            up = nxt.select("node", "to")
            if nxt.where("_moved").isEmpty():
                break
        if labels is None:
            labels = up.select("node", F.col("to").alias("comp"))
        else:
            labels = labels.join(up.select(F.col("node").alias("comp"), "to"), "comp", "left").select(
                "node", F.coalesce("to", "comp").alias("comp"))
        end = up.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        edges = edges.join(end, "a").join(end.select(F.col("a").alias("b"), F.col("_a").alias("_b")), "b").where(
            "_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
        edges = cut_lineage(edges, "edges")
        if edges.isEmpty():
            return cut_lineage(labels, "labels")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _texts(docs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """node, text of the given nodes, each once.

    The nodes are written and counted first: up to ``BROADCAST_NODES`` they are
    sent to the texts, beyond that both sides meet by a shuffle."""
    nodes = cut_lineage(nodes, "wanted")
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    rows = docs.where("text IS NOT NULL").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    return cut_lineage(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), name)


def _verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links.  Only texts of pairs that agree by registers are moved."""
    a, b = sigs.select(F.col("node").alias("a"), F.col("sig").alias("_sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("_sb"))
    near = cut_lineage(pairs.join(b, "b").join(a, "a").where(_equal_registers("_sa", "_sb") >= LEAST_EQUAL).select("a", "b"), "candidates")
    texts = _texts(docs, near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidate-texts")
    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return near.join(tb, "b").join(ta, "a").mapInArrow(_overlap, "a binary, b binary, similarity double")


def _block_links(block: pa.Table) -> pa.Table:
    """Links between the two sides of a block, across components: for each text
    of the left side one per component of the right side."""
    batch = block.combine_chunks().to_batches()[0]
    got = [(g, row + a) for a, _, _, _, first, words in by_text(batch, "text", lower=True) for g, row in [_shingles(words, first)]]
    row, g, w = _multisets(np.concatenate([g for g, _ in got]), np.concatenate([r for _, r in got]))
    size = np.bincount(row, weights=w, minlength=batch.num_rows)
    # The k-th copy of a shingle is an element of its own: a multiset's overlap becomes a set's.
    copy = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    row, g = np.repeat(row, w), mix(np.repeat(g, w) + copy.astype(U64) * _GOLD)
    left = np.asarray(batch.column("left"))
    at = np.zeros(batch.num_rows, np.int64)
    at[left], at[~left] = np.arange(left.sum()), np.arange((~left).sum())
    on_left = left[row]
    both = np.intersect1d(g[on_left], g[~on_left])
    used = np.isin(g, both)
    row, column, on_left = row[used], np.searchsorted(both, g[used]), on_left[used]
    shared = np.zeros((left.sum(), (~left).sum()), np.float32)
    for c in range(0, len(both), COLUMNS):
        inside = (column >= c) & (column < c + COLUMNS)
        x, y = np.zeros((shared.shape[0], COLUMNS), np.float32), np.zeros((shared.shape[1], COLUMNS), np.float32)
        i, j = inside & on_left, inside & ~on_left
        x[at[row[i]], column[i] - c] = 1
        y[at[row[j]], column[j] - c] = 1
        shared += x @ y.T
    sim = shared / np.maximum(1, size[left][:, None] + size[~left][None, :] - shared)
    _, comp = np.unique(np.array(batch.column("comp").to_pylist(), "V16"), return_inverse=True)
    i, j = np.nonzero((sim >= SIMILARITY) & (comp[left][:, None] != comp[~left][None, :]))
    _, one = np.unique(np.stack([i, comp[~left][j]]), axis=1, return_index=True)
    i, j = i[one], j[one]
    nodes = batch.column("node")
    return pa.table({"a": nodes.take(pa.array(np.flatnonzero(left)[i])), "b": nodes.take(pa.array(np.flatnonzero(~left)[j])),
                     "similarity": pa.array(sim[i, j].astype(np.float64))})


def _blocked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links across components inside large buckets ``rows (key, node, comp)``.

    Nodes outside the most frequent component of their bucket meet all nodes of
    the bucket: both sides are dealt by hash to blocks, each block a group."""
    counts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    plan = cut_lineage(counts.groupBy("key").agg(F.max_by("comp", "c").alias("top"), F.sum("c").alias("n"), F.max("c").alias("most")).select(
        "key", "top", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("la"), F.ceil(F.col("n") / BLOCK).cast("int").alias("lb")), "block-plan")
    rows = rows.join(plan, "key")
    a, b = F.pmod(F.xxhash64("node"), F.col("la")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("lb")).cast("int")
    lefts = rows.where("comp <> top").select("key", "node", "comp", F.lit(True).alias("left"), a.alias("x"), F.explode(F.sequence(F.lit(0), F.col("lb") - 1)).alias("y"))
    rights = rows.select("key", "node", "comp", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("la") - 1)).alias("x"), b.alias("y"))
    texts = _texts(docs, rows.select("node").distinct(), "block-texts")
    blocks = lefts.unionByName(rights).join(texts, "node")
    return blocks.groupBy("key", "x", "y").applyInArrow(_block_links, "a binary, b binary, similarity double").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def links(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(verified links, component per linked node); None where there is no link."""
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut_lineage(spread.join(shared, "key"), "buckets")
    sigs = cut_lineage(nodes.select("node", "sig").join(buckets.select("node").distinct(), "node"), "candidate-sigs")
    leaders = buckets.groupBy("key").agg(F.min("node").alias("a"))
    led = cut_lineage(buckets.join(leaders, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    found = [cut_lineage(_verified(led, sigs, docs), "links")]
    if found[0].isEmpty():
        found, open_rows = [], buckets.withColumn("comp", F.col("node"))
    else:
        open_rows = buckets.join(components(found[0]), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # What is left: buckets that still hold several components.
    open_rows = cut_lineage(open_rows.select("key", "node", "n", "comp"), "rows")
    mixed = open_rows.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("key")
    open_rows = cut_lineage(open_rows.join(mixed, "key"), "mixed")
    small = open_rows.where(F.col("n") <= SMALL).select("key", "node", "comp")
    other = small.select("key", F.col("node").alias("b"), F.col("comp").alias("_c"))
    pairs = small.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("comp") != F.col("_c"))).select(F.col("node").alias("a"), "b").distinct()
    found.append(cut_lineage(_verified(cut_lineage(pairs.join(led, ["a", "b"], "left_anti"), "pairs"), sigs, docs), "links"))
    large = open_rows.where(F.col("n") > SMALL).select("key", "node", "comp")
    if not large.isEmpty():
        found.append(cut_lineage(_blocked(large, docs), "links"))
    edges = cut_lineage(_all(found).dropDuplicates(["a", "b"]), "links")
    return (None, None) if edges.isEmpty() else (edges, components(edges))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, class_id (least doc_id of its
    class), class_size (rows), n_links (links of its text to different texts that
    were found on the way; texts already in one class are not compared further)."""
    signed = cut_lineage(signatures(docs), "signatures")
    nodes = cut_lineage(signed.where(F.size("bands") > 0).groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    edges, comp = links(nodes, docs)
    rows = signed.select("doc_id", "node")
    if edges is None:
        rows = rows.withColumns({"comp": F.col("node"), "n_links": F.lit(0).cast("long")})
    else:
        degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        linked = cut_lineage(comp.join(degree, "node"), "linked")
        rows = rows.join(linked, "node", "left").select(
            "doc_id", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = cut_lineage(rows, "members")
    classes = rows.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(classes, "comp").select("doc_id", "node", "class_id", "class_size", "n_links")


@guarded()
def dedupe(docs: DataFrame) -> DataFrame:
    """One row of each class stays: that with the least doc_id."""
    classes = near_classes(docs)
    # A null text never leaves; other rows stay when they hold the class's doc_id.
    stay = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct()
    keyed = docs.withColumn("_n", F.unhex(F.md5(F.col("text").cast("binary"))))
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_node")))
    kept = kept.dropDuplicates(["_id", "_node"])
    return kept.select(*docs.columns).unionByName(docs.where("text IS NULL").select(*docs.columns))


@register("op9_near_dups")
def op9_near_dups(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("node")
