"""Sense graphs as edge tables: PATH1-PATH7r, AGG8, AGG15, AGG16, SC10.

All word pairs are processed together: a graph is the set of edge rows
keyed by ``wp`` (word-pair id).  Nodes are strings: ``w:<word>`` for the two
words, ``s:<id>`` for synsets.

Expansion (PATH2) carries a multiplicity per frontier node instead of
duplicate rows: a node reached by m walks adds each of its edges m times,
which is what the repeated frontier list of the reference does.

Levels come from an index that all word pairs share (``ancestor_index``): the
synsets reachable from each synset, by level, with the number of walks, built
in semi-naive rounds over the edge table.  The first level at which two words
meet (PATH3/PATH4) is the least, over their common ancestors, of the larger of
the two levels: one join, nothing is expanded per pair.  Only then the edges
below that level are read off the index for the pairs that connect.

A breadth-first search over an undirected graph meets no node older than two
layers, so each hop reads two layer tables, whatever the hop.  Graphs of common
size are dealt whole to blocks and searched there, a hop of all at a time (numpy on
Arrow).  Every loop is bounded (7 expansion levels, 16 search hops).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtq.session import cut_lineage

MAX_LEVELS = 7
MAX_HOPS = 2 * (MAX_LEVELS + 1)
#: Edges of a block of graphs, about, and of the largest graph that is part of one.
BLOCK_EDGES, GRAPH_EDGES = 1 << 16, 1 << 18
# Weights of antonym edges and of edges between a word and a synset.
ANTONYM_WEIGHT = 2.5
WORD_EDGE_WEIGHT = 0.0
WORD_EDGE = "word"
TYPE_ORDER = {WORD_EDGE: 0, "ANTONYM": 1, "HYPONYM": 2, "HYPERNYM": 3, "OTHER": 4}


def wnode(c) -> Column:
    return F.concat(F.lit("w:"), c)


def snode(c) -> Column:
    return F.concat(F.lit("s:"), c.cast("string"))


def path_transform(t) -> Column:
    """SC10: total weight T -> 1 - 2/T, 0 without weight."""
    t = F.col(t) if isinstance(t, str) else t
    return F.when(t == 0, F.lit(0.0)).otherwise(1 - 2 / t)


# ---------------------------------------------------------------- PATH1 ----

def seed_graph(word_pairs: DataFrame, word_synsets: DataFrame) -> DataFrame:
    """PATH1: lower-case the two words, link each to its distinct synsets.
    Returns seeds ``(wp, side, word, node)``; each row is one word-synset edge."""
    wp = word_pairs.select("wp", F.lower("w1").alias("w1"), F.lower("w2").alias("w2"))
    sides = wp.select("wp", F.lit(1).alias("side"), F.col("w1").alias("word")).unionByName(
        wp.select("wp", F.lit(2).alias("side"), F.col("w2").alias("word")))
    ws = word_synsets.select(F.col("lemma").alias("word"), "id").dropDuplicates(["word", "id"])  # AGG5
    return sides.join(ws, "word").select("wp", "side", "word", snode(F.col("id")).alias("node"))


def _edge_nodes(edges: DataFrame, typed: bool) -> DataFrame:
    cols = [snode(F.col("synset_id")).alias("node"), snode(F.col("target")).alias("tgt")]
    if typed:
        cols.append(F.col("relation_group").alias("type"))
    return edges.select(*cols)


# ---------------------------------------------------------------- PATH2 ----

def expand_frontier(frontier: DataFrame, edges: DataFrame, typed: bool = False) -> tuple[DataFrame, DataFrame]:
    """PATH2 / PATH2t: one level.  ``frontier(wp, side, node, mult)``; returns
    (new edges ``(wp, side, x, y, mult[, type])``, next frontier)."""
    e = _edge_nodes(edges, typed)
    keys = ["wp", "side", "node", "tgt"] + (["type"] if typed else [])
    new = frontier.join(e, "node").groupBy(*keys).agg(F.sum("mult").alias("mult"))
    new = new.withColumnRenamed("node", "x").withColumnRenamed("tgt", "y")
    nxt = new.groupBy("wp", "side", F.col("y").alias("node")).agg(F.sum("mult").alias("mult"))
    return new, nxt


def expand_frontier_typed(frontier: DataFrame, edges: DataFrame, lang: str) -> tuple[DataFrame, DataFrame]:
    """PATH2t: the notebook's four relations in ``lang`` or ``MUL``, type kept."""
    e = edges.filter(F.col("relation_group").isin("ANTONYM", "HYPONYM", "HYPERNYM", "OTHER")
                     & F.col("language").isin(lang, "MUL"))
    return expand_frontier(frontier, e, typed=True)


# ---------------------------------------------------------------- PATH3 ----

def ancestor_index(edges: DataFrame, starts: DataFrame | None = None, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Up-closure of an edge table: ``(start, node, level, walks)``, the number of
    walks of ``level`` edges from ``start`` to ``node``, level 0 to ``max_levels``.

    Built once and shared by all word pairs; ``starts(node)`` restricts it to the
    synsets of interest (default: every synset with an edge).  One round per level
    extends the last level's rows only."""
    e = cut_lineage(_edge_nodes(edges, False).groupBy("node", "tgt").agg(F.count(F.lit(1)).alias("n")), "closure-edges")
    starts = e.select("node") if starts is None else starts.select("node")
    last = cut_lineage(starts.distinct().select(F.col("node").alias("start"), "node", F.lit(0).alias("level"),
                                                F.lit(1).cast("long").alias("walks")), "closure-0")
    out = last
    for level in range(1, max_levels + 1):
        step = last.join(e, "node").groupBy("start", F.col("tgt").alias("node")).agg(F.sum(F.col("walks") * F.col("n")).alias("walks"))
        last = cut_lineage(step.select("start", "node", F.lit(level).alias("level"), "walks"), f"closure-{level}")
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out


def word_ancestors(seeds: DataFrame, index: DataFrame) -> DataFrame:
    """``(word, node, level, walks)``: the closure of all synsets of each distinct word."""
    senses = seeds.select("word", F.col("node").alias("start")).distinct()
    return senses.join(index, "start").groupBy("word", "node", "level").agg(F.sum("walks").alias("walks"))


def meeting_level(word_pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``(wp, lstar)`` of the pairs that connect: the least, over common ancestors,
    of the larger of the two levels at which they are first reached."""
    least = ancestors.groupBy("word", "node").agg(F.min("level").alias("level"))
    up = word_pairs.select("wp", F.lower("w1").alias("word"), F.lower("w2").alias("other"))
    up = up.join(least, "word").select("wp", F.col("other").alias("word"), "node", F.col("level").alias("l1"))
    return up.join(least, ["word", "node"]).groupBy("wp").agg(F.min(F.greatest("l1", "level")).alias("lstar"))


def expand_until_connected(word_pairs: DataFrame, word_synsets: DataFrame, edges: DataFrame,
                           max_levels: int = MAX_LEVELS, typed: bool = False, index: DataFrame | None = None) -> dict:
    """PATH3/PATH4: expand both words level by level until they share a node,
    at most ``max_levels`` levels; all pairs at once, over the ancestor index
    (built here for the words' synsets if not given).

    Returns a dict of DataFrames: ``seeds``, ``lstar(wp, lstar)`` (connected
    pairs only) and ``edges(wp, side, x, y, mult, level[, type])`` (the
    expansion edges of connected pairs, levels <= L*)."""
    seeds = cut_lineage(seed_graph(word_pairs, word_synsets), "seeds")
    index = ancestor_index(edges, seeds.select("node"), max_levels) if index is None else index.where(F.col("level") <= max_levels)
    ancestors = cut_lineage(word_ancestors(seeds, index), "word-ancestors")
    lstar = cut_lineage(meeting_level(word_pairs, ancestors), "lstar")
    sides = word_pairs.select("wp", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.lower("w1").alias("word")), F.struct(F.lit(2).alias("side"), F.lower("w2").alias("word")))).alias("s"))
    sides = sides.select("wp", "s.side", "s.word").join(lstar.where("lstar > 0"), "wp")
    below = sides.join(ancestors, "word").where(F.col("level") < F.col("lstar"))
    keys = ["node", "tgt"] + (["type"] if typed else [])
    steps = _edge_nodes(edges, typed).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = below.join(steps, "node").select("wp", "side", F.col("node").alias("x"), F.col("tgt").alias("y"), (F.col("walks") * F.col("n")).alias("mult"),
                                           (F.col("level") + 1).alias("level"), *(["type"] if typed else []))
    return {"seeds": seeds, "lstar": lstar, "edges": cut_lineage(out, "steps")}


def has_path(word_pairs: DataFrame, lstar: DataFrame) -> DataFrame:
    """PATH4: are the two words connected within the level limit?"""
    return word_pairs.select("wp").join(lstar, "wp", "left").select("wp", F.col("lstar").isNotNull().alias("has_path"))


# ------------------------------------------------------------- graph -------

def graph_edges(g: dict, typed: bool = False) -> DataFrame:
    """Undirected multigraph of the connected pairs as node-pair rows
    ``(wp, u, v, mult[, type])`` with u <= v: word-synset edges plus expansion
    edges, parallel edges summed."""
    seeds = g["seeds"].join(g["lstar"].select("wp"), "wp", "left_semi")
    words = seeds.select("wp", wnode(F.col("word")).alias("x"), F.col("node").alias("y"),
                         F.lit(1).cast("long").alias("mult"), F.lit(0).alias("level"))
    exp = g["edges"].select("wp", "x", "y", "mult", "level", *(["type"] if typed else []))
    if typed:
        words = words.withColumn("type", F.lit(WORD_EDGE))
    allg = words.unionByName(exp)
    u = F.least("x", "y")
    v = F.greatest("x", "y")
    if not typed:
        return allg.groupBy("wp", u.alias("u"), v.alias("v")).agg(F.sum("mult").alias("mult"))
    order = F.create_map(*[x for k, o in TYPE_ORDER.items() for x in (F.lit(k), F.lit(o))])
    return allg.groupBy("wp", u.alias("u"), v.alias("v")).agg(
        F.sum("mult").alias("mult"),
        F.min(F.struct("level", order[F.col("type")].alias("o"), "type")).alias("_t")).select(
        "wp", "u", "v", "mult", F.col("_t.type").alias("type"))


def same_type_degree(graph: DataFrame, typed: bool = False) -> DataFrame:
    """AGG8: edge ends of one type at a node, parallel edges counted, a self-loop once."""
    t = ["type"] if typed else []
    ends = graph.select("wp", F.col("u").alias("node"), "mult", *t).unionByName(
        graph.filter(F.col("u") != F.col("v")).select("wp", F.col("v").alias("node"), "mult", *t))
    return ends.groupBy("wp", "node", *t).agg(F.sum("mult").alias("deg"))


def edge_weight(graph: DataFrame, typed: bool = False) -> DataFrame:
    """PATH6: weight per node pair.  As shipped (``typed=False``) every edge gets
    the mean over its two ends of 2 - 1/degree; typed: antonym 2.5,
    word-synset 0, otherwise the same formula over same-type degrees (Q1)."""
    deg = same_type_degree(graph, typed)
    keys = ["wp", "node"] + (["type"] if typed else [])
    du = deg.select(*[F.col(k).alias("u" if k == "node" else k) for k in keys], F.col("deg").alias("du"))
    dv = deg.select(*[F.col(k).alias("v" if k == "node" else k) for k in keys], F.col("deg").alias("dv"))
    j = graph.join(du, ["wp", "u"] + (["type"] if typed else [])).join(dv, ["wp", "v"] + (["type"] if typed else []))
    formula = ((2 - 1 / F.col("du")) + (2 - 1 / F.col("dv"))) / 2
    if typed:
        w = (F.when(F.col("type") == "ANTONYM", F.lit(ANTONYM_WEIGHT))
             .when(F.col("type") == WORD_EDGE, F.lit(WORD_EDGE_WEIGHT)).otherwise(formula))
    else:
        w = formula
    return j.select("wp", "u", "v", "mult", *(["type"] if typed else []), w.alias("weight"))


# ---------------------------------------------------------------- PATH5 ----

def shortest_hops(word_pairs: DataFrame, weighted: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """PATH5 / PATH5p: breadth-first search from word 1 to word 2 on the
    undirected graph of each pair; among hop-shortest paths the one of least
    total weight, then the smallest node sequence (Q7).  Graphs of up to
    ``GRAPH_EDGES`` edges are searched many to a task, larger ones in rounds over
    tables; both give the same rows.  Returns ``(wp, hops, total_weight, path)``."""
    ends = word_pairs.select("wp", wnode(F.lower("w1")).alias("src"), wnode(F.lower("w2")).alias("dst"))
    kind = word_pairs.schema["wp"].dataType.simpleString()
    edges = cut_lineage(weighted.filter(F.col("u") != F.col("v")).select("wp", "u", "v", "weight"), "weighted")
    return _by_size(word_pairs, edges, ends, lambda e, n: _search_block(e, n, max_hops), lambda p, e: _hop_rounds(p, e, max_hops),
                    f"wp {kind}, hops int, total_weight double, path array<string>")


def _by_size(word_pairs: DataFrame, edges: DataFrame, ends: DataFrame, in_block, in_rounds, schema: str) -> DataFrame:
    """``in_block(edges, ends)`` over blocks of whole graphs ``edges(wp, u, v, ...)``,
    ``in_rounds`` for the pairs whose graph is larger than a block may hold."""
    size = edges.groupBy("wp").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(size.filter(F.col("n") > GRAPH_EDGES).select("wp"), "large-graphs")
    has_large = not large.isEmpty()
    small = edges.join(large, "wp", "left_anti") if has_large else edges
    n = max(1, -(-edges.count() // BLOCK_EDGES))

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, F.pmod(F.xxhash64("wp"), F.lit(n)).cast("int"))

    def run(graphs: pa.Table, ends: pa.Table) -> pa.Table:
        return in_block(graphs, ends)

    out = dealt(small, "_block").groupBy("_block").cogroup(dealt(ends, "_at").groupBy("_at")).applyInArrow(run, schema)
    if not has_large:
        return out
    pairs = word_pairs.join(large, "wp", "left_semi")
    return out.unionByName(in_rounds(pairs, edges.join(large, "wp", "left_semi")).select(*out.columns))


class _Graphs:
    """The graphs of a block as arrays: vertices are (pair, node), numbered in the
    order of the pair, then of the node's text; each has its edges in both directions."""

    def __init__(self, edges: pa.Table, nodes: list[tuple[pa.ChunkedArray, pa.ChunkedArray]]):
        texts = pa.concat_arrays([c for col in (edges["u"], edges["v"], *(t for _, t in nodes)) for c in col.chunks] or [pa.array([], pa.string())])
        texts = texts.unique()
        self.texts = texts.take(pc.sort_indices(texts))
        self.pairs = edges["wp"].unique() if edges.num_rows else pa.array([], edges.schema.field("wp").type)
        u, v = self.keys(edges["wp"], edges["u"]), self.keys(edges["wp"], edges["v"])
        named = [self.keys(wp, t) for wp, t in nodes]
        self.known = np.unique(np.concatenate([u, v, *(k[k >= 0] for k in named)]))
        u, v = np.searchsorted(self.known, u), np.searchsorted(self.known, v)
        source, self.target, both = np.concatenate([u, v]), np.concatenate([v, u]), np.tile(np.arange(len(u)), 2)
        order = np.argsort(source, kind="stable")
        self.target, self.edge = self.target[order], both[order]
        self.first = np.searchsorted(source[order], np.arange(len(self.known) + 1))
        #: Vertices of the given nodes, -1 for those of a pair without edges.
        self.nodes = [np.where(k >= 0, np.searchsorted(self.known, k), -1) for k in named]
        self.pair, self.text = np.divmod(self.known, max(1, len(self.texts)))

    def keys(self, wp: pa.ChunkedArray, text: pa.ChunkedArray) -> np.ndarray:
        pair = pc.fill_null(pc.index_in(wp, self.pairs), -1).to_numpy().astype(np.int64)
        node = pc.index_in(text, self.texts).to_numpy().astype(np.int64)
        return np.where(pair >= 0, pair * len(self.texts) + node, -1)

    def steps(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``at``, position of the edge) of every edge that leaves ``at``."""
        n = self.first[at + 1] - self.first[at]
        place = np.repeat(np.arange(len(at)), n)
        return place, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at], n)


def _search_block(edges: pa.Table, ends: pa.Table, max_hops: int) -> pa.Table:
    """PATH5 over a block, all pairs a hop at a time.  The paths of a layer are
    equally long, so they are ordered by their parents' order, then by their last node."""
    g = _Graphs(edges, [(ends["wp"], ends["src"]), (ends["wp"], ends["dst"])])
    weight = edges["weight"].to_numpy()
    has = g.nodes[0] >= 0
    start, goal = g.nodes[0][has], np.full(len(g.pairs), -1)
    goal[g.pair[start]] = g.nodes[1][has]
    seen, open_ = np.zeros(len(g.known), bool), np.ones(len(g.pairs), bool)
    at, cost = start, np.zeros(len(start))
    rank, layers, found = np.arange(len(at)), [(at, None)], []
    for hop in range(max_hops + 1):
        seen[at] = True
        hit = np.flatnonzero(goal[g.pair[at]] == at)
        found.append((hit, cost[hit]))
        open_[g.pair[at[hit]]] = False
        if hop == max_hops or not len(at):
            break
        parent, step = g.steps(at)
        keep = open_[g.pair[at[parent]]] & ~seen[g.target[step]]
        parent, step = parent[keep], step[keep]
        nxt, total = g.target[step], cost[parent] + weight[g.edge[step]]
        order = np.lexsort((rank[parent], total, nxt))
        order = order[np.concatenate([[True], nxt[order][1:] != nxt[order][:-1]])] if len(order) else order
        at, cost, parent = nxt[order], total[order], parent[order]
        by_path = np.lexsort((g.text[at], rank[parent]))
        rank = np.empty(len(at), np.int64)
        rank[by_path] = np.arange(len(at))
        layers.append((at, parent))
    wp, hops, costs, paths = [], [], [], []
    for hop, (hit, total) in enumerate(found):
        line, here = np.empty((len(hit), hop + 1), np.int64), hit
        for k in range(hop, -1, -1):
            line[:, k] = g.text[layers[k][0][here]]
            here = layers[k][1][here] if k else here
        wp.append(g.pair[layers[hop][0][hit]])
        hops.append(np.full(len(hit), hop))
        costs.append(total)
        paths.append(pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * (hop + 1), pa.int32()), g.texts.take(pa.array(line.ravel()))))
    return pa.table({"wp": g.pairs.take(pa.array(np.concatenate(wp))), "hops": pa.array(np.concatenate(hops), pa.int32()),
                     "total_weight": np.concatenate(costs), "path": pa.chunked_array(paths)})


def _hop_rounds(word_pairs: DataFrame, weighted: DataFrame, max_hops: int) -> DataFrame:
    """PATH5 over tables: each hop reads the last two layers and writes the next
    one; a pair leaves once its word 2 is reached."""
    adj = weighted.filter(F.col("u") != F.col("v")).select("wp", "u", "v", "weight")
    adj = adj.unionByName(adj.select("wp", F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    adj = cut_lineage(adj.withColumnsRenamed({"u": "node", "v": "next"}), "adjacent")
    ends = word_pairs.select("wp", wnode(F.lower("w1")).alias("src"), wnode(F.lower("w2")).alias("dst"))
    ends = ends.join(adj.select("wp").distinct(), "wp", "left_semi")
    layer = cut_lineage(ends.select("wp", "dst", F.col("src").alias("node"), F.lit(0).alias("hops"), F.lit(0.0).alias("cost"),
                                    F.array(F.col("src")).alias("path"), (F.col("src") == F.col("dst")).alias("done")), "hop-0")
    before, found = None, layer.where("done")
    for h in range(1, max_hops + 1):
        last = layer.where(~F.col("done"))
        if h > 1:  # pairs whose word 2 is in this layer are settled
            last = last.join(layer.where("done").select("wp"), "wp", "left_anti")
        cand = last.join(adj, ["wp", "node"]).select("wp", "dst", F.col("next").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"),
                                                     F.concat("path", F.array("next")).alias("path"))
        seen = layer.select("wp", "node") if before is None else layer.select("wp", "node").unionByName(before.select("wp", "node"))
        best = cand.join(seen, ["wp", "node"], "left_anti").groupBy("wp", "dst", "node").agg(F.min(F.struct("cost", "path")).alias("b"))
        best = best.select("wp", "dst", "node", F.lit(h).alias("hops"), "b.cost", "b.path", (F.col("node") == F.col("dst")).alias("done"))
        before, layer = layer, cut_lineage(best, f"hop-{h}")
        if layer.isEmpty():
            break
        found = found.unionByName(layer.where("done"))
    return found.select("wp", F.col("hops").cast("int"), F.col("cost").alias("total_weight"), "path")


def path_edges(paths: DataFrame, weighted: DataFrame | None = None) -> DataFrame:
    """PATH5p: the steps of each path (and, given weights, the data of each edge)."""
    steps = paths.select("wp", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1),
                                                         F.slice("path", 2, F.size("path")))).alias("step", "e"))
    steps = steps.select("wp", "step", F.col("e")["0"].alias("a"), F.col("e")["1"].alias("b"))
    if weighted is None:
        return steps
    w = weighted.select("wp", "u", "v", "mult", "weight")
    return steps.join(w, (steps["wp"] == w["wp"]) & (F.least("a", "b") == w["u"]) & (F.greatest("a", "b") == w["v"])).select(
        steps["wp"], "step", "a", "b", "mult", "weight")


def node_depth(word_pairs: DataFrame, graph: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """AGG15: smallest hop count from each node to either of the two words, by
    block or in rounds like PATH5."""
    ends = word_pairs.select("wp", wnode(F.lower("w1")).alias("src"), wnode(F.lower("w2")).alias("dst"))
    kind = word_pairs.schema["wp"].dataType.simpleString()
    edges = cut_lineage(graph.filter(F.col("u") != F.col("v")).select("wp", "u", "v"), "depth-edges")
    return _by_size(word_pairs, edges, ends, lambda e, n: _depth_block(e, n, max_hops), lambda p, e: _depth_rounds(p, e, max_hops),
                    f"wp {kind}, node string, depth int")


def _depth_block(edges: pa.Table, ends: pa.Table, max_hops: int) -> pa.Table:
    g = _Graphs(edges, [(ends["wp"], ends["src"]), (ends["wp"], ends["dst"])])
    depth = np.full(len(g.known), -1)
    roots = np.concatenate(g.nodes)
    at = np.unique(roots[roots >= 0])
    for hop in range(max_hops + 1):
        depth[at] = hop
        nxt = g.target[g.steps(at)[1]]
        at = np.unique(nxt[depth[nxt] < 0])
    seen = np.flatnonzero(depth >= 0)
    return pa.table({"wp": g.pairs.take(pa.array(g.pair[seen])), "node": g.texts.take(pa.array(g.text[seen])), "depth": pa.array(depth[seen], pa.int32())})


def _depth_rounds(word_pairs: DataFrame, graph: DataFrame, max_hops: int) -> DataFrame:
    """AGG15 over tables, a layer a round."""
    adj = graph.filter(F.col("u") != F.col("v")).select("wp", "u", "v")
    adj = cut_lineage(adj.unionByName(adj.select("wp", F.col("v").alias("u"), F.col("u").alias("v"))))
    roots = word_pairs.select("wp", wnode(F.lower("w1")).alias("node")).unionByName(
        word_pairs.select("wp", wnode(F.lower("w2")).alias("node"))).join(adj.select("wp").distinct(), "wp", "left_semi")
    layer = cut_lineage(roots.distinct().withColumn("depth", F.lit(0)))
    before, found = None, layer
    for h in range(1, max_hops + 1):
        seen = layer.select("wp", "node") if before is None else layer.select("wp", "node").unionByName(before.select("wp", "node"))
        nxt = layer.join(adj.withColumnRenamed("u", "node"), ["wp", "node"]).select("wp", F.col("v").alias("node")).distinct()
        before, layer = layer, cut_lineage(nxt.join(seen, ["wp", "node"], "left_anti").withColumn("depth", F.lit(h)))
        if layer.isEmpty():
            break
        found = found.unionByName(layer)
    return found


def root_nodes(g: dict) -> DataFrame:
    """AGG16: nodes without an incoming edge in the directed edge table
    (word -> synset, synset -> target)."""
    seeds = g["seeds"].join(g["lstar"].select("wp"), "wp", "left_semi")
    directed = seeds.select("wp", wnode(F.col("word")).alias("x"), F.col("node").alias("y")).unionByName(
        g["edges"].select("wp", "x", "y"))
    nodes = directed.select("wp", F.col("x").alias("node")).unionByName(directed.select("wp", F.col("y").alias("node"))).distinct()
    return nodes.join(directed.select("wp", F.col("y").alias("node")).distinct(), ["wp", "node"], "left_anti")


# ---------------------------------------------------------------- PATH7 ----

def sense_distance(word_pairs: DataFrame, word_synsets: DataFrame, edges: DataFrame,
                   first_piece_vectors: DataFrame | None = None, typed: bool = False,
                   max_levels: int = MAX_LEVELS) -> DataFrame:
    """PATH7: per distinct word pair: path weight T -> SC10; no path within the level limit -> cosine of the first
    pieces of the two words (SC9).  Output ``(wp, w1, w2, has_path, total_weight,
    sense_by_path, sense_by_cosine, distance)``."""
    from rtq.functions.vectors import word_cosine
    word_pairs = cut_lineage(word_pairs.select("wp", "w1", "w2"))  # read many times by the loops
    g = expand_until_connected(word_pairs, word_synsets, edges, max_levels, typed)
    graph = cut_lineage(graph_edges(g, typed), "graph")  # read three times by the weights
    sp = shortest_hops(word_pairs, edge_weight(graph, typed))
    out = word_pairs.select("wp", "w1", "w2").join(sp.select("wp", "total_weight"), "wp", "left")
    out = out.withColumn("has_path", F.col("total_weight").isNotNull())
    out = out.withColumn("sense_by_path", path_transform("total_weight"))
    if first_piece_vectors is not None:
        out = word_cosine(out, first_piece_vectors, "w1", "w2", "sense_by_cosine")
    else:
        out = out.withColumn("sense_by_cosine", F.lit(None).cast("double"))
    return out.withColumn("distance", F.when(F.col("has_path"), F.col("sense_by_path")).otherwise(F.col("sense_by_cosine")))
