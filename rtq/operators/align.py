"""Word alignment as DataFrame jobs: WIN2-WIN6, JN6-JN8, ALN0-ALN5, TOP2, TOP3, SET2.

Layout: ``units(pair_id, side, pos, piece, cls)``; ``side`` is ``src`` or
``trg``, ``cls`` the vector class (token id) of the unit, null for padding.
Vectors live in ``vectors(cls, embedding)``.

Keys: everything pair-level is keyed ``(pair_id, i)`` or ``(pair_id, j)``,
never ``pair_id`` alone, so a long sentence pair spreads over many tasks.
Its token product (JN6, ALN1, ALN2) is dealt in tiles of ``TILE`` x ``TILE``
positions, its running maximum (WIN3) in blocks of ``BLOCK`` positions.  WIN4
folds the target lists of one pair's ambiguous sources, up to ``FOLD`` of them;
a longer pair finds each match's successor by block maxima and marks what the
first one reaches by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rtq.functions.text import MARK, strip_marker
from rtq.functions import vectors as V
from rtq.session import cut_lineage

TECHNIQUES = ("TOK", "AVG", "MAX", "FIRST")
#: Positions a side of a tile, positions of a block, sources that one fold takes.
TILE, BLOCK, FOLD = 512, 4096, 4096
#: Sources under one node of the maxima WIN4 searches (a power of two).
FAN = 64
#: Units a side up to which one task matches a pair (ALN1, ALN2).
PAIR_UNITS = 1024


# ------------------------------------------------------------- padding -----

def pad_sides(units: DataFrame) -> DataFrame:
    """WIN6: pad the shorter side with empty units (zero vectors) to equal length."""
    cnt = units.groupBy("pair_id").agg(
        F.sum(F.when(F.col("side") == "src", 1).otherwise(0)).alias("ns"),
        F.sum(F.when(F.col("side") == "trg", 1).otherwise(0)).alias("nt"))
    pad_side = F.when(F.col("ns") < F.col("nt"), F.lit("src")).otherwise(F.lit("trg"))
    lo = F.least("ns", "nt")
    hi = F.greatest("ns", "nt")
    pads = cnt.filter(F.col("ns") != F.col("nt")).select(
        "pair_id", pad_side.alias("side"), F.explode(F.sequence(lo.cast("int"), (hi - 1).cast("int"))).alias("pos"))
    pads = pads.select("pair_id", "side", F.col("pos").cast("int"), F.lit(MARK).alias("piece"),
                       F.lit(None).cast(units.schema["cls"].dataType).alias("cls"))
    return units.select("pair_id", "side", "pos", "piece", "cls").unionByName(pads)


def _side(units: DataFrame, side: str, pos: str, cls: str) -> DataFrame:
    return units.filter(F.col("side") == side).select("pair_id", F.col("pos").alias(pos), F.col("cls").alias(cls))


# --------------------------------------------------------- similarities -----

def dealt(units: DataFrame) -> tuple[DataFrame, list[str]]:
    """Every row of ``units(pair_id, source, at_pos, ...)``, written once, with each of
    its pair's tiles ``(_bi, _bj)`` that it is part of, and the key of a tile: a pair
    of n x m tokens spreads over n m / TILE^2 groups.  Where every pair is one tile,
    the pair is the key and nothing is shuffled."""
    units = cut_lineage(units, "units")
    last = units.filter(F.col("at_pos") >= TILE).groupBy("pair_id").agg(
        *(F.max(F.when(F.col("source") == side, F.floor(F.col("at_pos") / TILE).cast("int"))).alias(name) for side, name in ((True, "_li"), (False, "_lj"))))
    last = cut_lineage(last, "long-pairs")
    if last.isEmpty():
        return units, ["pair_id"]
    own = F.floor(F.col("at_pos") / TILE).cast("int")
    across = F.sequence(F.lit(0), F.coalesce(F.when(F.col("source"), F.col("_lj")).otherwise(F.col("_li")), F.lit(0)))
    tiles = units.join(last, "pair_id", "left").withColumn("_other", F.explode(across))
    tiles = tiles.withColumns({"_bi": F.when(F.col("source"), own).otherwise(F.col("_other")),
                               "_bj": F.when(F.col("source"), F.col("_other")).otherwise(own)}).drop("_li", "_lj", "_other")
    return cut_lineage(tiles, "tiles"), ["pair_id", "_bi", "_bj"]


def scored(s: DataFrame, t: DataFrame, vectors: DataFrame, least: float | None = None) -> DataFrame:
    """``(pair_id, i, j, sim)`` for ``s(pair_id, i, a)`` and ``t(pair_id, j, b)``,
    those above ``least`` if given.  The two sides of a tile meet in one block with
    the vectors of its classes, and their product is made there: what is shuffled
    grows with the units, not with their pairs.  Without a vector it is 0."""
    units = s.select(F.col("pair_id").cast("long"), F.lit(True).alias("source"), F.col("i").cast("int").alias("at_pos"), F.col("a").alias("cls")).unionByName(
        t.select(F.col("pair_id").cast("long"), F.lit(False).alias("source"), F.col("j").cast("int").alias("at_pos"), F.col("b").alias("cls")))
    units, keys = dealt(units)

    def product(rows: pa.Table, unit: np.ndarray) -> Iterator[pa.Table]:
        for tile in V.groups(rows, keys, ["at_pos"]):
            source, pos, at = tile["source"].to_numpy(), tile["at_pos"].to_numpy(), tile["at"].to_numpy()
            sim = _similarities(unit, at[source], at[~source])
            i, j = np.repeat(pos[source], sim.shape[1]), np.tile(pos[~source], sim.shape[0])
            sim, pair = sim.ravel(), tile["pair_id"][0].as_py()
            if least is not None:
                keep = sim > least
                i, j, sim = i[keep], j[keep], sim[keep]
            yield pa.table({"pair_id": pa.array([pair], pa.int64()).take(pa.array(np.zeros(len(i), np.int32))), "i": i, "j": j, "sim": sim})

    return V.over_blocks(units, vectors, keys, product, "pair_id long, i int, j int, sim double", written=True)


def _similarities(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the vectors at ``a`` and ``b``, 0 for those without one (-1)."""
    sim = np.zeros((len(a), len(b)))
    rows, cols = np.flatnonzero(a >= 0), np.flatnonzero(b >= 0)
    if len(rows) and len(cols):
        sim[np.ix_(rows, cols)] = V.dots(unit[a[rows]], unit[b[cols]])
    return sim


def pairwise_similarity(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """JN6: every source unit x every target unit of the same pair, cosine."""
    return scored(_side(units, "src", "i", "a"), _side(units, "trg", "j", "b"), vectors)


def near_identical_tokens(units: DataFrame, vectors: DataFrame, ni: DataFrame | None = None) -> DataFrame:
    """JN7: unit pairs with cosine > 0.999, by equi-joins on vector class (class
    pairs from the metric index, or given as ``ni(a, b)``), never by the full
    product.  Target classes with equal vectors meet as one representative."""
    s = _side(units, "src", "i", "a").filter(F.col("a").isNotNull())
    t = _side(units, "trg", "j", "b").filter(F.col("b").isNotNull())
    if ni is not None:
        return s.join(ni.select("a", "b"), "a").join(t, ["pair_id", "b"]).select("pair_id", "i", "j")
    members, compared = V.near_identical_index(vectors)
    halves = cut_lineage(V.near_identical_halves(members, compared).select("a", "rep"), "halves")
    t = t.join(members.select(F.col("cls").alias("b"), "rep"), "b")
    return s.join(halves, "a").join(t, ["pair_id", "rep"]).select("pair_id", "i", "j")


# ---------------------------------------------------------------- ALN0 -----

def ambiguous_matches(matches: DataFrame) -> DataFrame:
    """WIN2: flag matches whose source unit matches more than one target."""
    c = matches.groupBy("pair_id", "i").agg(F.count(F.lit(1)).alias("_n"))
    return matches.join(c, ["pair_id", "i"]).withColumn("ambiguous", F.col("_n") > 1).drop("_n")


def monotone_matches(unambiguous: DataFrame) -> DataFrame:
    """WIN3: drop unambiguous matches whose target lies below the running maximum.

    Two passes: the maxima of blocks of ``BLOCK`` positions run over a pair's
    blocks, then positions run within a block above what came before it."""
    m = unambiguous.withColumn("_b", F.floor(F.col("i") / BLOCK))
    ahead = Window.partitionBy("pair_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = m.groupBy("pair_id", "_b").agg(F.max("j").alias("_top")).select("pair_id", "_b", F.max("_top").over(ahead).alias("_before"))
    within = Window.partitionBy("pair_id", "_b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.join(before, ["pair_id", "_b"]).withColumn("_m", F.greatest(F.max("j").over(within), "_before"))
    return m.filter(F.col("j") >= F.col("_m")).drop("_b", "_m", "_before")


def monotone_ambiguous(ambiguous: DataFrame, strict: bool = False) -> DataFrame:
    """WIN4: each source, in order, takes its least target above the last one
    taken.  Unless ``strict``, a pair's last match (by source, then target) stands
    outside this rule and is always kept.  Pairs of up to ``FOLD`` ambiguous
    sources are folded, longer ones searched; both give the same rows."""
    per_source = ambiguous.groupBy("pair_id", "i").agg(F.sort_array(F.collect_set("j")).alias("js"))
    size = per_source.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"))
    long_pairs = cut_lineage(size.filter(F.col("_n") > FOLD).select("pair_id"), "long-pairs")
    if long_pairs.isEmpty():
        return _fold(per_source, strict)
    short = per_source.join(long_pairs, "pair_id", "left_anti")
    return _fold(short, strict).unionByName(_search(per_source.join(long_pairs, "pair_id", "left_semi"), strict))


def _fold(per_source: DataFrame, strict: bool) -> DataFrame:
    """One array per pair holds the target lists of its sources; an ``aggregate``
    over it carries the last target taken."""
    pairs = per_source.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("i", "js"))).alias("sources"))
    last = F.element_at("sources", -1)
    pairs = pairs.withColumn("last", F.struct(last["i"].alias("i"), F.element_at(last["js"], -1).alias("j")))
    exempt = F.lit(False) if strict else F.lit(True)

    def least_above(acc, x):
        return F.get(F.filter(x["js"], lambda j: (j > acc["top"]) & ~(
            exempt & (x["i"] == F.col("last.i")) & (j == F.col("last.j")))), F.lit(0))

    def step(acc, x):
        j = least_above(acc, x)
        return F.struct(F.coalesce(j, acc["top"]).alias("top"), F.when(j.isNull(), acc["taken"]).otherwise(
            F.concat(acc["taken"], F.array(F.struct(x["i"].alias("i"), j.alias("j"))))).alias("taken"))

    start = F.struct(F.lit(-1).alias("top"), F.array().cast("array<struct<i:int,j:int>>").alias("taken"))
    taken = F.aggregate("sources", start, step)["taken"]
    kept = pairs.select("pair_id", F.explode(taken if strict else F.concat(taken, F.array("last"))).alias("m"))
    return kept.select("pair_id", "m.i", "m.j")


def _search(per_source: DataFrame, strict: bool) -> DataFrame:
    """WIN4 without a fold.  The match taken after (i, j) is, at the first later
    source with a target above j, the least such target.  A tree of block maxima
    (``FAN`` sources a node) finds that source for all matches at once: up until
    a later sibling has a greater maximum, then down to it.  What the first match
    reaches along these successors is marked by pointer doubling."""
    rank = Window.partitionBy("pair_id").orderBy("i")  # numbers only: one row per source
    src = per_source.withColumn("at", (F.row_number().over(rank) - 1).cast("long"))
    match = src.select("pair_id", "i", "at", F.explode("js").alias("j"))
    last = match.groupBy("pair_id").agg(F.max(F.struct("i", "j")).alias("l")).select("pair_id", "l.i", "l.j")
    open_ = match if strict else match.join(last, ["pair_id", "i", "j"], "left_anti")
    open_ = cut_lineage(open_.groupBy("pair_id", "i", "at").agg(F.sort_array(F.collect_list("j")).alias("js")), "open-sources")
    bits = FAN.bit_length() - 1
    levels = [cut_lineage(open_.select("pair_id", F.shiftright("at", bits).alias("node"), F.struct(
        (F.col("at") % FAN).cast("int").alias("c"), F.array_max("js").alias("top")).alias("child")).groupBy("pair_id", "node").agg(
        F.sort_array(F.collect_list("child")).alias("children")), "maxima")]
    while levels[-1].filter("node > 0").head(1):
        up = levels[-1].select("pair_id", F.shiftright("node", bits).alias("up"), F.struct(
            (F.col("node") % FAN).cast("int").alias("c"), F.array_max("children.top").alias("top")).alias("child"))
        levels.append(cut_lineage(up.groupBy("pair_id", F.col("up").alias("node")).agg(F.sort_array(F.collect_list("child")).alias("children")), "maxima"))

    def first_above(children, j, after):
        return F.get(F.filter(children, lambda x: (x["c"] > after) & (x["top"] > j)), F.lit(0))["c"]

    # A start below every target precedes the first source.
    state = open_.select("pair_id", F.col("at"), F.explode("js").alias("j")).unionByName(
        open_.select("pair_id").distinct().select("pair_id", F.lit(-1).cast("long").alias("at"), F.lit(-1).alias("j")))
    todo = state.select("pair_id", "at", "j", F.shiftright("at", bits).alias("node"), F.pmod("at", F.lit(FAN)).cast("int").alias("after"))
    todo = todo.withColumn("after", F.when(F.col("at") < 0, -1).otherwise(F.col("after"))).withColumn("node", F.greatest("node", F.lit(0)))
    found = []  # by the level of the node below which the successor lies
    for level in levels:
        seen = todo.join(level, ["pair_id", "node"]).withColumn("c", first_above(F.col("children"), F.col("j"), F.col("after"))).drop("children")
        seen = cut_lineage(seen, "ascent")
        found.append(seen.filter("c IS NOT NULL").select("pair_id", "at", "j", (F.col("node") * FAN + F.col("c")).alias("node")))
        todo = seen.filter("c IS NULL").select("pair_id", "at", "j", (F.col("node") % FAN).cast("int").alias("after"),
                                               F.shiftright("node", bits).alias("node"))
    down = found[-1]
    for k in range(len(levels) - 2, -1, -1):
        step = down.join(levels[k], ["pair_id", "node"]).select(
            "pair_id", "at", "j", (F.col("node") * FAN + first_above(F.col("children"), F.col("j"), F.lit(-1))).alias("node"))
        down = step.unionByName(found[k])
    targets = open_.select("pair_id", F.col("at").alias("node"), "js")
    link = down.join(targets, ["pair_id", "node"]).select(
        "pair_id", "at", "j", F.col("node").alias("at2"), F.get(F.filter("js", lambda x: x > F.col("j")), F.lit(0)).alias("j2"))
    link = cut_lineage(link, "successors")
    reached = cut_lineage(open_.select("pair_id").distinct().select("pair_id", F.lit(-1).cast("long").alias("at"), F.lit(-1).alias("j")), "reached")
    while not link.isEmpty():
        nxt = reached.join(link, ["pair_id", "at", "j"]).select("pair_id", F.col("at2").alias("at"), F.col("j2").alias("j"))
        reached = cut_lineage(reached.unionByName(nxt), "reached")
        far = link.select("pair_id", F.col("at").alias("at2"), F.col("j").alias("j2"), F.col("at2").alias("at3"), F.col("j2").alias("j3"))
        link = cut_lineage(link.join(far, ["pair_id", "at2", "j2"]).select("pair_id", "at", "j", F.col("at3").alias("at2"), F.col("j3").alias("j2")), "doubled")
    kept = reached.filter("at >= 0").join(open_.select("pair_id", "at", "i"), ["pair_id", "at"]).select("pair_id", "i", "j")
    return kept if strict else kept.unionByName(last)


def union_matches(same: DataFrame, diff: DataFrame) -> DataFrame:
    """SET2."""
    return same.select("pair_id", "i", "j").unionByName(diff.select("pair_id", "i", "j"))


def match_same_tokens(units: DataFrame, vectors: DataFrame, strict: bool = False,
                      ni: DataFrame | None = None) -> DataFrame:
    """ALN0: near-identical matches cleaned to a mostly monotone set."""
    m = cut_lineage(ambiguous_matches(near_identical_tokens(units, vectors, ni)), "same-tokens")
    same = monotone_matches(m.filter(~F.col("ambiguous")))
    diff = monotone_ambiguous(m.filter(F.col("ambiguous")), strict)
    return union_matches(same, diff)


def sorted_distinct(df: DataFrame, col: str, key: str = "pair_id") -> DataFrame:
    """TOP3: sorted distinct values per key (as an array)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(col)).alias(col + "s"))


# ------------------------------------------------------------ residual -----

def drop_matched(units: DataFrame, matches: DataFrame) -> DataFrame:
    """JN8: remove matched source rows and target columns (anti-joins)."""
    s = units.filter(F.col("side") == "src").join(
        matches.select("pair_id", F.col("i").alias("pos")).distinct(), ["pair_id", "pos"], "left_anti")
    t = units.filter(F.col("side") == "trg").join(
        matches.select("pair_id", F.col("j").alias("pos")).distinct(), ["pair_id", "pos"], "left_anti")
    return s.unionByName(t)


def reindex_residual(units: DataFrame) -> DataFrame:
    """WIN5: positions after deletion (0-based, per pair and side)."""
    w = Window.partitionBy("pair_id", "side").orderBy("pos")
    return units.withColumn("rpos", (F.row_number().over(w) - 1).cast("int"))


# ---------------------------------------------------------------- ALN1 -----

def best_match(edges: DataFrame, node: str = "i", other: str = "j") -> DataFrame:
    """TOP2: best partner per node: highest similarity, ties to the smaller index.
    Each Arrow batch sends on its best row per node only, so no edge is sorted or
    shuffled by Spark."""
    e = edges.select("pair_id", node, other, "sim")

    def foremost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, at, to, sim = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            order = np.lexsort((to, -sim, at, pair))
            first = np.ones(len(order), bool)
            first[1:] = (pair[order][1:] != pair[order][:-1]) | (at[order][1:] != at[order][:-1])
            yield b.take(pa.array(order[first]))

    e = e.mapInArrow(foremost, e.schema)
    b = e.groupBy("pair_id", node).agg(F.min(F.struct((-F.col("sim")).alias("ns"), F.col(other))).alias("_b"))
    return b.select("pair_id", node, F.col("_b")[other].alias(other), (-F.col("_b.ns")).alias("sim"))


def _residual(res: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = res.filter(F.col("side") == "src").select("pair_id", F.col("rpos").alias("i"), F.col("cls").alias("a"))
    t = res.filter(F.col("side") == "trg").select("pair_id", F.col("rpos").alias("j"), F.col("cls").alias("b"))
    return s, t


def residual_edges(res: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(pair_id, i, j, sim)`` of the residual units with a similarity above 0."""
    s, t = _residual(res)
    return scored(s.filter("a IS NOT NULL"), t.filter("b IS NOT NULL"), vectors, least=0.0)


def dominant_edges(sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy matching of a similarity matrix over its positive entries, as rounds
    of entries that come first in their row and in their column (ties: the smaller
    index); matched rows and columns leave the matrix."""
    rows, cols = np.arange(sim.shape[0]), np.arange(sim.shape[1])
    left, right = [rows[:0]], [cols[:0]]
    while len(rows) and len(cols):
        there, back = sim.argmax(axis=1), sim.argmax(axis=0)
        at = np.arange(len(rows))
        hit = np.flatnonzero((back[there] == at) & (sim[at, there] > 0))
        if not len(hit):
            break
        left.append(rows[hit])
        right.append(cols[there[hit]])
        free_rows = np.delete(at, hit)
        free_cols = np.delete(np.arange(len(cols)), there[hit])
        rows, cols, sim = rows[free_rows], cols[free_cols], sim[np.ix_(free_rows, free_cols)]
    return np.concatenate(left), np.concatenate(right)


def _match_pairs(rows: pa.Table, unit: np.ndarray) -> Iterator[pa.Table]:
    """Greedy matches of each pair's units ``(pair_id, source, rpos)``, then its
    leftovers by rank of position."""
    for t in V.groups(rows, ["pair_id"], ["rpos"]):
        source, pos, at = t["source"].to_numpy(), t["rpos"].to_numpy(), t["at"].to_numpy()
        s, g = source & (at >= 0), ~source & (at >= 0)
        a, b = dominant_edges(_similarities(unit, at[s], at[g]))
        i, j = pos[s][a], pos[g][b]
        rest_i, rest_j = np.setdiff1d(pos[source], i), np.setdiff1d(pos[~source], j)
        n = min(len(rest_i), len(rest_j))
        yield pa.table({
            "pair_id": pa.array([t["pair_id"][0].as_py()] * (len(i) + n), pa.int64()),
            "i": pa.array(np.concatenate([i, rest_i[:n]]), pa.int32()), "j": pa.array(np.concatenate([j, rest_j[:n]]), pa.int32()),
            "how": pa.array(["greedy"] * len(i) + ["rank"] * n, pa.string())})


def _in_pairs(res: DataFrame) -> DataFrame:
    """Residual units as one block function takes them."""
    return res.select(F.col("pair_id").cast("long"), (F.col("side") == "src").alias("source"), F.col("rpos").cast("int"), "cls")


def align_greedy(res: DataFrame, vectors: DataFrame, stats: dict | None = None) -> DataFrame:
    """ALN1: one-to-one matching of the residual units (re-aim of the exact
    assignment solver).  Greedy matching in the order (sim desc, i, j) over
    edges with sim > 0, as rounds of locally dominant edges.  Units left without
    a positive edge (padding included) are then paired by rank of position.

    Pairs of up to ``PAIR_UNITS`` units a side are matched in one task each, many
    to a block that holds the vectors of its classes (no edge is shuffled); longer ones as rounds over tiled
    edge tables.  Both give the same rows.

    ``res`` = reindexed residual units (``rpos``).  Returns (pair_id, i, j, how).
    """
    size = res.groupBy("pair_id").agg(F.max("rpos").alias("_top"))
    long_pairs = cut_lineage(size.filter(F.col("_top") >= PAIR_UNITS).select("pair_id"), "long-pairs")
    has_long = not long_pairs.isEmpty()
    short = res.join(long_pairs, "pair_id", "left_anti") if has_long else res
    out = V.over_blocks(_in_pairs(short), vectors, ["pair_id"], _match_pairs, "pair_id long, i int, j int, how string")
    if stats is not None:
        stats["rounds"] = 0
    return out.unionByName(_greedy_rounds(res.join(long_pairs, "pair_id", "left_semi"), vectors, stats)) if has_long else out


def _greedy_rounds(res: DataFrame, vectors: DataFrame, stats: dict | None) -> DataFrame:
    """ALN1 over tables.  Every unit points to its best free partner; edges pointed
    to from both ends are matched.  Only units whose partner was taken look at their
    edges again, so a round reads the edges of that frontier and aggregates nothing
    else."""
    e = residual_edges(res, vectors)
    unit = ["pair_id", "side", "u"]
    both = e.select("pair_id", F.explode(F.array(
        F.struct(F.lit("src").alias("side"), F.col("i").alias("u"), F.col("j").alias("v")),
        F.struct(F.lit("trg").alias("side"), F.col("j").alias("u"), F.col("i").alias("v")))).alias("d"), "sim")
    ends = cut_lineage(both.select("pair_id", "d.side", "d.u", "d.v", "sim"), "edge-ends")

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*unit).agg(F.min(F.struct((-F.col("sim")).alias("ns"), "v")).alias("b")).select(*unit, "b.v")

    def as_units(m: DataFrame) -> DataFrame:
        """Both ends of matches as units."""
        return m.select("pair_id", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("i").alias("u")),
                                                     F.struct(F.lit("trg").alias("side"), F.col("j").alias("u")))).alias("d")).select("pair_id", "d.side", "d.u")

    def pointed(units: DataFrame) -> DataFrame:
        """The units as they are pointed to: by the other side."""
        return units.select("pair_id", F.when(F.col("side") == "src", "trg").otherwise("src").alias("side"), F.col("u").alias("v"))

    point = cut_lineage(best(ends), "pointers")
    rounds, greedy = 0, None
    while True:
        there = point.filter("side = 'src'").select("pair_id", F.col("u").alias("i"), F.col("v").alias("j"))
        back = point.filter("side = 'trg'").select("pair_id", F.col("v").alias("i"), F.col("u").alias("j"))
        m = cut_lineage(there.join(back, ["pair_id", "i", "j"]), "matched")
        if m.isEmpty():
            break
        rounds += 1
        greedy = m if greedy is None else greedy.unionByName(m)
        if rounds % 8 == 0:
            greedy = cut_lineage(greedy, "matched-all")
        taken = as_units(m)
        rest = point.join(taken, unit, "left_anti")
        target = ["pair_id", "side", "v"]
        frontier = rest.join(pointed(taken), target, "left_semi").select(*unit)
        again = ends.join(frontier, unit, "left_semi").join(pointed(as_units(greedy)), target, "left_anti")
        point = cut_lineage(rest.join(pointed(taken), target, "left_anti").unionByName(best(again)), "pointers")
    if greedy is None:
        greedy = e.select("pair_id", "i", "j").limit(0)
    s, t = _residual(res)
    greedy = cut_lineage(greedy, "greedy")
    free_s = s.join(greedy.select("pair_id", "i"), ["pair_id", "i"], "left_anti")
    free_t = t.join(greedy.select("pair_id", "j"), ["pair_id", "j"], "left_anti")
    ws = Window.partitionBy("pair_id").orderBy("i")
    wt = Window.partitionBy("pair_id").orderBy("j")
    rank = free_s.withColumn("_r", F.row_number().over(ws)).join(
        free_t.withColumn("_r", F.row_number().over(wt)), ["pair_id", "_r"]).select("pair_id", "i", "j")
    if stats is not None:
        stats["rounds"] = rounds
    return greedy.withColumn("how", F.lit("greedy")).unionByName(rank.withColumn("how", F.lit("rank")))


# ------------------------------------------------------------ ALN3 / 4 -----

def regroup_to_words(res: DataFrame, assign: DataFrame, keep_last: bool = False) -> DataFrame:
    """ALN3 (TOK): join residual source pieces back to words; per word, the
    target pieces matched to its pieces.  Word boundaries are the pieces with
    the marker, plus a final boundary at len-1 (Q5, ``keep_last`` uses len):
    the last residual piece is dropped, pieces before the first boundary too.
    Pairs without residual on either side give no words.

    Pieces and matches meet once, in blocks of whole pairs (Arrow and numpy)."""
    units = cut_lineage(res.select(F.col("pair_id").cast("long"), (F.col("side") == "src").alias("source"), F.col("rpos").cast("int"), "piece"), "pieces-left")
    n = max(1, -(-units.count() // V.BLOCK_ROWS))
    block = F.pmod(F.xxhash64("pair_id"), F.lit(n)).cast("int")
    links = assign.select(F.col("pair_id").cast("long"), F.col("i").cast("int"), F.col("j").cast("int"))

    def words(part: pa.Table, links: pa.Table) -> pa.Table:
        return _words(part.sort_by([("pair_id", "ascending"), ("rpos", "ascending")]), links, keep_last)

    return units.withColumn("_block", block).groupBy("_block").cogroup(links.withColumn("_at", block).groupBy("_at")).applyInArrow(
        words, "pair_id long, k long, s string, t string")


def _words(units: pa.Table, links: pa.Table, keep_last: bool) -> pa.Table:
    """Words ``(pair_id, k, s, t)`` of whole pairs; ``units`` are in order of position."""
    source = units["source"].to_numpy()
    src, trg = units.filter(pa.array(source)), units.filter(pa.array(~source))
    both = np.intersect1d(src["pair_id"].to_numpy(), trg["pair_id"].to_numpy())
    src = src.filter(pa.array(np.isin(src["pair_id"].to_numpy(), both)))
    pair, pos = src["pair_id"].to_numpy(), src["rpos"].to_numpy()
    new = np.concatenate([[True], pair[1:] != pair[:-1]])[:len(pair)]
    first, size = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(pair)))

    def place(table: pa.Table, at: str, pairs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Row of ``table`` with each (pair, position), -1 without one."""
        p, x = table["pair_id"].to_numpy(), table[at].to_numpy()
        order = np.lexsort((x, p))
        every = np.unique(np.concatenate([p, pairs]))
        wide = int(max(x.max(initial=0), wanted.max(initial=0))) + 1
        have, want = np.searchsorted(every, p[order]) * wide + x[order], np.searchsorted(every, pairs) * wide + wanted
        hit = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
        return np.where(have[hit] == want, order[hit], -1) if len(have) else np.full(len(want), -1)

    link = place(links, "i", pair, pos)
    j = np.where(link >= 0, np.append(links["j"].to_numpy(), 0)[link], -1)
    met = np.full(len(pair), -1)
    has = j >= 0
    met[has] = place(trg, "rpos", pair[has], j[has])
    matched = trg["piece"].combine_chunks().take(pa.array(met, mask=met < 0))
    starts = pc.starts_with(src["piece"], MARK).to_numpy().astype(np.int64)
    word = np.cumsum(starts)
    word -= np.repeat((word - starts)[first], size)
    inside = pos < np.repeat(size, size) - (0 if keep_last else 1)
    in_word = word >= 1
    begin = np.flatnonzero(in_word & (new | (starts > 0)))
    kept = np.flatnonzero(in_word & inside)
    offsets = pa.array(np.append(np.searchsorted(kept, begin), len(kept)).astype(np.int32))

    def joined(pieces: pa.Array) -> pa.Array:
        whole = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.fill_null(pieces.take(pa.array(kept)), "")), "")
        return pc.replace_substring(whole, MARK, "")

    return pa.table({"pair_id": pa.array(pair[begin], pa.int64()), "k": pa.array(word[begin], pa.int64()),
                     "s": joined(src["piece"].combine_chunks()), "t": joined(matched)})


def word_level_pairs(res: DataFrame, assign: DataFrame) -> DataFrame:
    """ALN4 (AVG/MAX/FIRST): pairs read straight off the matching."""
    src = res.filter(F.col("side") == "src").select("pair_id", F.col("rpos").alias("i"), F.col("piece").alias("sp"))
    trg = res.filter(F.col("side") == "trg").select("pair_id", F.col("rpos").alias("j"), F.col("piece").alias("tp"))
    j = assign.select("pair_id", "i", "j").join(src, ["pair_id", "i"]).join(trg, ["pair_id", "j"], "left")
    return j.select("pair_id", F.col("i").alias("k"), strip_marker("sp").alias("s"),
                    F.coalesce(strip_marker("tp"), F.lit("")).alias("t"))


# ------------------------------------------------------------------ ALN5 ---

def word_units(pieces: DataFrame, piece_vectors: DataFrame, technique: str) -> tuple[DataFrame, DataFrame]:
    """AVG/MAX/FIRST: combine pieces into words (AGG7) and give every distinct
    word vector a class: the sequence of its piece classes (the first one for
    FIRST).  Word vectors (AGG6) are computed once per class.  Returns
    (units, vectors)."""
    from rtq.functions.text import word_index
    w = word_index(pieces, ["pair_id", "side"], combine_breaks=True)
    words = w.groupBy("pair_id", "side", "word_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece", "cls"))).alias("ps"))
    text = strip_marker(F.array_join(F.transform("ps", lambda x: x["piece"]), ""))
    seq = F.transform("ps", lambda x: F.coalesce(x["cls"].cast("string"), F.lit("_")))
    key = seq[0] if technique == "FIRST" else F.array_join(seq, " ")
    units = words.select("pair_id", "side", (F.col("word_no") - 1).cast("int").alias("pos"),
                         text.alias("piece"), key.alias("cls"))
    units = cut_lineage(units, "words")
    keys = units.select("cls").distinct()
    parts = keys.select("cls", F.posexplode(F.split("cls", " ")).alias("pos", "c")).filter(F.col("c") != "_")
    pv = piece_vectors.select(F.col("cls").cast("string").alias("c"), "embedding")
    vecs = V.combine_word_vectors(parts.join(pv, "c"), ["cls"], technique, "embedding", "pos", word=None)
    return units, vecs.select("cls", F.col("vector").alias("embedding"))


def word_alignment(pieces: DataFrame, piece_vectors: DataFrame, technique: str = "TOK", strict: bool = False,
                   keep_last: bool = False, stats: dict | None = None) -> DataFrame:
    """ALN5: the whole alignment for a table of sentence pairs.

    ``pieces(pair_id, side, pos, piece, cls)``; ``piece_vectors(cls, embedding)``.
    Returns word pairs ``(pair_id, k, s, t)``.
    """
    if technique not in TECHNIQUES:
        raise ValueError(technique)
    if technique == "TOK":
        units, vectors = pieces, piece_vectors
    else:
        units, vectors = word_units(pieces, piece_vectors, technique)
    units = cut_lineage(pad_sides(units))
    vectors = cut_lineage(vectors)
    kept = cut_lineage(match_same_tokens(units, vectors, strict))
    # Padding matches nothing, so it passes by the matches.
    rest = drop_matched(units.filter("cls IS NOT NULL"), kept).unionByName(units.filter("cls IS NULL"))
    res = cut_lineage(reindex_residual(rest))
    assign = align_greedy(res, vectors, stats=stats)
    if technique == "TOK":
        return regroup_to_words(res, assign, keep_last)
    return word_level_pairs(res, assign)


# ---------------------------------------------------------------- ALN2 -----

def scaling(top: float, eps: float) -> list[float]:
    """Falling increments, the last one ``eps``."""
    out, e = [eps], eps * 5
    while e < top / 2:
        out.append(e)
        e *= 5
    return out[::-1]


def auction(value: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner of each column or -1, what each row keeps, price of each column) of a
    matrix whose rows and columns may stay without a partner, which is worth 0.

    Per increment the rows bid for columns, then the columns that have a price left
    and no owner bid for rows, so that whoever has no partner ends at 0.  Prices
    carry over from one increment to the next smaller one."""
    across = np.ascontiguousarray(value.T)
    price = np.zeros(value.shape[1])
    for e in scaling(float(value.max(initial=0.0)), eps):
        keep, mine, owner = np.full(len(value), np.inf), np.full(len(value), -1), np.full(len(price), -1)
        _bid(value, keep, price, mine, owner, e)
        _bid(across, price, keep, owner, mine, e)
    return owner, keep, price


def _bid(value: np.ndarray, keep: np.ndarray, price: np.ndarray, mine: np.ndarray, owner: np.ndarray, e: float) -> None:
    """Rows without a column bid, as long as they would keep anything: for the column
    worth most to them less its price, down to what the second best (or none) is
    worth less the increment.  At all times ``keep + price`` is at least the value
    less ``e``, and equals the value where row and column are partners."""
    while len(free := np.flatnonzero((mine < 0) & (keep > 0))):
        net, at = value[free] - price, np.arange(len(free))
        j = net.argmax(axis=1)
        first = net[at, j]
        net[at, j] = -np.inf
        least = np.maximum(net.max(axis=1) - e, 0.0)
        keep[free[first <= e]] = 0.0
        on = first > e
        i, j, least = free[on], j[on], least[on]
        if not len(i):
            continue
        bid = value[i, j] - least
        order = np.lexsort((i, -bid, j))
        win = order[np.concatenate([[True], j[order][1:] != j[order][:-1]])]
        lost = owner[j[win]]
        mine[lost[lost >= 0]] = -1
        owner[j[win]], mine[i[win]], price[j[win]], keep[i[win]] = i[win], j[win], bid[win], least[win]


def auction_prices(res: DataFrame, vectors: DataFrame, eps: float = 1e-3, stats: dict | None = None) -> DataFrame:
    """ALN2: matching of the residual units by auction with falling increments
    (Bertsekas, forward and reverse).  Units that have a vector bid; those left over,
    padding to a square and units without a vector are worth 0 and are paired by
    rank of position.  Returns ``(pair_id, i, j, price)``, one row per column j with
    its owner i; the total similarity is within n * eps of the optimum, which
    ``auction_certificate`` proves from the prices.  Pairs of up to ``PAIR_UNITS``
    units a side run in one task each; longer ones as rounds over tables, all pairs
    together."""
    s, t = _residual(res)
    n = s.groupBy("pair_id").agg(F.count(F.lit(1)).alias("ns")).join(t.groupBy("pair_id").agg(F.count(F.lit(1)).alias("nt")), "pair_id")
    n = cut_lineage(n.withColumn("n", F.greatest("ns", "nt").cast("int")), "auction-sizes")
    small = res.join(n.filter(F.col("n") <= PAIR_UNITS).select("pair_id"), "pair_id", "left_semi")

    def solve(rows: pa.Table, unit: np.ndarray) -> Iterator[pa.Table]:
        for t in V.groups(rows, ["pair_id"], ["rpos"]):
            owner, price = _sold(t["source"].to_numpy(), t["rpos"].to_numpy(), t["at"].to_numpy(), unit, eps)
            yield pa.table({"pair_id": pa.array([t["pair_id"][0].as_py()] * len(owner), pa.int64()), "i": pa.array(owner, pa.int32()),
                            "j": pa.array(np.arange(len(owner)), pa.int32()), "price": price})

    out = V.over_blocks(_in_pairs(small), vectors, ["pair_id"], solve, "pair_id long, i int, j int, price double")
    large = cut_lineage(n.filter(F.col("n") > PAIR_UNITS).select("pair_id", "n"), "auction-long")
    if not large.isEmpty():
        edges = residual_edges(res.join(large.select("pair_id"), "pair_id", "left_semi"), vectors)
        out = out.unionByName(_auction_rounds(large, edges, eps, stats))
    return out


def _sold(source: np.ndarray, pos: np.ndarray, at: np.ndarray, unit: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, price) of each column of one pair's square.  The side with fewer units
    bids first; both sides end with a price."""
    rows, cols = np.flatnonzero(source & (at >= 0)), np.flatnonzero(~source & (at >= 0))
    n = max(source.sum(), (~source).sum())
    owner, price = np.full(n, -1), np.zeros(n)
    if len(rows) and len(cols):
        value = np.maximum(_similarities(unit, at[rows], at[cols]), 0.0)
        if len(rows) <= len(cols):
            by, _, paid = auction(value, eps)
            j = np.flatnonzero(by >= 0)
            i = by[j]
        else:
            by, paid, _ = auction(np.ascontiguousarray(value.T), eps)
            i = np.flatnonzero(by >= 0)
            j = by[i]
        owner[pos[cols[j]]], price[pos[cols]] = pos[rows[i]], paid
    owner[owner < 0] = np.setdiff1d(np.arange(n), owner)
    return owner, price


def _auction_rounds(sizes: DataFrame, edges: DataFrame, eps: float, stats: dict | None) -> DataFrame:
    """The same auction as rounds over tables: ``edges`` are the positive values, so a
    unit's best and second best are found among its own edges."""
    every = cut_lineage(sizes.select("pair_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x")), "auction-units")
    edges = cut_lineage(edges, "auction-large")
    forward = edges.select("pair_id", F.col("i").alias("x"), F.col("j").alias("y"), "sim")
    backward = edges.select("pair_id", F.col("j").alias("x"), F.col("i").alias("y"), "sim")
    fresh = every.select("pair_id", "x", F.lit(float("inf")).alias("dual"), F.lit(None).cast("int").alias("held"))
    cols = fresh.withColumn("dual", F.lit(0.0))
    top = edges.agg(F.max("sim")).first()[0] or 0.0
    rounds = 0
    for e in scaling(top, eps):
        rows, cols, n = _bid_rounds(forward, fresh, cols.withColumn("held", F.lit(None).cast("int")), e)
        cols, rows, m = _bid_rounds(backward, cols, rows, e)
        rounds += n + m
    if stats is not None:
        stats["rounds"] = rounds
    sold = cols.filter("held IS NOT NULL").select("pair_id", F.col("held").alias("i"), F.col("x").alias("j"), F.col("dual").alias("price"))
    rank = Window.partitionBy("pair_id").orderBy("x")  # numbers only: one row per unit
    left = [t.filter("held IS NULL").select("pair_id", "x", F.row_number().over(rank).alias("_r")).withColumnRenamed("x", x) for t, x in ((rows, "i"), (cols, "j"))]
    return sold.unionByName(left[0].join(left[1], ["pair_id", "_r"]).select("pair_id", "i", "j", F.lit(0.0).alias("price")))


def _bid_rounds(edges: DataFrame, ours: DataFrame, theirs: DataFrame, e: float) -> tuple[DataFrame, DataFrame, int]:
    """``_bid`` over tables ``(pair_id, x, dual, held)`` of both sides: those of ours
    that hold nothing and have a dual above 0 bid along ``edges(pair_id, x, y, sim)``."""
    rounds = 0
    while True:
        free = ours.filter("held IS NULL AND dual > 0").select("pair_id", "x")
        net = edges.join(free, ["pair_id", "x"], "left_semi").join(theirs.select("pair_id", F.col("x").alias("y"), "dual"), ["pair_id", "y"])
        net = net.select("pair_id", "x", "y", "sim", (F.col("sim") - F.col("dual")).alias("w"))
        best = net.groupBy("pair_id", "x").agg(F.max(F.struct("w", (-F.col("y")).alias("ny"), "sim")).alias("b"))
        best = best.select("pair_id", "x", (-F.col("b.ny")).alias("best"), "b.w", "b.sim")
        second = net.join(best.select("pair_id", "x", "best"), ["pair_id", "x"]).filter("y <> best").groupBy("pair_id", "x").agg(F.max("w").alias("w2"))
        least = F.greatest(F.coalesce("w2", F.lit(0.0)) - F.lit(e), F.lit(0.0))
        bids = free.join(best, ["pair_id", "x"], "left").join(second, ["pair_id", "x"], "left").select(
            "pair_id", "x", F.when(F.col("w") > e, F.col("best")).alias("y"), "sim", least.alias("least"))
        bids = cut_lineage(bids, "auction-bids")
        if bids.isEmpty():
            return ours, theirs, rounds
        rounds += 1
        won = bids.filter("y IS NOT NULL").groupBy("pair_id", "y").agg(F.max(F.struct((F.col("sim") - F.col("least")).alias("bid"), (-F.col("x")).alias("nx"), "least")).alias("m"))
        won = cut_lineage(won.select("pair_id", "y", (-F.col("m.nx")).alias("winner"), "m.bid", "m.least"), "auction-won")
        gone = bids.filter("y IS NULL").select("pair_id", "x", F.lit(True).alias("gone"))
        lost = won.select("pair_id", F.col("y").alias("held"), F.lit(True).alias("lost"))
        took = won.select("pair_id", F.col("winner").alias("x"), F.col("y").alias("got"), "least")
        ours = ours.join(lost, ["pair_id", "held"], "left").join(took, ["pair_id", "x"], "left").join(gone, ["pair_id", "x"], "left")
        ours = cut_lineage(ours.select("pair_id", "x", F.when(F.col("gone"), 0.0).otherwise(F.coalesce("least", "dual")).alias("dual"),
                                       F.coalesce("got", F.when(F.col("lost").isNull(), F.col("held"))).alias("held")), "auction-ours")
        paid = won.select("pair_id", F.col("y").alias("x"), "winner", "bid")
        theirs = cut_lineage(theirs.join(paid, ["pair_id", "x"], "left").select(
            "pair_id", "x", F.coalesce("bid", "dual").alias("dual"), F.coalesce("winner", "held").alias("held")), "auction-theirs")


def auction_certificate(res: DataFrame, vectors: DataFrame, prices: DataFrame) -> DataFrame:
    """Proof of a matching: ``(pair_id, n, total, bound, one_to_one)``.  No matching
    of a pair has a greater total similarity than ``bound``, the sum of the prices
    and of every row's best similarity less price (linear programming duality).
    The best of a unit over a tile leaves that tile, no edge does."""
    prices = cut_lineage(prices, "auction-prices")
    paid = prices.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("paid"), F.min("price").alias("least"),
        F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("columns"))
    total = matched_similarity(res, vectors, prices).groupBy("pair_id").agg(F.sum("sim").alias("total"))
    # A row gains at least the negative of the least price from a column without an edge (similarity 0 or more).
    gain = _best_gains(res, vectors, prices).groupBy("pair_id", "i").agg(F.max("gain").alias("gain"))
    every = prices.select("pair_id", "i").join(paid.select("pair_id", "least"), "pair_id").join(gain, ["pair_id", "i"], "left")
    gains = every.groupBy("pair_id").agg(F.sum(F.greatest(F.coalesce("gain", -F.col("least")), -F.col("least"))).alias("gains"))
    out = paid.join(total, "pair_id", "left").join(gains, "pair_id")
    return out.select("pair_id", "n", F.coalesce("total", F.lit(0.0)).alias("total"), (F.col("paid") + F.col("gains")).alias("bound"),
                      ((F.col("rows") == F.col("n")) & (F.col("columns") == F.col("n"))).alias("one_to_one"))


def _best_gains(res: DataFrame, vectors: DataFrame, prices: DataFrame) -> DataFrame:
    """``(pair_id, i, gain)``: a source's best positive similarity less price, one row per tile."""
    s, t = _residual(res.filter("cls IS NOT NULL"))
    t = t.join(prices.select("pair_id", "j", "price"), ["pair_id", "j"])
    units = s.select(F.col("pair_id").cast("long"), F.lit(True).alias("source"), F.col("i").cast("int").alias("at_pos"), F.col("a").alias("cls"), F.lit(0.0).alias("price")).unionByName(
        t.select(F.col("pair_id").cast("long"), F.lit(False).alias("source"), F.col("j").cast("int").alias("at_pos"), F.col("b").alias("cls"), "price"))
    units, keys = dealt(units)

    def gains(rows: pa.Table, unit: np.ndarray) -> Iterator[pa.Table]:
        for tile in V.groups(rows, keys, ["at_pos"]):
            source, pos, at, price = (tile[c].to_numpy() for c in ("source", "at_pos", "at", "price"))
            sim = _similarities(unit, at[source], at[~source])
            gain = np.where(sim > 0, sim - price[~source], -np.inf).max(axis=1, initial=-np.inf)
            has = np.isfinite(gain)
            yield pa.table({"pair_id": pa.array([tile["pair_id"][0].as_py()] * int(has.sum()), pa.int64()),
                            "i": pa.array(pos[source][has], pa.int32()), "gain": gain[has]})

    return V.over_blocks(units, vectors, keys, gains, "pair_id long, i int, gain double", written=True)


def matched_similarity(res: DataFrame, vectors: DataFrame, matches: DataFrame) -> DataFrame:
    """``(pair_id, i, j, sim)`` of the matches of residual units whose similarity is
    above 0; as many rows are shuffled as there are units and matches."""
    units = _in_pairs(res).withColumns({"j": F.lit(None).cast("int")})
    both = units.unionByName(matches.select(F.col("pair_id").cast("long"), F.lit(None).cast("boolean").alias("source"), F.col("i").cast("int").alias("rpos"),
                                            F.lit(None).cast(res.schema["cls"].dataType).alias("cls"), F.col("j").cast("int")))

    def matched(rows: pa.Table, unit: np.ndarray) -> Iterator[pa.Table]:
        for t in V.groups(rows, ["pair_id"]):
            kind, pos, at = t["source"].to_numpy(zero_copy_only=False), t["rpos"].to_numpy(), t["at"].to_numpy()
            link = t.filter(pc.is_null(t["source"]))
            i, j = link["rpos"].to_numpy(), link["j"].to_numpy()
            top = max(pos.max(initial=0), j.max(initial=0)) + 1
            line = np.full((2, top), -1)
            for side in (True, False):
                line[int(side), pos[kind == side]] = at[kind == side]
            a, b = line[1, i], line[0, j]
            keep = (a >= 0) & (b >= 0)
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            sim = np.zeros(len(i))
            for d in range(unit.shape[1]):
                sim += unit[a, d] * unit[b, d]
            keep = sim > 0
            yield pa.table({"pair_id": pa.array([t["pair_id"][0].as_py()] * int(keep.sum()), pa.int64()),
                            "i": pa.array(i[keep], pa.int32()), "j": pa.array(j[keep], pa.int32()), "sim": sim[keep]})

    return V.over_blocks(both, vectors, ["pair_id"], matched, "pair_id long, i int, j int, sim double")


def align_auction(res: DataFrame, vectors: DataFrame, eps: float = 1e-3, stats: dict | None = None) -> DataFrame:
    """ALN2: the matching alone, without padding: ``(pair_id, i, j)``."""
    s, t = _residual(res)
    out = auction_prices(res, vectors, eps, stats).select("pair_id", "i", "j")
    return out.join(s.select("pair_id", "i"), ["pair_id", "i"], "left_semi").join(t.select("pair_id", "j"), ["pair_id", "j"], "left_semi")
