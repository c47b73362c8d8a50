"""Vector operators: JN5, SC8, SC9, AGG6, INF2 and the class-similarity table.

Token vectors are static (one vector per token id, not contextual), so every
similarity is a function of two *vector classes*.  Similarities are computed
once per distinct class pair and joined back, which bounds the arithmetic by
the vocabulary instead of by the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtq.functions.text import strip_marker
from rtq.session import cut_lineage

NEAR_IDENTICAL = 0.999
MAX_PIVOTS = 1024  # pivots of the metric index, at most
GUARDS = 8  # pivots whose distances are compared before the vectors are
BLOCK_ROWS = 32768  # rows of a block, about


def dot(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, na=None, nb=None) -> Column:
    """SC8: dot / (|a| |b|); 0 when either vector is zero or missing."""
    na = norm(a) if na is None else (F.col(na) if isinstance(na, str) else na)
    nb = norm(b) if nb is None else (F.col(nb) if isinstance(nb, str) else nb)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def token_vector_join(tokens: DataFrame, token_vectors: DataFrame, piece: str = "piece") -> DataFrame:
    """JN5: piece -> (vec_id, embedding); missing token -> null (zero vector)."""
    tv = token_vectors.select(F.col("token").alias("_tok"), "vec_id", "embedding")
    t = tokens.withColumn("_tok", strip_marker(piece))
    return t.join(tv, "_tok", "left").drop("_tok")


def class_vectors(vectors: DataFrame, cls: str = "cls", vec: str = "embedding") -> DataFrame:
    """Distinct classes with their vector, norm and unit vector."""
    v = vectors.select(cls, vec).dropDuplicates([cls])
    v = v.withColumn("_n", norm(vec))
    # The norm enters as a one-element array: as a column it would be computed again for every element.
    unit = F.transform(F.array(norm(vec)), lambda n: F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n)))[0]
    return v.withColumn("unit", unit)


def class_similarity(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b", cls: str = "cls",
                     vec: str = "embedding") -> DataFrame:
    """Cosine for each *distinct* class pair in ``pairs(a, b)``."""
    cv = class_vectors(vectors, cls, vec).select(cls, "unit")
    d = pairs.select(a, b).distinct()
    d = d.join(cv.select(F.col(cls).alias(a), F.col("unit").alias("_ua")), a, "left")
    d = d.join(cv.select(F.col(cls).alias(b), F.col("unit").alias("_ub")), b, "left")
    sim = F.when(F.col("_ua").isNotNull() & F.col("_ub").isNotNull(), dot("_ua", "_ub")).otherwise(F.lit(0.0))
    return d.select(a, b, sim.alias("sim"))


def groups(t: pa.Table, keys: Sequence[str], order: Sequence[str] = ()) -> Iterator[pa.Table]:
    """The groups of a table by ``keys``, each sorted by ``order``."""
    t = t.sort_by([(c, "ascending") for c in (*keys, *order)])
    new = np.zeros(t.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        values = t[k].to_numpy()
        new[1:-1] |= values[1:] != values[:-1]
    ends = np.flatnonzero(new) if t.num_rows else []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield t.slice(a, b - a)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of ``a`` and ``b``, summed dimension by dimension, so
    equal vectors have equal similarities wherever they stand."""
    out, part = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        np.multiply(x[:, None], y[None, :], out=part)
        out += part
    return out


def over_blocks(rows: DataFrame, vectors: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]],
                schema: str, cls: str = "cls", vec: str = "embedding", scaled: bool = True, written: bool = False) -> DataFrame:
    """``fn`` over blocks of ``rows`` with the unit vectors of their classes (as they
    are unless ``scaled``).  ``written``: the rows are a table already.

    Rows that agree in ``keys`` share a block of about ``BLOCK_ROWS`` rows.  Only the
    rows and each block's distinct classes are shuffled, so a vector is sent once per
    block and not once per row.  ``fn(rows, unit)`` sees the rows with ``at``, the line
    of ``unit`` that is their vector (-1: no class, or a class without one)."""
    rows = rows if written else cut_lineage(rows, "block-rows")
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    need = rows.filter(F.col(cls).isNotNull()).select(F.col("_block").alias("_at"), F.col(cls).alias("_cls")).distinct()
    known = class_vectors(vectors, cls, vec).filter(F.col("_n") > 0 if scaled else F.col(vec).isNotNull()).select(F.col(cls).alias("_cls"), F.col(vec).alias("_vec"), "_n")
    need = need.join(known, "_cls")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        known = known.combine_chunks()
        value, size = known["_vec"].combine_chunks(), known["_n"].to_numpy()
        lengths = pc.list_value_length(value).to_numpy(zero_copy_only=False)
        # Shorter vectors count as filled up with zeros.
        unit = np.zeros((len(size), int(lengths.max(initial=0))))
        unit[np.arange(unit.shape[1]) < lengths[:, None]] = value.flatten().to_numpy(zero_copy_only=False)
        if scaled:
            unit /= size[:, None]
        at = pc.fill_null(pc.index_in(part[cls], known["_cls"].combine_chunks()), -1)
        at = pc.if_else(pc.is_null(part[cls]), -1, at)
        out = list(fn(part.drop_columns(["_block"]).append_column("at", at), unit))
        return pa.concat_tables(out).select(names) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return rows.groupBy("_block").cogroup(need.groupBy("_at")).applyInArrow(run, schema)


def _near_pivots(reps: DataFrame, max_pivots: int, slack: float) -> DataFrame:
    """For each ``(rep, unit)`` its nearest pivot and distance ``_home, _least``, the
    pivots at most ``slack`` farther with their distances ``_near, _at``, and the
    distances to the first GUARDS pivots (one matrix product a batch; the other
    distances are not kept).  Pivots are the square root of the row count, at least
    GUARDS and at most ``max_pivots``, taken by the order of a hash: a bounded list
    that the driver reads.  Shorter vectors count as filled up with zeros."""
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("unit")).alias("dims")).first()
    wanted = min(max_pivots, max(GUARDS, math.ceil(math.sqrt(size.n))))
    chosen = reps.select(F.xxhash64("unit").alias("_h"), "rep", "unit").orderBy("_h", "rep").limit(wanted).collect()
    dims = size.dims or 0
    pivots = np.zeros((len(chosen), dims))
    for k, row in enumerate(chosen):
        pivots[k, :len(row.unit)] = row.unit

    def lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))

    def measure(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                part = whole.slice(start, 1024)
                unit = part.column("unit")
                u = np.zeros((len(unit), dims))
                u[np.arange(dims) < unit.value_lengths().to_numpy()[:, None]] = unit.flatten().to_numpy()
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ pivots.T)))
                home = d.argmin(axis=1)
                least = d[np.arange(len(d)), home]
                row, near = np.nonzero(d <= least[:, None] + slack)
                guards = d[:, :GUARDS]
                yield pa.RecordBatch.from_arrays([
                    part.column("rep"), pa.array(home, pa.int32()), pa.array(least), lists(np.bincount(row, minlength=len(d)), near.astype(np.int32)),
                    lists(np.bincount(row, minlength=len(d)), d[row, near]), lists(np.full(len(d), guards.shape[1]), guards.ravel())],
                    names=["rep", "_home", "_least", "_near", "_at", "_guards"])

    kind = reps.schema["rep"].dataType.simpleString()
    return reps.select("rep", "unit").mapInArrow(
        measure, f"rep {kind}, _home int, _least double, _near array<int>, _at array<double>, _guards array<double>")


def near_identical_index(vectors: DataFrame, cls: str = "cls", vec: str = "embedding",
                         threshold: float = NEAR_IDENTICAL, max_pivots: int = MAX_PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Metric index for cosine > threshold: ``members(cls, rep)`` and ``compared(a, b, sim)``.

    Classes with equal unit vectors share a representative (the least class).
    Representatives are compared at distance r = sqrt(2(1-threshold)) or less, by
    the triangle inequality: a vector lives in the cell of its nearest pivot and
    in a shell of width r around it, and looks into the cell of every pivot at
    most 2r farther than its nearest, shells one lower to one higher.  Pairs that
    any of the first GUARDS pivots tells apart go; ``compared`` holds the others
    once (a < b) with their cosine, near or not.  Exact: no pair over the
    threshold is lost.  Zero, null and non-finite vectors have no class here."""
    width = (2.0 * (1.0 - threshold)) ** 0.5 * 1.0001
    cv = class_vectors(vectors, cls, vec).filter(F.col("unit").isNotNull() & ~F.exists("unit", lambda x: F.coalesce(F.isnan(x), F.lit(True))))
    cv = cut_lineage(cv.select(cls, "unit"), "units")
    reps = cut_lineage(cv.groupBy("unit").agg(F.min(cls).alias("rep")), "reps")
    members = cut_lineage(cv.join(reps, "unit").select(cls, "rep"), "members")
    m = _near_pivots(reps, max_pivots, 2 * width)
    m = cut_lineage(m.select("rep", "_home", "_least", "_near", "_at", *[F.get("_guards", F.lit(k)).alias(f"_g{k}") for k in range(GUARDS)]), "near-pivots")
    home = m.select(F.col("rep").alias("b"), F.col("_home").alias("pivot"), F.floor(F.col("_least") / width).alias("shell"),
                    *[F.col(f"_g{k}").alias(f"_h{k}") for k in range(GUARDS)])
    look = m.select(F.col("rep").alias("a"), *[f"_g{k}" for k in range(GUARDS)], F.explode(F.arrays_zip("_near", "_at")).alias("_p"))
    shell = F.floor(F.col("_p._at") / width)
    look = look.select("a", *[f"_g{k}" for k in range(GUARDS)], F.col("_p._near").alias("pivot"), F.explode(F.array(shell - 1, shell, shell + 1)).alias("shell"))
    cand = look.join(home, ["pivot", "shell"]).filter(F.col("a") < F.col("b"))
    for k in range(GUARDS):
        cand = cand.filter(F.coalesce(F.abs(F.col(f"_g{k}") - F.col(f"_h{k}")) <= width, F.lit(True)))
    # Vectors join what is left only.
    cand = cut_lineage(cand.select("a", "b"), "candidates")
    cand = cand.join(reps.select(F.col("rep").alias("a"), F.col("unit").alias("ua")), "a").join(reps.select(F.col("rep").alias("b"), F.col("unit").alias("ub")), "b")
    return members, cand.select("a", "b", dot("ua", "ub").alias("sim"))


def near_identical_halves(members: DataFrame, compared: DataFrame, cls: str = "cls", threshold: float = NEAR_IDENTICAL) -> DataFrame:
    """``(a, rep, sim)``: each class with every representative near it, its own
    included.  Classes with equal vectors are not expanded into pairs."""
    near = compared.filter(F.col("sim") > threshold)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    own = members.select(F.col(cls).alias("a"), "rep", F.lit(1.0).alias("sim"))
    other = members.join(both, F.col("rep") == F.col("a")).select(F.col(cls).alias("a"), F.col("b").alias("rep"), "sim")
    return own.unionByName(other)


def near_identical_classes(vectors: DataFrame, cls: str = "cls", vec: str = "embedding",
                           threshold: float = NEAR_IDENTICAL) -> DataFrame:
    """Class pairs ``(a, b, sim)`` with cosine > threshold, both directions and
    every class with itself, from the metric index."""
    members, compared = near_identical_index(vectors, cls, vec, threshold)
    halves = near_identical_halves(members, compared, cls, threshold)
    return halves.join(members.select("rep", F.col(cls).alias("b")), "rep").select("a", "b", "sim")


def combine_word_vectors(units: DataFrame, key_cols: list[str], agg: str, vec: str = "embedding",
                         order: str = "pos", word: str | None = "word_no") -> DataFrame:
    """AGG6: one vector per word from its pieces: AVG, MAX or FIRST.
    ``units`` carries ``word`` (default ``word_no``; None: the keys name the
    word); the result has ``(key..., [word], vector)``."""
    keys = list(key_cols) + ([word] if word else [])
    if agg == "FIRST":
        return units.groupBy(*keys).agg(F.min_by(F.col(vec), F.col(order)).alias("vector"))
    return _summary(units, keys, agg, vec, "vector")


def _summary(rows: DataFrame, keys: list[str], agg: str, vec: str, out: str) -> DataFrame:
    """Mean or maximum of a vector column per key, position by position: one
    vector a key leaves the map side.  Null vectors do not count."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = array_to_vector(F.col(vec).cast("array<double>"))
    whole = (Summarizer.mean if agg == "AVG" else Summarizer.max)(v)
    return rows.filter(F.col(vec).isNotNull()).groupBy(*keys).agg(whole.alias(out)).withColumn(out, vector_to_array(out))


def word_cosine(word_pairs: DataFrame, first_piece_vectors: DataFrame, s: str = "s", t: str = "t",
                out: str = "cos") -> DataFrame:
    """SC9: cosine of the *first piece* of each word.  ``first_piece_vectors``
    maps ``word -> embedding`` of its first piece (distinct words only)."""
    v = cut_lineage(first_piece_vectors.select("word", "embedding", norm("embedding").alias("_n")), "first-pieces")
    j = word_pairs.join(v.select(F.col("word").alias(s), F.col("embedding").alias("_vs"), F.col("_n").alias("_ns")), s, "left")
    j = j.join(v.select(F.col("word").alias(t), F.col("embedding").alias("_vt"), F.col("_n").alias("_nt")), t, "left")
    return j.withColumn(out, cosine("_vs", "_vt", "_ns", "_nt")).drop("_vs", "_vt", "_ns", "_nt")


def word_sequences(units: DataFrame, key_cols: list[str], order: str = "pos", word: str = "word_no", cls: str = "cls") -> DataFrame:
    """``(key..., word, seq)``: the classes of a word's pieces in order."""
    words = units.filter(F.col(cls).isNotNull()).groupBy(*key_cols, word).agg(F.sort_array(F.collect_list(F.struct(order, cls))).alias("_ps"))
    return words.select(*key_cols, word, F.array_join(F.transform("_ps", lambda x: x[cls].cast("string")), " ").alias("seq"))


def sequence_vectors(seqs: DataFrame, vectors: DataFrame, agg: str, cls: str = "cls", vec: str = "embedding") -> DataFrame:
    """AGG6 once per distinct sequence of classes: ``(seq, vector)``.  Vectors are
    shuffled for the vocabulary, not for every word."""
    parts = seqs.select("seq").distinct().select("seq", F.posexplode(F.split("seq", " ")).alias("pos", "_c"))
    v = vectors.select(F.col(cls).cast("string").alias("_c"), vec)
    return combine_word_vectors(parts.join(v, "_c"), ["seq"], agg, vec, word=None)


def sentence_vectors(tokens: DataFrame, vectors: DataFrame, cls: str = "cls", vec: str = "embedding") -> DataFrame:
    """Mean of the token vectors (fixture sentence encoder) of each ``(pair_id, side)``: ``(pair_id, side, svec)``,
    summed in blocks that hold their classes' vectors once.  Tokens without a vector
    do not count."""
    def means(rows: pa.Table, unit: np.ndarray) -> Iterator[pa.Table]:
        rows = rows.filter(pc.greater_equal(rows["at"], 0))
        for t in groups(rows, ["pair_id", "side"]):
            mean = unit[t["at"].to_numpy()].mean(axis=0)
            yield pa.table({"pair_id": pa.array([t["pair_id"][0].as_py()], pa.int64()), "side": [t["side"][0].as_py()], "svec": [mean]})

    return over_blocks(tokens.select("pair_id", "side", cls), vectors, ["pair_id"], means, "pair_id long, side string, svec array<double>", cls, vec, scaled=False)


def round_trip_similarity(src_vectors: DataFrame, trg_vectors: DataFrame, key: str = "pair_id") -> DataFrame:
    """INF2: cosine of the sentence vectors of a source and its round trip."""
    j = src_vectors.select(key, F.col("svec").alias("a")).join(trg_vectors.select(key, F.col("svec").alias("b")), key)
    return j.select(key, cosine("a", "b").alias("similarity"))
