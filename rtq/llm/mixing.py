"""Mixing sources to target weights (operator 10): Sainte-Lague apportionment.

Every source gets a share of the words by weight, at most ``max_repeats`` times
its own size; what is over goes to the others by weight.  The shares are handed
out by highest quotients target / (2q + 1): first as words to the sources, then
within a source as blocks of equal word count to its shards.  So quotas are whole
numbers that add up exactly.  A block has a part in ``LEAST_BLOCKS`` of its source's target, 1
to ``MAX_BLOCK_WORDS`` words, so a source's taken words differ from its target by
at most a word or such a part, however large the table is.  A shard lays out its
documents in seeded order as a ring of words cut into blocks; its quota takes the
whole ring as often as it fits and for the rest a run of blocks from a seeded
start.

Sources stay a table: their rank comes from a range sort with an offset per task,
the water level and the divisor of the quotients from rounds of aggregates, so a
source may be a domain.  A hot source is dealt over as many shards as its size
asks for; the only group that meets in one task are the shards of one source, as
numbers (at most ``MAX_SHARDS``).

Defined cases: a null text has size 0 and is never taken; null sources form one
source, ordered last; repeated rows count one by one (which of them is taken is
undefined, how many is not); an empty table gives no rows; input columns are
kept by ``mix_rows``, and columns added here replace columns of the same name.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rtq.llm.queries import register, table
from rtq.session import cut_lineage

GAP = r"[\x20\x09-\x0D]+"
SEED = 20240607
MAX_REPEATS = 3
#: Words a shard holds, and how many shards a source may have.
SHARD_WORDS, MAX_SHARDS = 1_000_000, 65_536
#: The largest block in words, and how many blocks a source's target has at least.
MAX_BLOCK_WORDS, LEAST_BLOCKS = 256, 100_000
#: Divisors tried by one aggregate.
TRIES = 24


def source_key(source: Column) -> Column:
    """Joins null with null; sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def apportion(targets: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Lague: the ``seats`` highest quotients target / (2q + 1), ties to the
    earlier entry, none above its cap."""
    v = np.asarray(targets, float)
    caps = np.where(v > 0, np.iinfo(np.int64).max if caps is None else caps, 0).astype(np.int64)
    total = v.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(v), np.int64)
    q = np.minimum(np.floor(v * (seats / total) + 0.5).astype(np.int64), caps)
    spare = seats - int(q.sum())
    if spare > 0:
        heap = [(-v[i] / (2 * q[i] + 1), i) for i in range(len(v)) if q[i] < caps[i]]
        heapq.heapify(heap)
        while spare > 0 and heap:
            _, i = heapq.heappop(heap)
            q[i] += 1
            spare -= 1
            if q[i] < caps[i]:
                heapq.heappush(heap, (-v[i] / (2 * q[i] + 1), i))
    elif spare < 0:
        heap = [(v[i] / (2 * q[i] - 1), -i) for i in range(len(v)) if q[i] > 0]
        heapq.heapify(heap)
        while spare < 0:
            _, i = heapq.heappop(heap)
            i = -i
            q[i] -= 1
            spare += 1
            if q[i] > 0:
                heapq.heappush(heap, (v[i] / (2 * q[i] - 1), -i))
    return q


def ranked(sizes: DataFrame) -> DataFrame:
    """``skey, source_size`` with ``weight`` (1, 2, 3, repeating by code point)."""
    dealt = sizes.repartitionByRange("skey").sortWithinPartitions("skey")
    dealt = cut_lineage(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "mix-ranked")
    per_task = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per task
    offsets = F.broadcast(per_task.select("part", "low", before.alias("before")))
    rank = F.col("before") + F.col("at") - F.col("low")
    return dealt.join(offsets, "part").select("skey", "source_size", (rank % 3 + 1).alias("weight"))


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``skey, source_size``.  A source above its cap
    gets the cap; the level of the others rises until no further one is above."""
    s = cut_lineage(ranked(sizes), "mix-weights")
    cap = (F.lit(max_repeats) * F.col("source_size")).cast("double")
    level, n_full = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > cap
        zero = F.lit(0)
        r = s.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size")).otherwise(zero)),
                  F.sum(F.when(full, zero).otherwise(F.col("weight"))), F.count_if(full)).first()
        if not r[0] or r[3] == n_full:
            break
        n_full, level = r[3], (r[0] - max_repeats * r[1]) / r[2]
    return s.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def quotas(targets: DataFrame, seats: int) -> DataFrame:
    """Sainte-Lague over a table: ``skey, target`` with ``quota``, the ``seats`` highest
    quotients target / (2q + 1), ties to the earlier key.  The divisor that rounds
    the targets to ``seats`` is found by aggregates over ``TRIES`` divisors each."""
    def rounded(d: float) -> Column:
        return F.floor(F.col("target") / F.lit(d) + F.lit(0.5))

    def sums(tries: list[float]) -> list[int]:
        return [x or 0 for x in targets.agg(*(F.sum(rounded(d)) for d in tries)).first()]

    if seats <= 0:
        return targets.withColumn("quota", F.lit(0).cast("long"))
    low, high = 0.5, 2.0  # too many seats, or enough; and too few, or enough
    exact = None
    n_low, n_high = sums([low, high])
    while n_low < seats:
        low /= 2
        n_low = sums([low])[0]
    while n_high > seats:
        high *= 2
        n_high = sums([high])[0]
    while exact is None and np.nextafter(low, high) < high:
        tries = sorted(set(np.linspace(low, high, TRIES + 2)))
        for d, n in zip(tries, sums(tries), strict=True):
            if n == seats:
                exact = d
                break
            if n > seats:
                low = max(low, d)
            else:
                high = min(high, d)
    if exact is not None:
        return targets.withColumn("quota", rounded(exact).cast("long"))
    # Several sources share the last quotient: the first ones by key get the seats left.
    tied = targets.where(rounded(low) > rounded(high)).orderBy("skey").limit(seats - sums([high])[0]).select("skey", F.lit(1).alias("more"))
    return targets.join(tied, "skey", "left").withColumn("quota", (rounded(high) + F.coalesce("more", F.lit(0))).cast("long")).drop("more")


def _shard_quotas(max_repeats: int):
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words, block = pdf["shard_words"].to_numpy(), pdf["block"].to_numpy()
        n = np.where(words > 0, np.maximum(1, (words + block // 2) // block), 0)
        seats = int(round(pdf["quota"].iloc[0] * n.sum() / max(1, words.sum())))  # blocks of the source's quota of words
        q = apportion(words, seats, max_repeats * n)
        return pdf.assign(n_blocks=n, shard_quota=q)
    return deal


def plan_mix(sized: DataFrame, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """From rows (skey, id_hash, size): the table of sources with target, block
    and number of shards, and the table of shards with their quotas."""
    totals = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    s = cut_lineage(source_targets(totals, max_repeats), "mix-targets")
    words = s.agg(F.sum("source_size")).first()[0] or 0
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK_WORDS), F.floor(F.col("target") / LEAST_BLOCKS))).cast("long")
    s = quotas(s, words).withColumns({
        "block": block,
        "n_shards": F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("long")})
    sources = cut_lineage(s, "mix-sources")
    parts = sized.join(sources, "skey").groupBy("skey", "block", "quota", shard_of().alias("shard")).agg(F.sum("size").alias("shard_words"))
    shards = cut_lineage(parts.groupBy("skey").applyInPandas(
        _shard_quotas(max_repeats), "skey string, block long, quota long, shard long, shard_words long, n_blocks long, shard_quota long"), "mix-shards")
    return sources, shards


def shard_of() -> Column:
    return F.pmod(F.col("id_hash"), F.col("n_shards"))


def _n_words(text: Column) -> Column:
    """Parts between gaps, without the empty ones a leading or trailing gap leaves."""
    return F.size(F.split(text, GAP)) - text.rlike(r"^[\x20\x09-\x0D]").cast("int") \
        - text.rlike(r"[\x20\x09-\x0D]\z").cast("int") - (text == "").cast("int")


ADDED = ("size", "source_size", "target", "taken", "copies")


def _mixed(rows: DataFrame, keep: list[str], key: str, source: str, text: str, max_repeats: int, seed: int) -> DataFrame:
    """``row`` (a struct of the columns ``keep``) and the added columns."""
    own = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0))
    sized = rows.select(own.alias("row"), F.col(key).alias("key"), source_key(F.col(source)).alias("skey"),
                        F.coalesce(_n_words(F.col(text)), F.lit(0)).cast("long").alias("size"),
                        F.xxhash64(F.lit(seed), F.col(key)).alias("id_hash"), F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)).alias("row_hash"))
    sources, shards = plan_mix(cut_lineage(sized.select("skey", "id_hash", "size"), "mix-sizes"), max_repeats)
    placed = sized.join(sources.select("skey", "source_size", "target", "n_shards"), "skey").withColumn("shard", shard_of())
    ring = Window.partitionBy("skey", "shard").orderBy("row_hash", "key", "size")
    placed = placed.withColumn("a", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    run = shards.select("skey", "shard", "shard_words", "n_blocks", "shard_quota")
    # A run of blocks from a seeded start, as words [s, e) of the ring; e may lie past its end.
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "skey", "shard"), F.greatest(F.lit(1), "n_blocks"))
    last = first + F.pmod("shard_quota", F.greatest(F.lit(1), "n_blocks"))
    at = lambda b: F.floor(b / F.col("n_blocks")) * F.col("shard_words") + F.floor((b % F.col("n_blocks")) * F.col("shard_words") / F.col("n_blocks"))
    run = run.withColumns({"s": F.when(F.col("n_blocks") > 0, at(first)).otherwise(F.lit(0)),
                           "e": F.when(F.col("n_blocks") > 0, at(last)).otherwise(F.lit(0)),
                           "full": F.when(F.col("n_blocks") > 0, F.floor(F.col("shard_quota") / F.col("n_blocks"))).otherwise(F.lit(0))})
    placed = placed.join(run, ["skey", "shard"])
    a, b, s, e, w = F.col("a"), F.col("a") + F.col("size"), F.col("s"), F.col("e"), F.col("shard_words")
    zero = F.lit(0).cast("long")
    placed = placed.withColumn("part", F.greatest(zero, F.least(b, e) - F.greatest(a, s)) + F.greatest(zero, F.least(b, e - w) - a))
    most = (F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))
    taken = (F.col("full") * F.col("size") + F.col("part")).cast("long")
    copies = F.when(F.col("size") > 0, F.col("full") + most.cast("int")).otherwise(F.lit(0)).cast("int")
    return placed.select("row", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def mix_rows(rows: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
             max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Every row with its ``size``, ``source_size``, ``target``, the words the mix
    takes from it (``taken``) and how often it is part of the mix as a whole
    (``copies``: a part counts from half its words on)."""
    keep = [c for c in rows.columns if c not in ADDED]
    return _mixed(rows, keep, key, source, text, max_repeats, seed).select(*(F.col("row")[c].alias(c) for c in keep), *ADDED)


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                  max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix as whole documents: each row ``copies`` times."""
    out = _mixed(docs, docs.columns, key, source, text, max_repeats, seed).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


@register("op10_mixing")
def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_rows(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
