"""Operator 10: targets and quotas against brute force, small sources on large tables."""

from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rtq.llm import mixing
from rtq.llm.queries import QUERIES

from conftest import SF001


def brute_targets(sizes):
    """Reshares the excess until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: Fraction(rest * weight[s], sum(weight[t] for t in names if t not in full)) for s in names if s not in full}
        above = {s for s in share if share[s] > 3 * sizes[s]}
        if not above:
            return {s: float(share[s]) if s in share else 3.0 * sizes[s] for s in names}
        full |= above


def by_source(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += r.taken
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "source")
    rows = QUERIES["op10_mixing"](spark, SF001).join(docs, "doc_id").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want, taken = brute_targets(sizes), by_source(rows)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-5) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= 1 + t / 1000 for s, t in want.items())


@pytest.mark.parametrize("repeat", [1, 40])
def test_small_sources_keep_their_share(spark, repeat):
    """Sources of 1 to 213 words beside large ones, whose blocks have up to 256 words."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, "big" + "abc"[i % 3], words(4000)) for i in range(60 * repeat)]
    rows += [(10_000 + n, f"s{n}", words(n)) for n in (1, 2, 40, 90, 213)] + [(20_000, None, words(300)), (20_001, "empty", None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_rows(frame).collect()
    want, taken = brute_targets({r.source: r.source_size for r in out}), by_source(out)
    assert all(abs(taken[s] - t) <= 1 + t / 1000 for s, t in want.items())
    assert taken["s40"] == 120 and taken["s213"] == 639 and taken["empty"] == 0
    mix = {r.source for r in mixing.mix_documents(frame).select("source").distinct().collect()}
    assert mix == set(want) - {"empty"}


def test_quotas_are_highest_quotients(spark):
    cases = [([53.0, 24.0, 23.0, 7.5, 0.0], 17), ([1.0] * 7, 3), ([0.6] * 10 + [4.0], 10), ([1e9, 0.5, 0.5, 0.5], 7), ([2.5] * 4, 10), ([3.0], 0)]
    for targets, seats in cases:
        frame = spark.createDataFrame([(f"k{i:02d}", v) for i, v in enumerate(targets)], "skey string, target double").coalesce(1).cache()
        got = [r.quota for r in mixing.quotas(frame, seats).orderBy("skey").collect()]
        top = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(targets) for k in range(seats) if v), reverse=True)[:seats]
        assert got == [sum(-j == i for _, j in top) for i in range(len(targets))], (targets, seats)


def test_many_sources(spark):
    """A source per document: nothing depends on the number of sources."""
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("d%05d", "id").alias("source"),
                                     F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    out = mixing.mix_rows(frame).collect()
    want = brute_targets({r.source: r.source_size for r in out})
    assert all(abs(r.taken - want[r.source]) <= 1 for r in out) and sum(r.taken for r in out) == sum(r.size for r in out)


def test_clashing_names(spark):
    names = ("row", "key", "skey", "size", "id_hash", "row_hash", "shard", "n_shards", "shard_words", "a", "s", "e", "w", "full", "part", "_own", "_copy", "taken")
    frame = spark.createDataFrame([(1, "x", "one two three"), (2, None, "four")], "doc_id long, source string, text string")
    frame = frame.withColumns({c: F.lit("clash") for c in names})
    out = mixing.mix_rows(frame)
    assert {r.shard_words for r in out.collect()} == {"clash"} and all(r.size > 0 for r in out.collect())
    assert mixing.mix_documents(frame).columns == frame.columns and {r.taken for r in mixing.mix_documents(frame).collect()} == {"clash"}
