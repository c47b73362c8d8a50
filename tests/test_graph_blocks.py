"""Searches in blocks against rounds over tables; lookups of distinct words."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rtq.operators import features as FE
from rtq.operators import paths as P


def _graphs(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "A", "a"), (3, "c", "d"), (4, "e", "f"), (5, "x", "y"), (None, "a", "b")], "wp long, w1 string, w2 string")
    edges = [(1, "w:a", "s:1"), (1, "w:a", "s:2"), (1, "s:1", "s:10"), (1, "s:2", "s:10"), (1, "s:2", "s:9"), (1, "s:9", "w:b"), (1, "s:10", "w:b"),
             (1, "s:10", "s:10"), (1, "s:7", "s:8"), (2, "w:a", "s:4"), (3, "w:c", "s:1"), (3, "s:1", "s:2"), (3, "s:2", "w:d"), (3, "s:1", "s:5"),
             (4, "w:e", "s:1"), (4, "s:2", "w:f"), (6, "w:q", "s:1")]
    weight = {(1, "w:a", "s:1"): 1.5, (1, "s:10", "w:b"): 1.0}
    rows = [(wp, min(u, v), max(u, v), 1, weight.get((wp, u, v), 1.0)) for wp, u, v in edges]
    return pairs, spark.createDataFrame(rows, "wp long, u string, v string, mult long, weight double")


@pytest.mark.parametrize("hops", [1, 3, P.MAX_HOPS])
def test_blocks_and_rounds_agree(spark, monkeypatch, hops):
    pairs, graph = _graphs(spark)

    def results():
        found = {(x.wp, x.hops, x.total_weight, tuple(x.path)) for x in P.shortest_hops(pairs, graph, hops).collect()}
        return found, {tuple(r) for r in P.node_depth(pairs, graph, hops).collect()}

    blocks = results()
    monkeypatch.setattr(P, "GRAPH_EDGES", 0)
    assert results() == blocks
    monkeypatch.setattr(P, "GRAPH_EDGES", 4)  # some graphs each way
    assert results() == blocks
    paths = {x[0]: x for x in blocks[0]}
    assert paths[2] == (2, 0, 0.0, ("w:a",)) and 4 not in paths and 5 not in paths
    if hops >= 3:
        assert paths[1] == (1, 3, 3.0, ("w:a", "s:2", "s:10", "w:b")) and paths[3][3] == ("w:c", "s:1", "s:2", "w:d")
    assert not any(d for wp, node, d in blocks[1] if node.startswith("w:") and wp in (1, 3, 4))


def test_words_are_looked_up_once_each(spark):
    from rtq.plans.pipeline import classified_words
    rows = [(1, k, lang, float(n), s, t) for k, (lang, n, s, t) in enumerate(
        [("en", 5, "the", "of"), ("en", 7, "the", "of"), (None, 4, "the", "of"), ("en", 2, "cat", ""), ("en", 2, "cat", "cat")])]
    pairs = spark.createDataFrame(rows, "pair_id long, k int, src_lang string, n double, s string, t string")
    words = classified_words(spark, SF001, pairs)
    assert words.count() == 4
    none = spark.createDataFrame([], "w1 string, w2 string, distance double, sense_by_path double, sense_by_cosine double, cos double")
    measured = FE.attach_pair_distance(words.withColumn("n", F.lit(None).cast("double")), none, none)
    got = {r.k: (r.cls, r.contrib) for r in FE.spread_to_rows(pairs, measured).collect()}
    assert got == {0: ("STOPWORD", 1 / 5), 1: ("STOPWORD", 1 / 7), 2: ("STOPWORD", 1 / 4), 3: ("MISS", 1 / 2), 4: ("SAME", 0.0)}


def test_pairs_by_position_shuffle_no_piece(spark):
    from rtq.plans.q_align import same_position_pairs
    from rtq.plans.segments import seg_tokens
    segs = spark.createDataFrame([(1, "en-de", "Extraordinary cats, the end", "Cats extraordinarily"), (2, None, "one", None), (3, "de-en", None, "x"),
                                  (4, "fr-en", "", "a b c")], "pair_id long, lp string, src string, trg string")
    pairs = same_position_pairs(spark, SF001, segs)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    side = {"src": {}, "trg": {}}
    for r in seg_tokens(spark, SF001, segs).collect():
        side[r.side][r.pair_id, r.pos] = r.piece.replace("▁", "")
    assert {(r.pair_id, r.k): (r.s, r.t) for r in pairs.collect()} == {k: (s, side["trg"].get(k, "")) for k, s in side["src"].items()}
