"""Products and means of vectors are made in blocks: neither edges nor vectors per row are shuffled."""

import numpy as np

from rtq.functions import vectors as V
from rtq.operators import align as A


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _units(spark, n=40):
    rows = [(p, side, pos, f"▁{pos}", (3 * pos + p + (side == "src")) % 7 if pos % 5 else None, pos) for p in range(6) for side in ("src", "trg") for pos in range(n)]
    vecs = [(c, [float(np.cos(c * d + d)) for d in range(1, 5)]) for c in range(6)] + [(6, [0.0] * 4)]
    return (spark.createDataFrame(rows, "pair_id long, side string, pos int, piece string, cls long, rpos int"),
            spark.createDataFrame(vecs, "cls long, embedding array<float>"))


def test_no_edge_is_shuffled(spark, monkeypatch):
    res, vecs = _units(spark)
    monkeypatch.setattr(V, "BLOCK_ROWS", 100)
    monkeypatch.setattr(A, "TILE", 16)
    edges = A.pairwise_similarity(res, vecs)
    plan = _plan(edges)
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan[:plan.index("FlatMapCoGroupsInArrow")]
    table = {r.cls: np.array(r.embedding, float) for r in vecs.collect()}
    side = {(r.pair_id, r.side, r.pos): table.get(r.cls, np.zeros(4)) for r in res.collect()}
    got = edges.collect()
    assert len(got) == len({(r.pair_id, r.i, r.j) for r in got}) == 6 * 40 * 40
    for r in got:
        a, b = side[r.pair_id, "src", r.i], side[r.pair_id, "trg", r.j]
        size = np.linalg.norm(a) * np.linalg.norm(b)
        assert abs(r.sim - (a @ b / size if size else 0.0)) < 1e-12


def test_best_match_keeps_the_smaller_index_over_batches(spark):
    rows = [(p, i, j, float((i * j) % 5)) for p in range(3) for i in range(20) for j in range(20)]
    edges = spark.createDataFrame(rows, "pair_id long, i int, j int, sim double").repartition(7)
    plan = _plan(A.best_match(edges))
    assert plan.index("SortAggregate") < plan.index("MapInArrow")
    want = {(p, i): min((-((i * j) % 5), j) for j in range(20)) for p in range(3) for i in range(20)}
    got = {(r.pair_id, r.i): (-r.sim, r.j) for r in A.best_match(edges).collect()}
    assert got == want


def test_auction_and_certificate_keep_no_edges(spark, monkeypatch):
    res, vecs = _units(spark, 12)
    monkeypatch.setattr(A, "residual_edges", None)  # a table of all edges is for pairs over PAIR_UNITS only
    prices = A.auction_prices(res, vecs, 0.01)
    for r in A.auction_certificate(res, vecs, prices).collect():
        assert r.one_to_one and r.n == 12 and 0 <= r.bound - r.total + 1e-9 <= r.n * 0.01 + 2e-9


def test_means_of_sentences_and_words_once_per_sequence(spark):
    rows = [(p, side, pos, pos // 2, (pos + p) % 3) for p in range(3) for side in ("src", "trg") for pos in range(8)]
    tokens = spark.createDataFrame(rows, "pair_id long, side string, pos int, word_no int, cls long")
    vecs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -4.0]), (2, [0.0, 0.0])], "cls long, embedding array<float>")
    table = {r.cls: np.array(r.embedding) for r in vecs.collect()}
    got = {(r.pair_id, r.side): r.svec for r in V.sentence_vectors(tokens, vecs).collect()}
    assert len(got) == 6
    for (p, side), v in got.items():
        assert np.allclose(v, np.mean([table[c] for q, s, _, _, c in rows if (q, s) == (p, side)], axis=0))
    words = V.word_sequences(tokens, ["pair_id", "side"])
    assert words.count() == 24
    by_seq = {r.seq: list(r.vector) for r in V.sequence_vectors(words, vecs, "AVG").collect()}
    assert by_seq == {f"{a} {(a + 1) % 3}": list((table[a] + table[(a + 1) % 3]) / 2) for a in range(3)}


def test_training_rows_are_dealt_by_their_number(spark):
    from rtq.operators import scoring as S
    rows = spark.range(100).repartition(40)
    for per_task, tasks in ((20000, 1), (30, 4)):
        got = S.in_few_tasks(rows, per_task)
        assert got.rdd.getNumPartitions() == tasks and sorted(r.id for r in got.collect()) == list(range(100))
    assert S.in_few_tasks(spark.range(0)).count() == 0


def test_pairs_of_one_tile_are_not_shuffled_for_it(spark, monkeypatch):
    units = spark.range(400).selectExpr("id % 4 AS pair_id", "id % 8 < 4 AS source", "cast(id / 8 AS int) AS at_pos", "id % 7 AS cls")
    rows, keys = A.dealt(units)
    assert keys == ["pair_id"] and sorted(rows.collect()) == sorted(units.collect())
    assert "Exchange" not in _plan(rows) and "Join" not in _plan(rows)
    monkeypatch.setattr(A, "TILE", 16)
    rows, keys = A.dealt(units)
    assert keys == ["pair_id", "_bi", "_bj"] and "Join" not in _plan(rows)
    want = {(r.pair_id, r.source, r.at_pos, r.at_pos // 16 if r.source else o, o if r.source else r.at_pos // 16) for r in units.collect() for o in range(4)}
    got = [(r.pair_id, r.source, r.at_pos, r._bi, r._bj) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_few_word_classes_go_to_the_tokens(spark, monkeypatch):
    """Under the bound no token is shuffled to its word; beyond it the rows are the same, in order."""
    from conftest import SF001
    from rtq.plans import pipeline as PL
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = PL.pieces_with_class(spark, SF001)
        assert "BroadcastHashJoin" in _plan(few) and "Exchange hashpartitioning" not in _plan(few)
        monkeypatch.setattr(PL, "BROADCAST_WORDS", 0)
        many = PL.pieces_with_class(spark, SF001)
        assert "SortMergeJoin" in _plan(many) and _plan(many).index("Sort [pair_id") < _plan(many).index("SortMergeJoin")
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pieces_and_matches_meet_once(spark, monkeypatch):
    """Words of residual pieces over several blocks: no join, no window over a pair."""
    import random
    rng = random.Random(5)
    res = [(p, side, pos, rng.choice(["▁", ""]) + f"{side[0]}{pos}", 3 * pos + 1) for p in range(30) for side in ("src", "trg")
           for pos in range(rng.randint(0 if p % 7 == 0 else 1, 9))]
    piece = {(p, side, pos): text for p, side, pos, text, _ in res}
    size = {(p, side): sum((q, x) == (p, side) for q, x, *_ in res) for p in range(30) for side in ("src", "trg")}
    links = [(p, i, j) for p in range(30) for i, j in zip(rng.sample(range(9), 9), range(9)) if i < size[p, "src"] and j < size[p, "trg"]]
    units = spark.createDataFrame([(p, side, pos, text, pos) for p, side, pos, text, _ in res], "pair_id long, side string, pos int, piece string, rpos int")
    assign = spark.createDataFrame(links, "pair_id long, i int, j int")
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    for keep_last in (False, True):
        words = A.regroup_to_words(units, assign, keep_last)
        assert "Window" not in _plan(words) and "Join" not in _plan(words) and "FlatMapCoGroupsInArrow" in _plan(words)
        want = {}
        for p in range(30):
            k, to = 0, {i: j for q, i, j in links if q == p}
            for i in range(size[p, "src"] if size[p, "trg"] else 0):
                k += piece[p, "src", i].startswith("▁")
                if k:
                    s, t = want.setdefault((p, k), ("", ""))
                    if i < size[p, "src"] - (not keep_last):
                        want[p, k] = s + piece[p, "src", i].replace("▁", ""), t + piece.get((p, "trg", to.get(i)), "").replace("▁", "")
        got = [(r.pair_id, r.k, r.s, r.t) for r in words.collect()]
        assert len(got) == len(want) and {(p, k): (s, t) for p, k, s, t in got} == want
    assert A.regroup_to_words(units.limit(0), assign.limit(0)).count() == 0
