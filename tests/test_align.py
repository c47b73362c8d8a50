"""Alignment: golden cases and invariants on a whole small fixture."""

from rtq.operators import align as A
from rtq.plans.pipeline import piece_vectors, pieces_with_class
from rtq.sources import fixtures as FX

from conftest import SF001


def test_fold_shipped_and_strict(spark):
    m = spark.createDataFrame([(1, i, j) for i, j in [(0, 1), (0, 2), (1, 1), (1, 3), (2, 0), (2, 2)]],
                              "pair_id long, i int, j int")
    shipped = sorted((r.i, r.j) for r in A.monotone_ambiguous(m).collect())
    strict = sorted((r.i, r.j) for r in A.monotone_ambiguous(m, strict=True).collect())
    assert shipped == [(0, 1), (1, 3), (2, 2)]
    assert strict == [(0, 1), (1, 3)]


def test_monotone_unambiguous(spark):
    m = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 2, 3), (1, 3, 5)], "pair_id long, i int, j int")
    assert sorted((r.i, r.j) for r in A.monotone_matches(m).collect()) == [(0, 3), (2, 3), (3, 5)]


def test_greedy_is_one_to_one(spark):
    p = pieces_with_class(spark, SF001, FX.seg_conv(spark, SF001))
    pv = piece_vectors(spark, SF001)
    u = A.pad_sides(p)
    res = A.reindex_residual(A.drop_matched(u, A.match_same_tokens(u, pv)))
    a = A.align_greedy(res, pv)
    assert a.groupBy("pair_id", "i").count().filter("count > 1").count() == 0
    assert a.groupBy("pair_id", "j").count().filter("count > 1").count() == 0


def test_auction_small_instance(spark):
    """ALN2 on hand-built pairs: optimal where greedy is not, padding handled."""
    # pair 1: greedy takes (0,0)=0.9 then (1,1)=0.1 -> 1.0; optimum (0,1)+(1,0) = 0.8+0.8 = 1.6
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.6, 0.8]), (3, [0.0, 1.0])],
                                 "cls long, embedding array<float>")
    # sims: cos(c0,c1)=0.8, cos(c0,c2)=0.6, cos(c3,c1)=0.6, cos(c3,c2)=0.8
    res = spark.createDataFrame([
        (1, "src", 0, "▁a", 1, 0), (1, "src", 1, "▁b", 2, 1),
        (1, "trg", 0, "▁c", 0, 0), (1, "trg", 1, "▁d", 3, 1),
        (2, "src", 0, "▁e", 0, 0), (2, "trg", 0, "▁f", 1, 0), (2, "trg", 1, "▁g", 2, 1)],
        "pair_id long, side string, pos int, piece string, cls long, rpos int")
    out = sorted((r.pair_id, r.i, r.j) for r in A.align_auction(res, vecs, eps=0.01).collect())
    assert out == [(1, 0, 0), (1, 1, 1), (2, 0, 0)]


def _random_residual(spark, seed, pairs=6, size=9):
    import random
    rng = random.Random(seed)
    vecs = [(c, [rng.uniform(-1, 1) for _ in range(4)]) for c in range(12)]
    rows = []
    for p in range(pairs):
        for side in ("src", "trg"):
            for pos in range(rng.randint(1, size)):
                rows.append((p, side, pos, f"▁{pos}", rng.choice([None, *range(12)]), pos))
    return (spark.createDataFrame(rows, "pair_id long, side string, pos int, piece string, cls long, rpos int"),
            spark.createDataFrame(vecs, "cls long, embedding array<float>"))


def test_greedy_takes_edges_in_order(spark, monkeypatch):
    """One task per pair and rounds over tables (several tiles) both equal taking
    edges by (similarity, i, j)."""
    res, vecs = _random_residual(spark, 1, size=12)
    want, used = set(), set()
    edges = sorted(A.residual_edges(res, vecs).collect(), key=lambda r: (-r.sim, r.i, r.j))
    for r in edges:
        if not {(r.pair_id, "s", r.i), (r.pair_id, "t", r.j)} & used:
            used |= {(r.pair_id, "s", r.i), (r.pair_id, "t", r.j)}
            want.add((r.pair_id, r.i, r.j))
    monkeypatch.setattr(A, "TILE", 4)
    tiled = A.residual_edges(res, vecs).collect()
    assert len(tiled) == len(edges) and {(r.pair_id, r.i, r.j) for r in tiled} == {(r.pair_id, r.i, r.j) for r in edges}
    both = []
    for limit in (1024, 5, 0):
        monkeypatch.setattr(A, "PAIR_UNITS", limit)
        rows = A.align_greedy(res, vecs).collect()
        assert {(r.pair_id, r.i, r.j) for r in rows if r.how == "greedy"} == want and len(want) > 10
        both.append(sorted(map(tuple, rows)))
    assert both[0] == both[1] == both[2]


def test_greedy_without_edges(spark):
    """No vector at all: paired by rank; a side without units pairs nothing."""
    res = spark.createDataFrame([
        (1, "src", 0, "▁a", None, 0), (1, "src", 1, "▁b", None, 1), (1, "trg", 0, "▁c", None, 0),
        (2, "src", 0, "▁a", 0, 0), (3, "trg", 0, "▁a", 0, 0),
        (4, "src", 0, "▁a", 1, 0), (4, "trg", 0, "▁a", 0, 0)],
        "pair_id long, side string, pos int, piece string, cls long, rpos int")
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "cls long, embedding array<float>")
    assert sorted(map(tuple, A.align_greedy(res, vecs).collect())) == [(1, 0, 0, "rank"), (4, 0, 0, "rank")]
    assert A.align_greedy(res.limit(0), vecs).count() == 0


def test_auction_is_certified_and_optimal(spark, monkeypatch):
    """Whole fixture certified; small pairs equal the best permutation, by both ways."""
    import itertools
    res, vecs = _random_residual(spark, 2, pairs=3, size=4)
    sims = {(r.pair_id, r.i, r.j): r.sim for r in A.residual_edges(res, vecs).collect()}
    for limit in (A.PAIR_UNITS, 0):
        monkeypatch.setattr(A, "PAIR_UNITS", limit)
        eps = 0.1
        for r in A.auction_certificate(res, vecs, A.auction_prices(res, vecs, eps)).collect():
            best = max(sum(sims.get((r.pair_id, i, j), 0.0) for i, j in enumerate(p)) for p in itertools.permutations(range(r.n)))
            assert r.one_to_one and r.total <= best + 1e-9 <= r.bound + 2e-9 and r.bound - r.total <= r.n * eps + 1e-9
    monkeypatch.undo()


def test_running_maximum_over_blocks(spark, monkeypatch):
    import random
    rng = random.Random(3)
    rows = [(p, i, rng.randrange(40)) for p in range(3) for i in rng.sample(range(60), 30)]
    m = spark.createDataFrame(rows, "pair_id long, i int, j int")
    monkeypatch.setattr(A, "BLOCK", 7)
    want, top = [], {}
    for p, i, j in sorted(rows):
        top[p] = max(top.get(p, -1), j)
        want += [(p, i, j)] if j >= top[p] else []
    assert sorted(map(tuple, A.monotone_matches(m).select("pair_id", "i", "j").collect())) == want


def test_search_equals_fold(spark, monkeypatch):
    """Long pairs (successors and pointer doubling) keep what the fold keeps."""
    import random
    rng = random.Random(4)
    rows = [(p, i, j) for p in range(4) for i in range(0, 40, 1 + p) for j in rng.sample(range(45), rng.randint(1, 4))]
    m = spark.createDataFrame(rows, "pair_id long, i int, j int")
    for strict in (False, True):
        monkeypatch.setattr(A, "FOLD", 4096)
        fold = sorted(map(tuple, A.monotone_ambiguous(m, strict).collect()))
        monkeypatch.setattr(A, "FOLD", 3)
        monkeypatch.setattr(A, "FAN", 4)
        assert sorted(map(tuple, A.monotone_ambiguous(m, strict).select("pair_id", "i", "j").collect())) == fold


def test_units_without_a_partner_do_not_bid(monkeypatch):
    """20 units a side among 300: those that are worth 0 to each other start no price war,
    and units that compete for too few equal ones are settled by the increments."""
    import numpy as np
    rng = np.random.default_rng(0)
    padded, few = np.zeros((300, 300)), np.zeros((60, 60))
    padded[:20, :] = np.maximum(rng.normal(0, 0.15, (20, 300)), 0)
    few[:, :57] = 0.9 + rng.random((60, 1)) / 20  # three rows more than columns
    sort, rounds = np.lexsort, []
    monkeypatch.setattr(A.np, "lexsort", lambda keys: rounds.append(1) or sort(keys))
    for value in (padded, few):
        rounds.clear()
        owner, *_, price = A.auction(value, 1e-3)
        assert len(rounds) < 1200
        has = np.flatnonzero(owner >= 0)
        total, bound = value[owner[has], has].sum(), price.sum() + np.maximum((value - price).max(axis=1), 0).sum()
        assert len(set(owner[has])) == len(has) and -1e-9 <= bound - total <= len(value) * 1e-3 + 1e-9
