
import pytest

from rtq.operators import paths as P

GRAPHS = {
    # name: (synsets of a, synsets of b, hypernym edges, L*, T shipped, d shipped, T typed, d typed)
    "shared": ([1], [1], [], 0, 2.5, 0.2, 0.0, 0.0),
    "common_parent": ([11], [12], [(11, 19), (12, 19)], 1, 5.5, 0.636364, 2.5, 0.2),
    "direct": ([21], [22], [(21, 22)], 1, 4.0, 0.5, 1.0, -1.0),
    "two_levels": ([31], [32], [(31, 33), (33, 37), (32, 34), (34, 37)], 2, 8.5, 0.764706, 5.5, 0.636364),
    "none": ([41], [42], [(41, 43)], None, None, None, None, None),
}


def _frames(spark):
    ws, edges, pairs = [], [], []
    for k, (name, (a, b, e, *_)) in enumerate(GRAPHS.items()):
        ws += [(f"a{k}", i) for i in a] + [(f"b{k}", i) for i in b]
        edges += [(x, y, "HYPERNYM", "EN") for x, y in e]
        pairs.append((k, f"a{k}", f"b{k}"))
    return (spark.createDataFrame(pairs, "wp long, w1 string, w2 string"),
            spark.createDataFrame(ws, "lemma string, id long"),
            spark.createDataFrame(edges, "synset_id long, target long, relation_group string, language string"))


@pytest.mark.parametrize("typed", [False, True])
def test_golden(spark, typed):
    wp, ws, e = _frames(spark)
    out = {r.wp: r for r in P.sense_distance(wp, ws, e, typed=typed).collect()}
    lstar = {r.wp: r.lstar for r in P.expand_until_connected(wp, ws, e, typed=typed)["lstar"].collect()}
    for k, (name, (_, _, _, ls, t_s, d_s, t_t, d_t)) in enumerate(GRAPHS.items()):
        r = out[k]
        T, d = (t_t, d_t) if typed else (t_s, d_s)
        if ls is None:
            assert not r.has_path and k not in lstar, name
            continue
        assert r.has_path, name
        assert lstar[k] == ls, name
        assert r.total_weight == pytest.approx(T), name
        assert r.distance == pytest.approx(d, abs=1e-6), name


def test_swap_symmetry_and_unrelated_edge(spark):
    ws = spark.createDataFrame([("a", 1), ("b", 2)], "lemma string, id long")
    base = [(1, 3), (3, 7), (2, 4), (4, 7)]
    e1 = spark.createDataFrame([(x, y, "HYPERNYM", "EN") for x, y in base],
                               "synset_id long, target long, relation_group string, language string")
    e2 = spark.createDataFrame([(x, y, "HYPERNYM", "EN") for x, y in base + [(90, 91)]],
                               "synset_id long, target long, relation_group string, language string")
    wp = spark.createDataFrame([(1, "a", "b"), (2, "b", "a")], "wp long, w1 string, w2 string")
    d1 = {r.wp: r.distance for r in P.sense_distance(wp, ws, e1).collect()}
    d2 = {r.wp: r.distance for r in P.sense_distance(wp, ws, e2).collect()}
    assert d1[1] == pytest.approx(d1[2])
    assert d1 == pytest.approx(d2)


def test_ancestor_index_against_expansion_per_pair(spark):
    """Levels, walk counts and the meeting level of random graphs (cycles, parallel
    edges, words without a synset) against expanding every pair on its own."""
    import random
    from collections import Counter
    rng = random.Random(7)
    e = [(rng.randrange(25), rng.randrange(25)) for _ in range(30)]
    ws = [(f"w{k}", rng.randrange(25)) for k in range(12) for _ in range(rng.randint(0, 3))]
    pairs = [(f"{a}-{b}", f"W{a}", f"w{b}") for a in range(12) for b in range(0, 12, 2)]
    edges = spark.createDataFrame([(x, y, "HYPERNYM", "EN") for x, y in e], "synset_id long, target long, relation_group string, language string")
    g = P.expand_until_connected(spark.createDataFrame(pairs, "wp string, w1 string, w2 string"),
                                 spark.createDataFrame(ws, "lemma string, id long"), edges)
    want_level, want_edges = {}, Counter()
    for wp, *words in pairs:
        front = [Counter({i: 1 for w, i in set(ws) if w == word.lower()}) for word in words]
        seen, taken = [set(f) for f in front], Counter()
        for level in range(P.MAX_LEVELS + 1):
            if seen[0] & seen[1]:
                want_level[wp] = level
                want_edges.update(taken)
                break
            for side in (0, 1):
                nxt = Counter()
                for x, y in e:
                    if front[side][x]:
                        taken[wp, side + 1, f"s:{x}", f"s:{y}", level + 1] += front[side][x]
                        nxt[y] += front[side][x]
                front[side] = nxt
                seen[side] |= set(nxt)
    assert {r.wp: r.lstar for r in g["lstar"].collect()} == want_level
    got = Counter()
    for r in g["edges"].collect():
        got[r.wp, r.side, r.x, r.y, r.level] += r.mult
    assert got == want_edges and want_edges
