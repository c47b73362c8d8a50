"""Driver queries for classes, sense paths and segment features
(JN9, CLS1, JN11, AGG9, PATH1-PATH7r, AGG8, AGG15, AGG16, SC10).

Input word pairs come from equal positions of source and back translation
(source word k, target word k or ''), so the whole chain after the alignment
has an exact SQL twin.  The DuckDB text unrolls the same level and hop limits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rtq.operators import features as FE
from rtq.operators import lexicon as L
from rtq.operators import paths as P
from rtq.plans.pipeline import classified_words, contributions, first_piece_vectors, lexicon_edges
from rtq.plans.q_align import COS_SQL, D_SP, duck_first_piece, same_position_pairs
from rtq.plans.q_text import DUCK_SEGN, DUCK_TOKS
from rtq.plans.registry import register
from rtq.sources import fixtures as FX
from rtq.session import cut_lineage
from rtq.sources.fixtures import _h, duck_with

USES = ["seg_conv", "nvec", "lemmas", "word_synsets", "synset_edges"]
_SW = ", ".join(f"('en', '{w.replace(chr(39), chr(39) * 2)}')" for w in L.STOPWORDS_EN) + ", " + \
    ", ".join(f"('zh', '{w}')" for w in L.STOPWORDS_ZH_SHORT)

D_SW = ("sw", f"SELECT * FROM (VALUES {_SW}) t(lang, word)")
D_CL = ("cl", """SELECT p.pair_id, p.k, p.s, p.t, g.src_lang, CAST(greatest(length(g.nsrc), 1) AS DOUBLE) AS n,
  (ss.word IS NOT NULL) AS s_stop, (ts.word IS NOT NULL) AS t_stop,
  coalesce(lower(ls.lemma), lower(p.s)) AS s_lemma, coalesce(lower(lt.lemma), lower(p.t)) AS t_lemma
  FROM sp p JOIN segn g ON g.pair_id = p.pair_id
  LEFT JOIN sw ss ON ss.lang = CASE WHEN g.src_lang = 'zh' THEN 'zh' ELSE 'en' END AND ss.word = p.s
  LEFT JOIN sw ts ON ts.lang = CASE WHEN g.src_lang = 'zh' THEN 'zh' ELSE 'en' END AND ts.word = p.t
  LEFT JOIN (SELECT form, min(lemma) AS lemma FROM lemmas GROUP BY form) ls ON ls.form = p.s
  LEFT JOIN (SELECT form, min(lemma) AS lemma FROM lemmas GROUP BY form) lt ON lt.form = p.t""")
D_CLS = ("cls", """SELECT *, CASE
    WHEN cls = 'EXTRA' OR cls = 'MISS' OR cls = 'STOPWORD' THEN 'one_over_n'
    WHEN cls = 'SENSE' AND src_lang = 'zh' AND length(s) < 4 AND length(t) < 4 THEN 'path_surface'
    WHEN cls = 'SENSE' AND src_lang = 'zh' THEN 'cos_surface'
    WHEN cls = 'INFL' OR cls = 'DERI' THEN 'cos_surface'
    WHEN cls = 'SENSE' THEN 'path_lemma' ELSE 'zero' END AS measure FROM (
  SELECT *, CASE
    WHEN s = t THEN 'SAME'
    WHEN s = '' OR (length(t) > 1 AND length(s) < 2) THEN 'EXTRA'
    WHEN t = '' OR (length(t) < 2 AND length(s) > 1) THEN 'MISS'
    WHEN t_stop AND s_stop THEN 'STOPWORD'
    WHEN src_lang = 'zh' THEN 'SENSE'
    WHEN length(s) > 1 AND length(t) > 1 AND s_lemma = t_lemma THEN 'INFL'
    WHEN length(s) > 1 AND length(t) > 1 AND (contains(t_lemma, s_lemma) OR contains(s_lemma, t_lemma)) THEN 'DERI'
    WHEN length(s) > 1 AND length(t) > 1 THEN 'SENSE' ELSE 'NONE' END AS cls FROM cl) x""")
D_REQ = ("wpairs", """SELECT row_number() OVER (ORDER BY w1, w2) AS wp, w1, w2 FROM (
  SELECT DISTINCT s AS w1, t AS w2 FROM cls WHERE measure = 'path_surface'
  UNION SELECT DISTINCT s_lemma, t_lemma FROM cls WHERE measure = 'path_lemma') z""")


def path_ctes(levels: int = P.MAX_LEVELS, hops: int = P.MAX_HOPS) -> list[tuple[str, str]]:
    """DuckDB CTEs for PATH1-PATH7 over ``wpairs(wp, w1, w2)``, unrolled."""
    c = [("wsd", "SELECT DISTINCT lemma, id FROM word_synsets"),
         ("seeds", """SELECT p.wp, 1 AS side, lower(p.w1) AS word, 's:' || CAST(w.id AS VARCHAR) AS node
            FROM wpairs p JOIN wsd w ON w.lemma = lower(p.w1)
          UNION ALL SELECT p.wp, 2, lower(p.w2), 's:' || CAST(w.id AS VARCHAR) FROM wpairs p JOIN wsd w ON w.lemma = lower(p.w2)"""),
         ("hx", """SELECT 's:' || CAST(synset_id AS VARCHAR) AS node, 's:' || CAST(target AS VARCHAR) AS tgt
            FROM synset_edges WHERE relation_group = 'HYPERNYM'"""),
         ("f0", "SELECT wp, side, node, count(*) AS mult FROM seeds GROUP BY wp, side, node"),
         ("r0", "SELECT wp, side, node FROM f0"),
         ("c0", """SELECT DISTINCT a.wp, 0 AS lstar FROM r0 a JOIN r0 b ON a.wp = b.wp AND a.node = b.node
            WHERE a.side = 1 AND b.side = 2"""),
         ("act0", "SELECT wp FROM wpairs WHERE wp NOT IN (SELECT wp FROM c0)")]
    for k in range(1, levels + 1):
        c += [(f"x{k}", f"""SELECT f.wp, f.side, f.node AS x, h.tgt AS y, sum(f.mult) AS mult FROM f{k-1} f
                 JOIN hx h ON h.node = f.node WHERE f.wp IN (SELECT wp FROM act{k-1}) GROUP BY f.wp, f.side, f.node, h.tgt"""),
              (f"f{k}", f"SELECT wp, side, y AS node, sum(mult) AS mult FROM x{k} GROUP BY wp, side, y"),
              (f"r{k}", f"SELECT wp, side, node FROM r{k-1} UNION SELECT wp, side, node FROM f{k}"),
              (f"c{k}", f"""SELECT DISTINCT a.wp, {k} AS lstar FROM r{k} a JOIN r{k} b ON a.wp = b.wp AND a.node = b.node
                 WHERE a.side = 1 AND b.side = 2 AND a.wp IN (SELECT wp FROM act{k-1})"""),
              (f"act{k}", f"SELECT wp FROM act{k-1} WHERE wp NOT IN (SELECT wp FROM c{k})")]
    c.append(("lstar", " UNION ALL ".join(f"SELECT wp, lstar FROM c{k}" for k in range(levels + 1))))
    xs = " ".join(f"UNION ALL SELECT wp, x, y, mult FROM x{k}" for k in range(1, levels + 1))
    c += [("gall", f"SELECT wp, 'w:' || word AS x, node AS y, CAST(1 AS HUGEINT) AS mult FROM seeds {xs}"),
          ("g", """SELECT wp, least(x, y) AS u, greatest(x, y) AS v, CAST(sum(mult) AS BIGINT) AS mult FROM gall
             WHERE wp IN (SELECT wp FROM lstar) GROUP BY wp, least(x, y), greatest(x, y)"""),
          ("deg", """SELECT wp, node, CAST(sum(mult) AS BIGINT) AS deg FROM (SELECT wp, u AS node, mult FROM g
             UNION ALL SELECT wp, v, mult FROM g WHERE u <> v) z GROUP BY wp, node"""),
          ("wg", """SELECT g.wp, g.u, g.v, g.mult,
             ((2.0 - 1.0 / CAST(du.deg AS DOUBLE)) + (2.0 - 1.0 / CAST(dv.deg AS DOUBLE))) / 2.0 AS weight
             FROM g JOIN deg du ON du.wp = g.wp AND du.node = g.u JOIN deg dv ON dv.wp = g.wp AND dv.node = g.v"""),
          ("adj", "SELECT wp, u AS a, v AS b, weight FROM wg WHERE u <> v UNION ALL SELECT wp, v, u, weight FROM wg WHERE u <> v"),
          ("dst", "SELECT wp, 'w:' || lower(w2) AS dst FROM wpairs"),
          ("b0", """SELECT p.wp, 'w:' || lower(p.w1) AS node, 0.0 AS cost, ['w:' || lower(p.w1)] AS path FROM wpairs p
             WHERE p.wp IN (SELECT wp FROM adj)"""),
          ("v0", "SELECT wp, node FROM b0"),
          ("h0", "SELECT b.wp, 0 AS hops, b.cost AS total_weight, b.path FROM b0 b JOIN dst d ON d.wp = b.wp AND d.dst = b.node"),
          ("ab0", "SELECT wp FROM b0 WHERE wp NOT IN (SELECT wp FROM h0)")]
    for h in range(1, hops + 1):
        c += [(f"b{h}", f"""SELECT wp, node, cost, path FROM (
                 SELECT *, row_number() OVER (PARTITION BY wp, node ORDER BY cost, path) AS rn FROM (
                   SELECT b.wp, a.b AS node, b.cost + a.weight AS cost, list_append(b.path, a.b) AS path
                   FROM b{h-1} b JOIN adj a ON a.wp = b.wp AND a.a = b.node WHERE b.wp IN (SELECT wp FROM ab{h-1})) c
                 WHERE NOT EXISTS (SELECT 1 FROM v{h-1} v WHERE v.wp = c.wp AND v.node = c.node)) z WHERE rn = 1"""),
              (f"v{h}", f"SELECT wp, node FROM v{h-1} UNION ALL SELECT wp, node FROM b{h}"),
              (f"h{h}", f"""SELECT b.wp, {h} AS hops, b.cost AS total_weight, b.path FROM b{h} b
                 JOIN dst d ON d.wp = b.wp AND d.dst = b.node"""),
              (f"ab{h}", f"SELECT wp FROM ab{h-1} WHERE wp NOT IN (SELECT wp FROM h{h})")]
    c.append(("sp_path", " UNION ALL ".join(f"SELECT * FROM h{h}" for h in range(hops + 1))))
    c += [("pv", f"""SELECT w AS word, e.embedding FROM (SELECT w1 AS w FROM wpairs UNION SELECT w2 FROM wpairs) x
             JOIN embeddings e ON e.vec_id = {_h(duck_first_piece('x.w'))} % (SELECT n FROM nvec)"""),
          ("dist", f"""SELECT p.wp, p.w1, p.w2, s.total_weight, s.total_weight IS NOT NULL AS has_path,
             CASE WHEN s.total_weight = 0 THEN 0.0 WHEN s.total_weight IS NOT NULL THEN 2.0 * (0.5 - 1.0 / s.total_weight) END AS sense_by_path,
             {COS_SQL} AS sense_by_cosine
             FROM wpairs p LEFT JOIN sp_path s ON s.wp = p.wp
             LEFT JOIN pv a ON a.word = p.w1 LEFT JOIN pv b ON b.word = p.w2""")]
    return c


BASE = [DUCK_SEGN, DUCK_TOKS, D_SP, D_SW, D_CL, D_CLS, D_REQ]


def oracle(body: str) -> str:
    return duck_with(BASE + path_ctes(), body, USES)


def _classified(spark, sf, segs=None):
    pairs = cut_lineage(same_position_pairs(spark, sf, segs), "word-pairs")
    return FE.spread_to_rows(pairs, classified_words(spark, sf, pairs))


def _requests(spark, sf):
    return cut_lineage(FE.numbered_requests(classified_words(spark, sf, same_position_pairs(spark, sf))), "requests")


def _graph(spark, sf):
    req = _requests(spark, sf)
    return req, P.expand_until_connected(req, FX.word_synsets(spark, sf), lexicon_edges(spark, sf))


def _wp(df, req):
    """Replace the internal pair id by the two words."""
    return df.join(req.select("wp", "w1", "w2"), "wp").drop("wp")


@register("JN9_stopword_flags", oracle("SELECT pair_id, k, s_stop, t_stop FROM cl"))
def q_jn9(spark, sf):
    return _classified(spark, sf).select("pair_id", "k", "s_stop", "t_stop")


@register("CLS1_classify_pair", oracle("SELECT pair_id, k, cls, measure FROM cls"))
def q_cls1(spark, sf):
    return _classified(spark, sf).select("pair_id", "k", "cls", "measure")


@register("PATH1_seed_graph", oracle("SELECT p.w1, p.w2, s.side, s.word, s.node FROM seeds s JOIN wpairs p ON p.wp = s.wp"))
def q_path1(spark, sf):
    req = _requests(spark, sf)
    return _wp(P.seed_graph(req, FX.word_synsets(spark, sf)), req).select("w1", "w2", "side", "word", "node")


@register("PATH2_expand_frontier", oracle("""SELECT p.w1, p.w2, x.side, x.x, x.y, CAST(x.mult AS BIGINT) AS mult
  FROM (SELECT f.wp, f.side, f.node AS x, h.tgt AS y, sum(f.mult) AS mult FROM f0 f JOIN hx h ON h.node = f.node
        GROUP BY f.wp, f.side, f.node, h.tgt) x JOIN wpairs p ON p.wp = x.wp"""))
def q_path2(spark, sf):
    req = _requests(spark, sf)
    seeds = P.seed_graph(req, FX.word_synsets(spark, sf))
    frontier = seeds.groupBy("wp", "side", "node").agg(F.count(F.lit(1)).alias("mult"))
    new, _ = P.expand_frontier(frontier, lexicon_edges(spark, sf))
    return _wp(new, req).select("w1", "w2", "side", "x", "y", F.col("mult").cast("bigint"))


@register("PATH2t_expand_frontier_typed", oracle("""SELECT p.w1, p.w2, x.side, x.x, x.y, x.type, CAST(x.mult AS BIGINT) AS mult
  FROM (SELECT f.wp, f.side, f.node AS x, 's:' || CAST(e.target AS VARCHAR) AS y, e.relation_group AS type, sum(f.mult) AS mult
        FROM f0 f JOIN synset_edges e ON 's:' || CAST(e.synset_id AS VARCHAR) = f.node
        WHERE e.relation_group IN ('ANTONYM', 'HYPONYM', 'HYPERNYM', 'OTHER') AND e.language IN ('EN', 'MUL')
        GROUP BY ALL) x JOIN wpairs p ON p.wp = x.wp"""))
def q_path2t(spark, sf):
    req = _requests(spark, sf)
    seeds = P.seed_graph(req, FX.word_synsets(spark, sf))
    frontier = seeds.groupBy("wp", "side", "node").agg(F.count(F.lit(1)).alias("mult"))
    new, _ = P.expand_frontier_typed(frontier, FX.synset_edges(spark, sf), "EN")
    return _wp(new, req).select("w1", "w2", "side", "x", "y", "type", F.col("mult").cast("bigint"))


@register("PATH3_expand_until_connected", oracle("SELECT p.w1, p.w2, CAST(l.lstar AS INTEGER) AS lstar FROM lstar l JOIN wpairs p ON p.wp = l.wp"))
def q_path3(spark, sf):
    req, g = _graph(spark, sf)
    return _wp(g["lstar"], req).select("w1", "w2", F.col("lstar").cast("int"))


@register("PATH4_has_path", oracle("SELECT w1, w2, has_path FROM dist"))
def q_path4(spark, sf):
    req, g = _graph(spark, sf)
    return _wp(P.has_path(req, g["lstar"]), req).select("w1", "w2", "has_path")


@register("AGG8_same_type_degree", oracle("SELECT p.w1, p.w2, d.node, d.deg FROM deg d JOIN wpairs p ON p.wp = d.wp"))
def q_agg8(spark, sf):
    req, g = _graph(spark, sf)
    return _wp(P.same_type_degree(P.graph_edges(g)), req).select("w1", "w2", "node", F.col("deg").cast("bigint"))


@register("PATH6_edge_weight", oracle("SELECT p.w1, p.w2, w.u, w.v, w.mult, w.weight FROM wg w JOIN wpairs p ON p.wp = w.wp"))
def q_path6(spark, sf):
    req, g = _graph(spark, sf)
    return _wp(P.edge_weight(P.graph_edges(g)), req).select("w1", "w2", "u", "v", F.col("mult").cast("bigint"), "weight")


def _paths(spark, sf):
    req, g = _graph(spark, sf)
    weighted = P.edge_weight(P.graph_edges(g))
    return req, g, weighted, P.shortest_hops(req, weighted)


@register("PATH5_shortest_hops", oracle("SELECT p.w1, p.w2, s.hops, s.total_weight FROM sp_path s JOIN wpairs p ON p.wp = s.wp"))
def q_path5(spark, sf):
    req, _, _, sp = _paths(spark, sf)
    return _wp(sp, req).select("w1", "w2", F.col("hops").cast("int"), "total_weight")


@register("PATH5p_path_edges", oracle("""SELECT p.w1, p.w2, CAST(z.step AS INTEGER) AS step, z.a, z.b FROM (
  SELECT wp, unnest(range(len(path) - 1)) AS step, unnest(path[1:len(path) - 1]) AS a, unnest(path[2:]) AS b FROM sp_path) z
  JOIN wpairs p ON p.wp = z.wp"""))
def q_path5p(spark, sf):
    req, _, _, sp = _paths(spark, sf)
    return _wp(P.path_edges(sp), req).select("w1", "w2", F.col("step").cast("int"), "a", "b")


@register("PATH7r_path_weight_raw", oracle("SELECT w1, w2, total_weight FROM dist WHERE has_path"))
def q_path7r(spark, sf):
    req, _, _, sp = _paths(spark, sf)
    return _wp(sp, req).select("w1", "w2", "total_weight")


@register("SC10_path_transform", oracle("SELECT w1, w2, sense_by_path FROM dist WHERE has_path"))
def q_sc10(spark, sf):
    req, _, _, sp = _paths(spark, sf)
    return _wp(sp, req).select("w1", "w2", P.path_transform("total_weight").alias("sense_by_path"))


@register("AGG15_node_depth", oracle("""SELECT p.w1, p.w2, d.node, CAST(min(d.depth) AS INTEGER) AS depth FROM (
  SELECT wp, node, 0 AS depth FROM (SELECT wp, 'w:' || lower(w1) AS node FROM wpairs UNION SELECT wp, 'w:' || lower(w2) FROM wpairs) r
    WHERE wp IN (SELECT wp FROM g)
  UNION ALL SELECT wp, node, hops FROM (
    WITH RECURSIVE bfs(wp, node, hops) AS (
      SELECT wp, 'w:' || lower(w1), 0 FROM wpairs WHERE wp IN (SELECT wp FROM g)
      UNION SELECT wp, 'w:' || lower(w2), 0 FROM wpairs WHERE wp IN (SELECT wp FROM g)
      UNION SELECT b.wp, a.b, b.hops + 1 FROM bfs b JOIN adj a ON a.wp = b.wp AND a.a = b.node WHERE b.hops < 16)
    SELECT wp, node, min(hops) AS hops FROM bfs GROUP BY wp, node) q) d
  JOIN wpairs p ON p.wp = d.wp GROUP BY p.w1, p.w2, d.node"""))
def q_agg15(spark, sf):
    req, g = _graph(spark, sf)
    return _wp(P.node_depth(req, P.graph_edges(g)), req).select("w1", "w2", "node", F.col("depth").cast("int"))


@register("AGG16_root_nodes", oracle("""SELECT p.w1, p.w2, n.node FROM (
  SELECT DISTINCT wp, node FROM (SELECT wp, x AS node FROM gall UNION ALL SELECT wp, y FROM gall) a
  WHERE wp IN (SELECT wp FROM lstar)
    AND NOT EXISTS (SELECT 1 FROM gall b WHERE b.wp = a.wp AND b.y = a.node)) n JOIN wpairs p ON p.wp = n.wp"""))
def q_agg16(spark, sf):
    req, g = _graph(spark, sf)
    return _wp(P.root_nodes(g), req).select("w1", "w2", "node")


@register("PATH7_sense_distance", oracle("""SELECT w1, w2, has_path,
  CASE WHEN has_path THEN sense_by_path ELSE sense_by_cosine END AS distance FROM dist"""))
def q_path7(spark, sf):
    req = _requests(spark, sf)
    words = req.select(F.col("w1").alias("word")).unionByName(req.select(F.col("w2").alias("word")))
    d = P.sense_distance(req, FX.word_synsets(spark, sf), lexicon_edges(spark, sf), first_piece_vectors(spark, sf, words))
    return d.select("w1", "w2", "has_path", "distance")


D_CONTRIB = ("contrib", f"""SELECT c.pair_id, c.k, c.cls, c.measure, CASE
    WHEN c.measure = 'one_over_n' THEN 1.0 / c.n
    WHEN c.measure = 'cos_surface' THEN (SELECT {COS_SQL} FROM fpv2 a, fpv2 b WHERE a.word = c.s AND b.word = c.t)
    WHEN c.measure IN ('path_surface', 'path_lemma') THEN CASE WHEN d.has_path THEN d.sense_by_path ELSE d.sense_by_cosine END
    ELSE 0.0 END AS contrib
  FROM cls c LEFT JOIN dist d ON d.w1 = CASE WHEN c.measure = 'path_lemma' THEN c.s_lemma ELSE c.s END
                             AND d.w2 = CASE WHEN c.measure = 'path_lemma' THEN c.t_lemma ELSE c.t END""")
D_FPV2 = ("fpv2", f"""SELECT w AS word, e.embedding FROM (SELECT DISTINCT s AS w FROM cls UNION SELECT DISTINCT t FROM cls) x
  JOIN embeddings e ON e.vec_id = {_h(duck_first_piece('x.w'))} % (SELECT n FROM nvec)""")


def oracle_contrib(body: str) -> str:
    return duck_with(BASE + path_ctes() + [D_FPV2, D_CONTRIB], body, USES)


def _contribs(spark, sf, segs=None):
    return contributions(spark, sf, same_position_pairs(spark, sf, segs))


@register("JN11_attach_pair_distance", oracle_contrib("SELECT pair_id, k, measure, contrib FROM contrib"))
def q_jn11(spark, sf):
    return _contribs(spark, sf).select("pair_id", "k", "measure", "contrib")


@register("AGG9_segment_features", oracle_contrib("""SELECT s.pair_id,
  coalesce(sum(CASE WHEN c.cls = 'EXTRA' THEN c.contrib ELSE 0.0 END), 0.0) AS "EXTRA",
  coalesce(sum(CASE WHEN c.cls = 'MISS' THEN c.contrib ELSE 0.0 END), 0.0) AS "MISS",
  coalesce(sum(CASE WHEN c.cls = 'STOPWORD' THEN c.contrib ELSE 0.0 END), 0.0) AS "STOPWORD",
  coalesce(sum(CASE WHEN c.cls = 'INFL' THEN c.contrib ELSE 0.0 END), 0.0) AS "INFL",
  coalesce(sum(CASE WHEN c.cls = 'DERI' THEN c.contrib ELSE 0.0 END), 0.0) AS "DERI",
  coalesce(sum(CASE WHEN c.cls = 'SENSE' THEN c.contrib ELSE 0.0 END), 0.0) AS "SENSE"
  FROM seg_conv s LEFT JOIN contrib c ON c.pair_id = s.pair_id GROUP BY s.pair_id"""))
def q_agg9(spark, sf):
    feats = FE.segment_features(FX.seg_conv(spark, sf), _contribs(spark, sf))
    return feats.select("pair_id", "EXTRA", "MISS", "STOPWORD", "INFL", "DERI", "SENSE")


def same_position_features(spark, sf, segs):
    """Six features per segment with word pairs taken by equal position."""
    return FE.segment_features(segs, _contribs(spark, sf, segs))


def labelled_sql(sql: str) -> str:
    """The same text over the labelled documents; the lexicon stays that of the conversations."""
    segments = f"seg_labelled AS ({FX.DUCK['seg_labelled'][1]})"
    sql = sql.replace("FROM seg_conv),", "FROM seg_labelled),", 1).replace("FROM seg_conv s ", "FROM seg_labelled s ")
    return sql.replace("WITH ", f"WITH {segments},\n", 1)
