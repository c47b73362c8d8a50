"""Driver queries for vectors and alignment (SRC8, JN5-JN8, WIN2-WIN6, SC8, SC9,
AGG6, INF2, TOP2, TOP3, SET2, ALN0-ALN5).

The DuckDB oracles compute the same steps from the full similarity product
(the Spark side uses class-level joins and never builds that product for
near-identical matches)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rtq.functions import vectors as V
from rtq.functions.text import char_length_or_1, piece_array, strip_marker, with_end
from rtq.operators import align as A
from rtq.plans.pipeline import first_piece_vectors, piece_vectors, pieces_with_class
from rtq.plans.q_text import DUCK_SEGN, DUCK_TOKS, SPLIT_LONG, seg_normalized
from rtq.plans.registry import register
from rtq.sources import fixtures as FX
from rtq.session import cut_lineage
from rtq.sources.fixtures import _h, duck_with

SEG = ["seg_conv", "nvec"]

D_PCLS = ("pcls", f"""SELECT t.pair_id, t.side, t.pos, t.piece,
  {_h("replace(t.piece, '▁', '')")} % (SELECT n FROM nvec) AS cls FROM toks t""")
D_VECS = ("vecs", """SELECT vec_id AS cls, e, CASE WHEN nn > 0 THEN list_transform(e, lambda x: x / nn) END AS u FROM (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nn
  FROM embeddings) z""")
D_CNT = ("cnt", """SELECT pair_id, sum(CASE WHEN side='src' THEN 1 ELSE 0 END) AS ns,
  sum(CASE WHEN side='trg' THEN 1 ELSE 0 END) AS nt FROM pcls GROUP BY pair_id""")
D_PADS = ("pads", """SELECT pair_id, CASE WHEN ns < nt THEN 'src' ELSE 'trg' END AS side,
  CAST(unnest(range(CAST(least(ns, nt) AS BIGINT), CAST(greatest(ns, nt) AS BIGINT))) AS INTEGER) AS pos
  FROM cnt WHERE ns <> nt""")
D_UNITS = ("units", """SELECT pair_id, side, pos, piece, cls FROM pcls
  UNION ALL SELECT pair_id, side, pos, '▁', CAST(NULL AS BIGINT) FROM pads""")
D_PROD = ("prod", """SELECT s.pair_id, s.pos AS i, t.pos AS j,
  CASE WHEN vs.u IS NOT NULL AND vt.u IS NOT NULL THEN list_dot_product(vs.u, vt.u) ELSE 0.0 END AS sim
  FROM units s JOIN units t ON s.pair_id = t.pair_id AND s.side = 'src' AND t.side = 'trg'
  LEFT JOIN vecs vs ON vs.cls = s.cls LEFT JOIN vecs vt ON vt.cls = t.cls""")
D_MATCH = ("matches", "SELECT pair_id, i, j FROM prod WHERE sim > 0.999")
D_AMB = ("amb", """SELECT m.pair_id, m.i, m.j, c.c > 1 AS ambiguous FROM matches m
  JOIN (SELECT pair_id, i, count(*) AS c FROM matches GROUP BY pair_id, i) c ON c.pair_id = m.pair_id AND c.i = m.i""")
D_SAME = ("same", """SELECT pair_id, i, j FROM (SELECT pair_id, i, j, max(j) OVER (PARTITION BY pair_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM amb WHERE NOT ambiguous) x WHERE j >= m""")
D_FOLD_IN = ("famb", """SELECT pair_id, i, j, row_number() OVER (PARTITION BY pair_id ORDER BY i, j) AS k,
  count(*) OVER (PARTITION BY pair_id) AS n FROM amb WHERE ambiguous""")
D_DIFF = ("diff", """SELECT pair_id, i, j FROM fold WHERE keep""")
FOLD = """fold(pair_id, k, n, i, j, keep, maxj, lasti) AS (
  SELECT pair_id, k, n, i, j, true, j, i FROM famb WHERE k = 1
  UNION ALL
  SELECT a.pair_id, a.k, a.n, a.i, a.j,
    (a.k = a.n) OR (a.i <> f.lasti AND a.j > f.maxj),
    CASE WHEN a.k < a.n AND a.i <> f.lasti AND a.j > f.maxj THEN a.j ELSE f.maxj END,
    CASE WHEN a.k < a.n AND a.i <> f.lasti AND a.j > f.maxj THEN a.i ELSE f.lasti END
  FROM fold f JOIN famb a ON a.pair_id = f.pair_id AND a.k = f.k + 1)"""
D_KEPT = ("kept", "SELECT pair_id, i, j FROM same UNION ALL SELECT pair_id, i, j FROM diff")
D_RES = ("res", """SELECT u.pair_id, u.side, u.pos, u.piece, u.cls,
  CAST(row_number() OVER (PARTITION BY u.pair_id, u.side ORDER BY u.pos) - 1 AS INTEGER) AS rpos FROM units u
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.pair_id = u.pair_id AND
     ((u.side = 'src' AND k.i = u.pos) OR (u.side = 'trg' AND k.j = u.pos)))""")

BASE = [DUCK_SEGN, DUCK_TOKS, D_PCLS, D_VECS, D_CNT, D_PADS, D_UNITS]
MATCH = BASE + [D_PROD, D_MATCH, D_AMB]


def fold_sql(body, extra=()):
    pre = MATCH + [D_SAME, D_FOLD_IN]
    post = [D_DIFF] + list(extra)
    sql = duck_with(pre, "", SEG)
    sql = sql.rstrip() + ",\n" + FOLD + ",\n" + ",\n".join(f"{n} AS ({s})" for n, s in post) + "\n" + body
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _units(spark, sf):
    """Pieces and pads, written once: the matching and the residual read them several times."""
    return cut_lineage(A.pad_sides(cut_lineage(pieces_with_class(spark, sf), "pieces")), "padded")


def _res(spark, sf):
    u = _units(spark, sf)
    pv = piece_vectors(spark, sf)
    return A.reindex_residual(A.drop_matched(u, A.match_same_tokens(u, pv)))


@register("SRC8_load_token_vectors", duck_with(None, """SELECT token, vec_id, len(embedding) AS dims,
  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vsum FROM token_vectors""", ["token_vectors"]))
def q_src8(spark, sf):
    tv = FX.token_vectors(spark, sf)
    return tv.select("token", "vec_id", F.size("embedding").alias("dims"),
                     F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("vsum"))


@register("JN5_token_vector_join", duck_with([DUCK_SEGN, DUCK_TOKS, D_PCLS], "SELECT pair_id, side, pos, cls FROM pcls", SEG))
def q_jn5(spark, sf):
    return pieces_with_class(spark, sf).select("pair_id", "side", "pos", "cls")


@register("WIN6_pad_sides", duck_with(BASE, "SELECT pair_id, side, pos FROM pads", SEG))
def q_win6(spark, sf):
    return _units(spark, sf).filter(F.col("cls").isNull()).select("pair_id", "side", "pos")


@register("SC8_cosine", duck_with([D_VECS], """SELECT a.cls AS vec_id,
  CASE WHEN a.u IS NOT NULL AND b.u IS NOT NULL THEN list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) ELSE 0.0 END AS cos
  FROM vecs a JOIN vecs b ON b.cls = a.cls + 1""", []))
def q_sc8(spark, sf):
    e = FX.table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", V.cosine("a", "b").alias("cos"))


D_PROD_REAL = ("prod_real", D_PROD[1].replace("FROM units s JOIN units t", "FROM pcls s JOIN pcls t"))


@register("JN6_pairwise_similarity", duck_with(BASE + [D_PROD_REAL], "SELECT pair_id, i, j, sim FROM prod_real", SEG))
def q_jn6(spark, sf):
    """Every real source token x every real target token of a pair (padding
    adds only zero similarities and is left out here)."""
    return A.pairwise_similarity(pieces_with_class(spark, sf), piece_vectors(spark, sf))


@register("JN7_near_identical_tokens", duck_with(MATCH, "SELECT pair_id, i, j FROM matches", SEG))
def q_jn7(spark, sf):
    return A.near_identical_tokens(_units(spark, sf), piece_vectors(spark, sf))


@register("JN7c_near_index_bound", duck_with([D_VECS], """SELECT a.cls, count(b.cls) AS n_near, true AS bounded
  FROM vecs a JOIN vecs b ON list_dot_product(a.u, b.u) > 0.999 WHERE a.u IS NOT NULL AND b.u IS NOT NULL GROUP BY a.cls""", []))
def q_jn7c(spark, sf):
    """Every vector: its near-identical vectors, and whether the index compared it with
    no more than four times the square root of the table besides these."""
    vectors = piece_vectors(spark, sf)
    members, compared = V.near_identical_index(vectors)
    compared = cut_lineage(compared, "compared")
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    near = (V.near_identical_halves(members, compared).join(size, "rep").groupBy(F.col("a").alias("cls"))
            .agg(F.sum("n").alias("n_near")))
    ends = compared.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_compared"))
    limit = 4 * F.sqrt(members.select(F.count(F.lit(1))).scalar())
    return near.join(members, "cls").join(ends, "rep", "left").select(
        "cls", "n_near", (F.coalesce("n_compared", F.lit(0)) <= F.col("n_near") + limit).alias("bounded"))


@register("WIN2_ambiguous_matches", duck_with(MATCH, "SELECT pair_id, i, j, ambiguous FROM amb", SEG))
def q_win2(spark, sf):
    return A.ambiguous_matches(A.near_identical_tokens(_units(spark, sf), piece_vectors(spark, sf)))


@register("WIN3_monotone_matches", duck_with(MATCH + [D_SAME], "SELECT pair_id, i, j FROM same", SEG))
def q_win3(spark, sf):
    m = A.ambiguous_matches(A.near_identical_tokens(_units(spark, sf), piece_vectors(spark, sf)))
    return A.monotone_matches(m.filter(~F.col("ambiguous"))).select("pair_id", "i", "j")


@register("WIN4_monotone_ambiguous", fold_sql("SELECT pair_id, i, j FROM diff"))
def q_win4(spark, sf):
    m = A.ambiguous_matches(A.near_identical_tokens(_units(spark, sf), piece_vectors(spark, sf)))
    return A.monotone_ambiguous(m.filter(F.col("ambiguous")))


@register("SET2_union_matches", fold_sql("SELECT pair_id, i, j FROM kept", [D_KEPT]))
def q_set2(spark, sf):
    return A.match_same_tokens(_units(spark, sf), piece_vectors(spark, sf))


@register("ALN0_match_same_tokens", fold_sql("SELECT pair_id, i, j FROM kept", [D_KEPT]))
def q_aln0(spark, sf):
    return A.match_same_tokens(_units(spark, sf), piece_vectors(spark, sf))


@register("TOP3_sorted_distinct", fold_sql("""SELECT pair_id, array_to_string(list_sort(list(DISTINCT i)), ',') AS matched_src
  FROM kept GROUP BY pair_id""", [D_KEPT]))
def q_top3(spark, sf):
    k = A.match_same_tokens(_units(spark, sf), piece_vectors(spark, sf))
    return A.sorted_distinct(k, "i").select("pair_id", F.array_join(F.col("is").cast("array<string>"), ",").alias("matched_src"))


@register("JN8_drop_matched", fold_sql("SELECT pair_id, side, pos FROM res", [D_KEPT, D_RES]))
def q_jn8(spark, sf):
    u = _units(spark, sf)
    return A.drop_matched(u, A.match_same_tokens(u, piece_vectors(spark, sf))).select("pair_id", "side", "pos")


@register("WIN5_reindex_residual", fold_sql("SELECT pair_id, side, pos, rpos FROM res", [D_KEPT, D_RES]))
def q_win5(spark, sf):
    return _res(spark, sf).select("pair_id", "side", "pos", "rpos")


@register("TOP2_best_match", fold_sql("""SELECT pair_id, i, j, sim FROM (
  SELECT p.pair_id, s.rpos AS i, t.rpos AS j, p.sim,
         row_number() OVER (PARTITION BY p.pair_id, s.rpos ORDER BY p.sim DESC, t.rpos) AS rn
  FROM prod p JOIN res s ON s.pair_id = p.pair_id AND s.side = 'src' AND s.pos = p.i
              JOIN res t ON t.pair_id = p.pair_id AND t.side = 'trg' AND t.pos = p.j
  WHERE p.sim > 0) x WHERE rn = 1""", [D_KEPT, D_RES]))
def q_top2(spark, sf):
    e = A.residual_edges(cut_lineage(_res(spark, sf)), piece_vectors(spark, sf))
    return A.best_match(e, "i", "j")


# The rounds of locally dominant edges: an edge is matched in the round in which it
# comes first for both of its ends, the edges of matched ends end there.
D_EDGE = ("edge", """SELECT p.pair_id, s.rpos AS i, t.rpos AS j, p.sim FROM prod p
  JOIN res s ON s.pair_id = p.pair_id AND s.side = 'src' AND s.pos = p.i
  JOIN res t ON t.pair_id = p.pair_id AND t.side = 'trg' AND t.pos = p.j WHERE p.sim > 0""")
D_ALIVE = ("alive(pair_id, i, j, sim, round)", """SELECT pair_id, i, j, sim, 0 FROM edge
  UNION ALL
  SELECT pair_id, i, j, sim, round + 1 FROM (
    SELECT *, bool_or(top) OVER (PARTITION BY pair_id, i) AS i_gone, bool_or(top) OVER (PARTITION BY pair_id, j) AS j_gone FROM (
      SELECT *, row_number() OVER (PARTITION BY pair_id, i ORDER BY sim DESC, j) = 1
            AND row_number() OVER (PARTITION BY pair_id, j ORDER BY sim DESC, i) = 1 AS top FROM alive) a) b
  WHERE NOT i_gone AND NOT j_gone""")
D_GREEDY = ("greedy", """SELECT pair_id, i, j FROM alive QUALIFY
  row_number() OVER (PARTITION BY pair_id, round, i ORDER BY sim DESC, j) = 1 AND row_number() OVER (PARTITION BY pair_id, round, j ORDER BY sim DESC, i) = 1""")
D_LEFT = ("leftover", """SELECT r.pair_id, r.side, r.rpos, row_number() OVER (PARTITION BY r.pair_id, r.side ORDER BY r.rpos) AS nth FROM res r
  WHERE NOT EXISTS (SELECT 1 FROM greedy g WHERE g.pair_id = r.pair_id AND ((r.side = 'src' AND g.i = r.rpos) OR (r.side = 'trg' AND g.j = r.rpos)))""")
D_ASSIGN = ("assign", """SELECT pair_id, i, j, 'greedy' AS how FROM greedy
  UNION ALL SELECT s.pair_id, s.rpos, t.rpos, 'rank' FROM leftover s JOIN leftover t
    ON t.pair_id = s.pair_id AND t.nth = s.nth AND s.side = 'src' AND t.side = 'trg'""")
D_TOKWORDS = ("tokwords", """SELECT pair_id, CAST(word_no AS BIGINT) AS k,
  replace(coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE i < ns - 1), ''), '▁', '') AS s,
  replace(coalesce(string_agg(coalesce(tp, ''), '' ORDER BY i) FILTER (WHERE i < ns - 1), ''), '▁', '') AS t FROM (
  SELECT r.pair_id, r.rpos AS i, r.piece, z.ns, t.piece AS tp,
    sum(CASE WHEN starts_with(r.piece, '▁') THEN 1 ELSE 0 END) OVER (PARTITION BY r.pair_id ORDER BY r.rpos ROWS UNBOUNDED PRECEDING) AS word_no
  FROM res r JOIN (SELECT pair_id, count(*) FILTER (WHERE side = 'src') AS ns, count(*) FILTER (WHERE side = 'trg') AS nt FROM res GROUP BY pair_id) z
    ON z.pair_id = r.pair_id AND z.ns > 0 AND z.nt > 0
  LEFT JOIN assign a ON a.pair_id = r.pair_id AND a.i = r.rpos
  LEFT JOIN res t ON t.pair_id = r.pair_id AND t.side = 'trg' AND t.rpos = a.j WHERE r.side = 'src') w
  WHERE word_no >= 1 GROUP BY pair_id, word_no""")
ASSIGN = [D_KEPT, D_RES, D_EDGE, D_ALIVE, D_GREEDY, D_LEFT, D_ASSIGN]


@register("ALN1_align_greedy", fold_sql("SELECT pair_id, i, j, how FROM assign", ASSIGN))
def q_aln1(spark, sf):
    return A.align_greedy(cut_lineage(_res(spark, sf)), piece_vectors(spark, sf))


EPS = 1e-3


@register("ALN2_align_auction")
def q_aln2(spark, sf):
    """Rows-only: several matchings may be near the optimum; ALN2c checks this one."""
    return A.align_auction(cut_lineage(_res(spark, sf)), piece_vectors(spark, sf), EPS)


@register("ALN2c_auction_certificate", fold_sql("""SELECT z.pair_id, greatest(z.ns, z.nt) AS n, true AS one_to_one, true AS near_optimum,
  coalesce(g.total, 0) <= coalesce(u.bound, 0) + 1e-6 AS below_bound FROM (
  SELECT pair_id, count(*) FILTER (WHERE side = 'src') AS ns, count(*) FILTER (WHERE side = 'trg') AS nt FROM res GROUP BY pair_id) z
  LEFT JOIN (SELECT g.pair_id, sum(e.sim) AS total FROM greedy g JOIN edge e ON e.pair_id = g.pair_id AND e.i = g.i AND e.j = g.j GROUP BY g.pair_id) g
    ON g.pair_id = z.pair_id
  LEFT JOIN (SELECT pair_id, sum(best) AS bound FROM (SELECT pair_id, i, max(sim) AS best FROM edge GROUP BY pair_id, i) b GROUP BY pair_id) u
    ON u.pair_id = z.pair_id
  WHERE z.ns > 0 AND z.nt > 0""", ASSIGN))
def q_aln2c(spark, sf):
    """Every pair's auction, proved by its prices: a one-to-one matching whose total
    is within n * eps of a bound that no matching (the greedy one either) exceeds."""
    res, vectors = cut_lineage(_res(spark, sf)), piece_vectors(spark, sf)
    c = A.auction_certificate(res, vectors, A.auction_prices(res, vectors, EPS))
    greedy = A.matched_similarity(res, vectors, A.align_greedy(res, vectors)).groupBy("pair_id").agg(F.sum("sim").alias("greedy"))
    near = F.col("bound") - F.col("total") <= F.col("n") * EPS + 1e-6
    return c.join(greedy, "pair_id", "left").select("pair_id", "n", "one_to_one", near.alias("near_optimum"),
                                                    (F.coalesce("greedy", F.lit(0.0)) <= F.col("bound") + 1e-6).alias("below_bound"))


@register("ALN3_regroup_to_words", fold_sql("SELECT pair_id, k, s, t FROM tokwords", [*ASSIGN, D_TOKWORDS]))
def q_aln3(spark, sf):
    r = cut_lineage(_res(spark, sf))
    return A.regroup_to_words(r, A.align_greedy(r, piece_vectors(spark, sf)))


@register("ALN5_word_alignment_tok", fold_sql("SELECT pair_id, k, s, t FROM tokwords", [*ASSIGN, D_TOKWORDS]))
def q_aln5(spark, sf):
    return A.word_alignment(pieces_with_class(spark, sf), piece_vectors(spark, sf), "TOK")


@register("ALN4_word_level_pairs_avg")
def q_aln4(spark, sf):
    return A.word_alignment(pieces_with_class(spark, sf), piece_vectors(spark, sf), "AVG")


D_WORDVEC = ("wv", """SELECT pair_id, side, word_no, idx, avg(x) AS v FROM (
  SELECT p.pair_id, p.side, p.word_no, unnest(range(len(e.embedding))) AS idx, unnest(CAST(e.embedding AS DOUBLE[])) AS x
  FROM (SELECT *, CAST(sum(CASE WHEN starts_with(piece, '▁') OR instr('.,?!:', piece) > 0 THEN 1 ELSE 0 END)
     OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS word_no FROM pcls) p
  JOIN embeddings e ON e.vec_id = p.cls WHERE p.word_no >= 1) z GROUP BY pair_id, side, word_no, idx""")


AGG6_SQL = """SELECT pair_id, side, word_no,
  CAST(count(*) AS INTEGER) AS dims, sum(v) AS vsum, max(CASE WHEN idx = 0 THEN v END) AS v0 FROM wv GROUP BY pair_id, side, word_no"""
D_WORDMAX = ("wv", D_WORDVEC[1].replace("avg(x)", "max(x)"))
D_WORDFIRST = ("wv", D_WORDVEC[1].replace("avg(x)", "arg_min(x, pos)").replace("p.word_no, unnest", "p.word_no, p.pos, unnest", 1))


def _word_vectors(spark, sf, technique):
    from rtq.functions.text import word_index
    p = word_index(pieces_with_class(spark, sf), ["pair_id", "side"], combine_breaks=True)
    words = cut_lineage(V.word_sequences(p, ["pair_id", "side"]), "words")
    v = F.transform("vector", lambda x: x.cast("double"))
    digest = V.sequence_vectors(words, piece_vectors(spark, sf), technique).select(
        "seq", F.size("vector").cast("int").alias("dims"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("vsum"), v[0].alias("v0"))
    return words.join(digest, "seq").select("pair_id", "side", "word_no", "dims", "vsum", "v0")


@register("AGG6_combine_word_vectors", duck_with([DUCK_SEGN, DUCK_TOKS, D_PCLS, D_WORDVEC], AGG6_SQL, SEG))
def q_agg6(spark, sf):
    return _word_vectors(spark, sf, "AVG")


@register("AGG6b_word_vectors_max", duck_with([DUCK_SEGN, DUCK_TOKS, D_PCLS, D_WORDMAX], AGG6_SQL, SEG))
def q_agg6b(spark, sf):
    return _word_vectors(spark, sf, "MAX")


@register("AGG6c_word_vectors_first", duck_with([DUCK_SEGN, DUCK_TOKS, D_PCLS, D_WORDFIRST], AGG6_SQL, SEG))
def q_agg6c(spark, sf):
    return _word_vectors(spark, sf, "FIRST")


D_SP = ("sp", """SELECT s.pair_id, s.pos AS k, replace(s.piece, '▁', '') AS s, coalesce(replace(t.piece, '▁', ''), '') AS t
  FROM toks s LEFT JOIN toks t ON t.pair_id = s.pair_id AND t.side = 'trg' AND t.pos = s.pos WHERE s.side = 'src'""")


def same_position_pairs(spark, sf, segs=None):
    """Word pairs by equal position (source word k, target word k or ''), with the
    language and length of their segment.  Both sides of a segment are in one row,
    so their pieces are paired there and no piece is shuffled."""
    # The length is taken before the pieces: a text beside its pieces would be copied for each.
    n = seg_normalized(spark, sf, segs).withColumn("n", char_length_or_1("nsrc").cast("double"))
    source, target = with_end(piece_array("nsrc", SPLIT_LONG)), with_end(piece_array("ntrg", SPLIT_LONG))
    both = F.slice(F.arrays_zip(source.alias("s"), F.coalesce(target, F.array().cast("array<string>")).alias("t")), 1, F.size(source))
    rows = n.select("pair_id", "src_lang", "n", F.posexplode(both).alias("k", "p"))
    return rows.select("pair_id", F.col("k").cast("int"), strip_marker("p.s").alias("s"), F.coalesce(strip_marker("p.t"), F.lit("")).alias("t"),
                       "src_lang", "n")


def duck_first_piece(w):
    return f"CASE WHEN length({w}) > 6 THEN substr({w}, 1, 4) ELSE {w} END"


D_FPV = ("fpv", f"""SELECT w AS word, e.embedding FROM (SELECT DISTINCT s AS w FROM sp UNION SELECT DISTINCT t FROM sp) x
  JOIN embeddings e ON e.vec_id = {_h(duck_first_piece('x.w'))} % (SELECT n FROM nvec)""")
COS_SQL = """CASE WHEN list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) > 0
  AND list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0
  THEN list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
     / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
        * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) ELSE 0.0 END"""


@register("SC9_word_cosine", duck_with([DUCK_SEGN, DUCK_TOKS, D_SP, D_FPV], f"""SELECT p.pair_id, p.k, {COS_SQL} AS cos
  FROM sp p JOIN fpv a ON a.word = p.s JOIN fpv b ON b.word = p.t WHERE p.t <> ''""", SEG))
def q_sc9(spark, sf):
    sp = same_position_pairs(spark, sf).filter("t <> ''")
    words = sp.select(F.col("s").alias("word")).unionByName(sp.select(F.col("t").alias("word")))
    return V.word_cosine(sp, first_piece_vectors(spark, sf, words), "s", "t", "cos").select("pair_id", "k", "cos")


D_SV = ("sv", """SELECT pair_id, side, idx, avg(x) AS v FROM (
  SELECT p.pair_id, p.side, unnest(range(len(e.embedding))) AS idx, unnest(CAST(e.embedding AS DOUBLE[])) AS x
  FROM pcls p JOIN embeddings e ON e.vec_id = p.cls) z GROUP BY pair_id, side, idx""")


@register("INF2_round_trip_similarity", duck_with([DUCK_SEGN, DUCK_TOKS, D_PCLS, D_SV], """SELECT pair_id,
  CASE WHEN na > 0 AND nb > 0 THEN d / (sqrt(na) * sqrt(nb)) ELSE 0.0 END AS similarity FROM (
  SELECT a.pair_id, sum(a.v * b.v) AS d, sum(a.v * a.v) AS na, sum(b.v * b.v) AS nb
  FROM sv a JOIN sv b ON a.pair_id = b.pair_id AND a.idx = b.idx AND a.side = 'src' AND b.side = 'trg' GROUP BY a.pair_id) x""", SEG))
def q_inf2(spark, sf):
    sv = cut_lineage(V.sentence_vectors(pieces_with_class(spark, sf), piece_vectors(spark, sf)), "sentences")
    return V.round_trip_similarity(sv.filter("side = 'src'"), sv.filter("side = 'trg'"))
