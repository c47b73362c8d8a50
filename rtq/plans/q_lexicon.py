"""Driver queries for lexicon operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rtq.operators import lexicon as L
from rtq.plans.registry import register
from rtq.sources import fixtures as FX
from rtq.sources.fixtures import duck_with

W = ["vocab", "word_synsets", "senses"]
CAPW = "concat(CASE WHEN substr(word,1,1)='ß' THEN 'SS' ELSE upper(substr(word,1,1)) END, substr(word,2))"


def _words(spark, sf):
    return FX.vocab(spark, sf).select(F.col("tok").alias("word"))


def _bench_words(spark, sf):
    b = FX.table(spark, sf, "benchmark")
    return b.select(F.explode(F.split(FX.N("text"), " ")).alias("word")).filter("word <> ''").distinct()


DUCK_BWORDS = ("bwords", """SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(lower(text),
  '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ')) AS word FROM benchmark) x WHERE word <> ''""")


@register("SRC3_load_synsets", duck_with(None, """SELECT lemma, CAST(row_number() OVER (PARTITION BY lemma ORDER BY ord) - 1 AS INTEGER) AS ord,
  CAST(id AS VARCHAR) AS id, pos, 'WN' AS source FROM word_synsets""", W))
def q_src3(spark, sf):
    ws = FX.word_synsets(spark, sf)
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "pos"))),
                                 lambda s: F.struct(s["id"].cast("string").alias("id"), s["pos"].alias("pos"),
                                                    F.lit("WN").alias("source"))))
    resp = ws.groupBy("lemma").agg(body.alias("body"))
    return L.load_synsets(resp, "lemma", "body")


@register("SRC4_load_senses", duck_with(None, "SELECT synset_id, full_lemma, pos, language FROM senses", W))
def q_src4(spark, sf):
    s = FX.senses(spark, sf)
    body = F.to_json(F.struct(F.collect_list(F.struct(
        F.lit("LexiconSense").alias("type"),
        F.struct(F.col("full_lemma").alias("fullLemma"), F.col("language").alias("language"),
                 F.col("pos").alias("pos")).alias("properties"))).alias("senses")))
    resp = s.groupBy("synset_id").agg(body.alias("body"))
    return L.load_senses(resp, "synset_id", "body", wrapped=True).select("synset_id", "full_lemma", "pos", "language")


@register("SRC5_load_edges", duck_with(None, """SELECT synset_id, language, lower(relation_group) AS short_name,
  relation_group, CAST(target AS VARCHAR) AS target FROM synset_edges""", ["synset_edges"]))
def q_src5(spark, sf):
    e = FX.synset_edges(spark, sf)
    body = F.to_json(F.collect_list(F.struct(
        F.col("language"), F.struct(F.lower("relation_group").alias("shortName"),
                                    F.col("relation_group").alias("relationGroup")).alias("pointer"),
        F.col("target").cast("string").alias("target"))))
    resp = e.groupBy("synset_id").agg(body.alias("body"))
    return L.load_edges(resp, "synset_id", "body").drop("ord")


_SW_VALUES = ", ".join("('" + w.replace("'", "''") + "')" for w in L.STOPWORDS_EN)


@register("SRC6_load_stopwords", duck_with([("sw", f"SELECT * FROM (VALUES {_SW_VALUES}) t(word)")],
                                           """SELECT l.lang, sw.word FROM (SELECT DISTINCT substr(lp,1,2) AS lang FROM seg_conv) l
CROSS JOIN sw""", ["seg_conv"]))
def q_src6(spark, sf):
    langs = FX.seg_conv(spark, sf).select(F.substring("lp", 1, 2).alias("lang")).distinct()
    sw = L.load_stopwords(spark)
    langs = langs.withColumn("list_lang", L.stopword_language(F.col("lang")))
    return langs.join(sw.withColumnRenamed("lang", "list_lang"), "list_lang").select("lang", "word")


@register("SRC7_load_lemmas", duck_with(None, "SELECT CAST(NULL AS VARCHAR) AS lang, form, lemma FROM lemmas", ["lemmas"]))
def q_src7(spark, sf):
    return L.load_lemmas(FX.lemmas(spark, sf))


@register("PRJ7_senses_excluding_pos", duck_with(None, """SELECT v.tok AS word, s.synset_id, s.full_lemma, s.pos, s.language
FROM vocab v JOIN word_synsets w ON w.lemma = v.tok JOIN senses s ON s.synset_id = w.id WHERE s.pos <> 'NOUN'""", W))
def q_prj7(spark, sf):
    ws = L.word_sense_join(_words(spark, sf), FX.word_synsets(spark, sf), FX.senses(spark, sf))
    return L.senses_excluding_pos(ws.filter("synset_id IS NOT NULL"), "NOUN").select(
        "word", "synset_id", "full_lemma", "pos", "language")


_PRJ8 = """SELECT w.lemma AS word, w.id, s.full_lemma AS lemma FROM word_synsets w JOIN senses s ON s.synset_id = w.id
WHERE s.language = 'EN' {extra} AND w.lemma <> '' AND NOT contains(s.full_lemma, {cap})"""


@register("PRJ8_synset_lemmas", duck_with(None, _PRJ8.format(extra="", cap=CAPW.replace("word", "w.lemma")), W))
def q_prj8(spark, sf):
    ws = FX.word_synsets(spark, sf).select(F.col("lemma").alias("word"), "id")
    return L.synset_lemmas(ws, FX.senses(spark, sf), "EN").select("word", "id", "lemma")


@register("PRJ9_synset_lemmas_vn", duck_with(None, _PRJ8.format(extra="AND s.pos IN ('VERB', 'NOUN')",
                                                                cap=CAPW.replace("word", "w.lemma")), W))
def q_prj9(spark, sf):
    ws = FX.word_synsets(spark, sf).select(F.col("lemma").alias("word"), "id")
    senses = FX.senses(spark, sf)
    col = "simple_lemma" if "simple_lemma" in senses.columns else "full_lemma"
    return L.synset_lemmas(ws, senses, "EN", lemma_col=col, pos_filter=("VERB", "NOUN")).select("word", "id", "lemma")


def _rel_query(key, fn, rel):
    sql = f"""SELECT synset_id, target FROM synset_edges WHERE relation_group = '{rel}'
AND language IN ('EN', 'MUL') AND target <> synset_id"""

    @register(key, duck_with(None, sql, ["synset_edges"]))
    def q(spark, sf):
        return fn(FX.synset_edges(spark, sf), "EN").select("synset_id", "target")
    return q


_rel_query("PRJ10a_hypernyms", L.hypernyms, "HYPERNYM")
_rel_query("PRJ10b_hyponyms", L.hyponyms, "HYPONYM")
_rel_query("PRJ10c_antonyms", L.antonyms, "ANTONYM")
_rel_query("PRJ10d_other_relations", L.other_relations, "OTHER")


@register("PRJ10_edges_of_relation_shipped", duck_with(None, """SELECT e.synset_id, e.target, e.relation_group
FROM (SELECT DISTINCT id FROM word_synsets) w JOIN synset_edges e ON e.synset_id = w.id""", ["word_synsets", "synset_edges"]))
def q_prj10(spark, sf):
    ids = FX.word_synsets(spark, sf).select(F.col("id").alias("synset_id")).distinct()
    e = L.edges_of_relation(L.synset_edge_join(ids, FX.synset_edges(spark, sf)), "HYPERNYM", "EN", relation_filter=False)
    return e.select("synset_id", "target", "relation_group")


@register("PRJ11_edges_in_language", duck_with(None, "SELECT synset_id, target FROM synset_edges WHERE language = 'FR'",
                                               ["synset_edges"]))
def q_prj11(spark, sf):
    return L.edges_in_language(FX.synset_edges(spark, sf), "FR").select("synset_id", "target")


@register("PRJ12_any_hypernym_edges", duck_with(None, """SELECT synset_id, target, language FROM synset_edges
WHERE relation_group = 'HYPERNYM'""", ["synset_edges"]))
def q_prj12(spark, sf):
    return L.any_hypernym_edges(FX.synset_edges(spark, sf)).select("synset_id", "target", "language")


@register("JN1_word_synset_join", duck_with(None, """SELECT v.tok AS word, w.ord, w.id, w.pos
FROM vocab v LEFT JOIN word_synsets w ON w.lemma = v.tok""", W))
def q_jn1(spark, sf):
    return L.word_synset_join(_words(spark, sf), FX.word_synsets(spark, sf)).select("word", "ord", "id", "pos")


@register("JN2_word_sense_join", duck_with(None, """SELECT v.tok AS word, s.synset_id, s.full_lemma, s.pos, s.language
FROM vocab v LEFT JOIN (SELECT w.lemma, s.* FROM word_synsets w JOIN senses s ON s.synset_id = w.id) s ON s.lemma = v.tok""", W))
def q_jn2(spark, sf):
    return L.word_sense_join(_words(spark, sf), FX.word_synsets(spark, sf), FX.senses(spark, sf)).select(
        "word", "synset_id", "full_lemma", "pos", "language")


PAIR = ("src_lang", "trg_lang")


@register("JN1b_word_synsets_by_language", duck_with(None, """SELECT w.word, w.src_lang, w.trg_lang, s.id FROM words_by_language w
LEFT JOIN synsets_by_language s ON s.lemma = w.word AND s.src_lang = w.src_lang AND s.trg_lang = w.trg_lang""", ["synsets_by_language"]))
def q_jn1b(spark, sf):
    """A form that several language pairs share has its own synsets in each."""
    return L.word_synset_join(FX.words_by_language(spark, sf), FX.synsets_by_language(spark, sf), langs=PAIR).select("word", *PAIR, "id")


@register("JN2b_word_senses_by_language", duck_with(None, """SELECT w.word, w.src_lang, w.trg_lang, x.synset_id, x.full_lemma, x.language
FROM words_by_language w LEFT JOIN (SELECT s.lemma, s.src_lang, s.trg_lang, e.* FROM synsets_by_language s JOIN senses e
  ON e.synset_id = s.id AND lower(e.language) = s.trg_lang) x ON x.lemma = w.word AND x.src_lang = w.src_lang AND x.trg_lang = w.trg_lang""",
                                                    ["synsets_by_language", "senses"]))
def q_jn2b(spark, sf):
    """Senses in the target language only."""
    return L.word_sense_join(FX.words_by_language(spark, sf), FX.synsets_by_language(spark, sf), FX.senses(spark, sf), langs=PAIR,
                             target="trg_lang").select("word", *PAIR, "synset_id", "full_lemma", "language")


@register("JN10b_lemmas_by_language", duck_with(None, """SELECT w.word, w.src_lang, coalesce(o.lemma, a.lemma, lower(w.word)) AS lemma
FROM (SELECT DISTINCT word, src_lang FROM words_by_language) w
LEFT JOIN (SELECT form, lang, min(lower(lemma)) AS lemma FROM lemmas_by_language WHERE lang IS NOT NULL GROUP BY form, lang) o
  ON o.form = w.word AND o.lang = w.src_lang
LEFT JOIN (SELECT form, min(lower(lemma)) AS lemma FROM lemmas_by_language WHERE lang IS NULL GROUP BY form) a ON a.form = w.word""",
                                                ["lemmas_by_language"]))
def q_jn10b(spark, sf):
    """The lemma of a word's own language, else that of every language (SRC7 with languages)."""
    w = FX.words_by_language(spark, sf).select("word", "src_lang").distinct()
    return L.lemma_join(w, L.load_lemmas(FX.lemmas_by_language(spark, sf)), lang_col="src_lang").select("word", "src_lang", "lemma")


@register("SRC4b_load_word_senses", duck_with(None, """SELECT w.lemma, s.full_lemma, s.pos, s.language
FROM word_synsets w JOIN senses s ON s.synset_id = w.id""", W))
def q_src4b(spark, sf):
    """The answer to a word: its senses as a plain list."""
    ws = FX.word_synsets(spark, sf).select("lemma", F.col("id").alias("synset_id"))
    s = F.struct(F.lit("LexiconSense").alias("type"), F.struct(F.col("full_lemma").alias("fullLemma"), F.col("language").alias("language"),
                                                               F.col("pos").alias("pos")).alias("properties"))
    resp = ws.join(FX.senses(spark, sf), "synset_id").groupBy("lemma").agg(F.to_json(F.collect_list(s)).alias("body"))
    return L.load_senses(resp, "lemma", "body").select("lemma", "full_lemma", "pos", "language")


@register("JN3_synset_sense_join", duck_with(None, """SELECT w.synset_id, s.full_lemma, s.language
FROM (SELECT DISTINCT id AS synset_id FROM word_synsets UNION SELECT 0) w LEFT JOIN senses s ON s.synset_id = w.synset_id""", W))
def q_jn3(spark, sf):
    ids = FX.word_synsets(spark, sf).select(F.col("id").alias("synset_id")).unionByName(
        spark.range(1).select(F.lit(0).cast("bigint").alias("synset_id"))).distinct()
    return L.synset_sense_join(ids, FX.senses(spark, sf)).select("synset_id", "full_lemma", "language")


@register("JN4_synset_edge_join", duck_with(None, """SELECT w.synset_id, e.target, e.relation_group, e.language
FROM (SELECT DISTINCT id AS synset_id FROM word_synsets) w JOIN synset_edges e ON e.synset_id = w.synset_id""",
                                            ["word_synsets", "synset_edges"]))
def q_jn4(spark, sf):
    ids = FX.word_synsets(spark, sf).select(F.col("id").alias("synset_id")).distinct()
    return L.synset_edge_join(ids, FX.synset_edges(spark, sf)).select("synset_id", "target", "relation_group", "language")


@register("JN10_lemma_join", duck_with([DUCK_BWORDS], """SELECT b.word, coalesce(lower(l.lemma), lower(b.word)) AS lemma
FROM bwords b LEFT JOIN lemmas l ON l.form = b.word""", ["lemmas"]))
def q_jn10(spark, sf):
    return L.lemma_join(_bench_words(spark, sf), FX.lemmas(spark, sf)).select("word", "lemma")


@register("JN12_stem_join", duck_with([DUCK_BWORDS], """SELECT b.word, coalesce(lower(l.lemma), lower(b.word)) AS stem
FROM bwords b LEFT JOIN stems l ON l.form = b.word""", ["stems"]))
def q_jn12(spark, sf):
    return L.lemma_join(_bench_words(spark, sf), FX.stems(spark, sf), out="stem").select("word", "stem")


@register("AGG1_count_senses", duck_with(None, """SELECT v.tok AS word, CAST(count(s.synset_id) AS BIGINT) AS n_senses
FROM vocab v LEFT JOIN word_synsets w ON w.lemma = v.tok LEFT JOIN senses s ON s.synset_id = w.id GROUP BY v.tok""", W))
def q_agg1(spark, sf):
    return L.count_senses(_words(spark, sf), FX.word_synsets(spark, sf), FX.senses(spark, sf))


@register("AGG2_count_synsets", duck_with(None, """SELECT v.tok AS word, CAST(count(w.id) AS BIGINT) AS n_synsets
FROM vocab v LEFT JOIN word_synsets w ON w.lemma = v.tok GROUP BY v.tok""", W))
def q_agg2(spark, sf):
    return L.count_synsets(_words(spark, sf), FX.word_synsets(spark, sf))


@register("AGG3_word_synset_index", duck_with(None, """SELECT i.lemma, i.ids, m.id2pos FROM
 (SELECT lemma, array_to_string(list(id ORDER BY ord), ',') AS ids FROM word_synsets GROUP BY lemma) i JOIN
 (SELECT lemma, array_to_string(list_sort(list(CAST(id AS VARCHAR) || ':' || pos)), ',') AS id2pos FROM
   (SELECT lemma, id, arg_max(pos, ord) AS pos FROM word_synsets GROUP BY lemma, id) y GROUP BY lemma) m
 ON i.lemma = m.lemma""", W))
def q_agg3(spark, sf):
    idx = L.word_synset_index(FX.word_synsets(spark, sf))
    return idx.select("lemma", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
                      F.array_join(F.array_sort(F.transform(F.map_entries("id2pos"), lambda e: F.concat(
                          e["key"].cast("string"), F.lit(":"), e["value"]))), ",").alias("id2pos"))


@register("AGG4_all_synset_words", duck_with(None, _PRJ8.format(extra="", cap=CAPW.replace("word", "w.lemma")).replace(
    "w.lemma AS word, w.id, s.full_lemma", "w.lemma AS word, s.full_lemma"), W))
def q_agg4(spark, sf):
    return L.all_synset_words(FX.word_synsets(spark, sf), FX.senses(spark, sf), "EN")


@register("AGG5_distinct_synsets", duck_with(None, "SELECT DISTINCT lemma, id FROM word_synsets", W))
def q_agg5(spark, sf):
    return L.distinct_synsets(FX.word_synsets(spark, sf))


@register("SET3_union_lemmas", duck_with(None, _PRJ8.format(extra="", cap=CAPW.replace("word", "w.lemma")).replace(
    "w.lemma AS word, w.id, s.full_lemma", "w.lemma AS word, s.full_lemma"), W))
def q_set3(spark, sf):
    ws = FX.word_synsets(spark, sf)
    s = FX.senses(spark, sf)
    bags = [L.all_synset_words(ws.filter(part), s, "EN") for part in ("ord = 0", "ord > 0")]
    return L.union_lemmas(*bags)


@register("AGG14_lookup_stats", duck_with([
    ("ws2", "SELECT lemma AS word, id AS synset_id FROM word_synsets"),
    ("req", "SELECT DISTINCT w.synset_id FROM vocab v JOIN ws2 w ON w.word = v.tok")],
    """SELECT 'synset_ids' AS kind, (SELECT count(*) FROM vocab) AS requested,
   (SELECT count(*) FROM vocab WHERE tok IN (SELECT word FROM ws2)) AS found
UNION ALL SELECT 'senses', (SELECT count(*) FROM vocab),
   (SELECT count(*) FROM vocab WHERE tok IN (SELECT w.word FROM ws2 w JOIN senses s ON s.synset_id = w.synset_id))
UNION ALL SELECT 'synset_info', (SELECT count(*) FROM req), (SELECT count(*) FROM req WHERE synset_id IN (SELECT synset_id FROM senses))
UNION ALL SELECT 'edges', (SELECT count(*) FROM req), (SELECT count(*) FROM req WHERE synset_id IN (SELECT synset_id FROM synset_edges))
""".replace("SELECT 'synset_ids'", "SELECT *, requested - found AS missing FROM (SELECT 'synset_ids'") + ") z",
    W + ["synset_edges"]))
def q_agg14(spark, sf):
    return L.lookup_stats(_words(spark, sf), FX.word_synsets(spark, sf), FX.senses(spark, sf), FX.synset_edges(spark, sf))
