"""Lexicon operators over edge/sense tables (SRC3-SRC7, PRJ7-PRJ12, JN1-JN4,
JN10, JN12, AGG1-AGG5, AGG14, SET3).

The reference probes a remote lexicon one key at a time and caches the
answers in a dict.  Here each lookup is one join over the *distinct* keys
against a persisted lexicon table, so repeats cost nothing and the work is
distributed by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtq.functions.text import capitalize_first

# Response shapes of the lexicon service (JSON).
SYNSET_IDS_SCHEMA = "array<struct<id:string, pos:string, source:string>>"
SENSE_SCHEMA = ("array<struct<type:string, properties:struct<fullLemma:string, simpleLemma:string, source:string, "
                "senseKey:string, language:string, pos:string, idSense:string>>>")
SYNSET_SCHEMA = f"struct<senses:{SENSE_SCHEMA}>"
EDGES_SCHEMA = "array<struct<language:string, pointer:struct<shortName:string, relationGroup:string>, target:string>>"

# The English stop-word list used by the reference (NLTK English list).
STOPWORDS_EN = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves what which who
whom this that that'll these those am is are was were be been being have has had having do does did doing a an the
and but if or because as until while of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here there when where why how all any both
each few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
weren weren't won won't wouldn wouldn't""".split()

# A short Chinese list; the full list is loaded from a file with ``load_stopwords(path=...)``.
STOPWORDS_ZH_SHORT = "的 了 和 是 在 我 有 他 这 中 也 就 人 都 一 个 上 们 不 到 说 要 你 会 着 那 与 对 而".split()


# ------------------------------------------------------------ sources ------

def load_synsets(responses: DataFrame, key: str = "lemma", body: str = "body") -> DataFrame:
    """SRC3: ``(key, body)`` word -> synset-list responses -> ``(key, ord, id, pos, source)``.
    Empty or unparsable bodies yield no rows (Q17)."""
    parsed = responses.select(key, F.from_json(F.col(body), SYNSET_IDS_SCHEMA).alias("a"))
    return parsed.select(key, F.posexplode("a").alias("ord", "s")).select(
        key, F.col("ord").cast("int"), F.col("s.id").alias("id"), F.col("s.pos").alias("pos"),
        F.col("s.source").alias("source"))


def load_senses(responses: DataFrame, key: str = "lemma", body: str = "body", wrapped: bool = False) -> DataFrame:
    """SRC4: sense lists (``wrapped``: synset answer ``{"senses": [...]}``) -> flat rows."""
    schema = SYNSET_SCHEMA if wrapped else SENSE_SCHEMA
    parsed = responses.select(key, F.from_json(F.col(body), schema).alias("a"))
    arr = F.col("a.senses") if wrapped else F.col("a")
    return parsed.select(key, F.posexplode(arr).alias("ord", "s")).select(
        key, F.col("ord").cast("int"),
        F.col("s.properties.fullLemma").alias("full_lemma"), F.col("s.properties.simpleLemma").alias("simple_lemma"),
        F.col("s.properties.language").alias("language"), F.col("s.properties.pos").alias("pos"),
        F.col("s.properties.source").alias("source"), F.col("s.properties.senseKey").alias("sense_key"),
        F.col("s.properties.idSense").alias("id_sense"))


def load_edges(responses: DataFrame, key: str = "synset_id", body: str = "body") -> DataFrame:
    """SRC5: synset -> outgoing edges -> ``(synset_id, ord, language, short_name, relation_group, target)``."""
    parsed = responses.select(key, F.from_json(F.col(body), EDGES_SCHEMA).alias("a"))
    return parsed.select(key, F.posexplode("a").alias("ord", "e")).select(
        key, F.col("ord").cast("int"), F.col("e.language").alias("language"),
        F.col("e.pointer.shortName").alias("short_name"), F.col("e.pointer.relationGroup").alias("relation_group"),
        F.col("e.target").alias("target"))


def load_stopwords(spark, path: str | None = None, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """SRC6: ``stopwords(lang, word)``; a file of ``lang<TAB>word`` lines may add lists."""
    rows = [("en", w) for w in STOPWORDS_EN] + [("zh", w) for w in STOPWORDS_ZH_SHORT]
    for lang, words in (extra or {}).items():
        rows += [(lang, w) for w in words]
    df = spark.createDataFrame(rows, "lang string, word string")
    if path:
        df = df.unionByName(spark.read.csv(path, sep="\t", schema="lang string, word string"))
    return df.distinct()


def stopword_language(lang_col, languages_with_list=("zh",)):
    """SRC6 fallback: ``zh`` has its own list, every other language uses English."""
    return F.when(lang_col.isin(*languages_with_list), lang_col).otherwise(F.lit("en"))


def load_lemmas(lemmas: DataFrame, lang: str | None = None) -> DataFrame:
    """SRC7: ``lemmas(lang, form, lemma)``; a table without language applies to all."""
    if "lang" not in lemmas.columns:
        lemmas = lemmas.withColumn("lang", F.lit(lang).cast("string"))
    return lemmas.select("lang", "form", "lemma")


# --------------------------------------------------------- projections -----

def senses_excluding_pos(word_senses: DataFrame, pos: str) -> DataFrame:
    """PRJ7: senses whose part of speech differs from ``pos``."""
    return word_senses.filter(F.col("pos") != F.lit(pos))


def synset_lemmas(word_synset: DataFrame, senses: DataFrame, trg_lang: str, word: str = "word",
                  synset: str = "id", lemma_col: str = "full_lemma", pos_filter: tuple[str, ...] | None = None) -> DataFrame:
    """PRJ8 / PRJ9: lemmas of each (word, synset) in the target language that do
    not contain the capitalised word.  PRJ9 adds ``pos_filter=('VERB','NOUN')``
    and ``lemma_col='simple_lemma'``.  An empty word gives no rows."""
    s = senses.filter(F.col("language") == F.lit(trg_lang))
    if pos_filter:
        s = s.filter(F.col("pos").isin(*pos_filter))
    s = s.select(F.col("synset_id").alias(synset), F.col(lemma_col).alias("lemma"))
    j = word_synset.filter(F.col(word) != "").join(s, synset)
    return j.filter(~F.contains(F.col("lemma"), capitalize_first(word)))


def edges_of_relation(edges: DataFrame, relation: str, lang: str, relation_filter: bool = True) -> DataFrame:
    """PRJ10: edges of one relation group in ``lang`` or ``MUL``, no self-loops.
    ``relation_filter=False`` is the shipped behaviour (filter commented out, Q6)."""
    if not relation_filter:
        return edges
    return edges.filter((F.col("relation_group") == F.lit(relation)) & F.col("language").isin(lang, "MUL")
                        & (F.col("target") != F.col("synset_id")))


def hypernyms(edges, lang, relation_filter=True):
    """PRJ10a."""
    return edges_of_relation(edges, "HYPERNYM", lang, relation_filter)


def hyponyms(edges, lang, relation_filter=True):
    """PRJ10b."""
    return edges_of_relation(edges, "HYPONYM", lang, relation_filter)


def antonyms(edges, lang, relation_filter=True):
    """PRJ10c."""
    return edges_of_relation(edges, "ANTONYM", lang, relation_filter)


def other_relations(edges, lang, relation_filter=True):
    """PRJ10d."""
    return edges_of_relation(edges, "OTHER", lang, relation_filter)


def edges_in_language(edges: DataFrame, lang: str) -> DataFrame:
    """PRJ11: edges in exactly one language."""
    return edges.filter(F.col("language") == F.lit(lang))


def any_hypernym_edges(edges: DataFrame) -> DataFrame:
    """PRJ12: the service's own filter (hypernym pointer family), at load time."""
    return edges.filter(F.col("relation_group") == "HYPERNYM")


# --------------------------------------------------------------- joins -----

def word_synset_join(words: DataFrame, word_synsets: DataFrame, word: str = "word", langs: tuple[str, ...] = ()) -> DataFrame:
    """JN1: word -> its synsets (left join: words without synsets keep a null id).
    ``langs`` names language columns of both tables that belong to the key, such
    as ``("src_lang", "trg_lang")``; a word without language then has no synset."""
    ws = word_synsets.withColumnRenamed("lemma", word)
    return words.join(ws, [word, *langs], "left")


def word_sense_join(words: DataFrame, word_synsets: DataFrame, senses: DataFrame, word: str = "word",
                    langs: tuple[str, ...] = (), target: str | None = None) -> DataFrame:
    """JN2: word -> its senses (senses of its synsets).  ``langs`` as in JN1;
    ``target`` names the one that the senses must be in (codes in either case)."""
    ws = word_synsets.select(F.col("lemma").alias(word), *langs, F.col("id").alias("synset_id"))
    s = ws.join(senses, "synset_id")
    if target is not None:
        s = s.filter(F.lower("language") == F.lower(target))
    return words.join(s, [word, *langs], "left")


def synset_sense_join(synsets: DataFrame, senses: DataFrame, synset: str = "synset_id") -> DataFrame:
    """JN3: synset -> its senses (left: unknown synset, no senses, Q17)."""
    return synsets.join(senses.withColumnRenamed("synset_id", synset), synset, "left")


def synset_edge_join(synsets: DataFrame, edges: DataFrame, synset: str = "synset_id") -> DataFrame:
    """JN4: synset -> outgoing edges (one hop)."""
    return synsets.join(edges.withColumnRenamed("synset_id", synset), synset)


def lemma_join(words: DataFrame, lemmas: DataFrame, word: str = "word", out: str = "lemma",
               lang: str | None = None, lang_col: str | None = None) -> DataFrame:
    """JN10 / JN12: lemma (or stem) of each word, lower-cased; the word itself
    when unknown.  The lexicon is joined over distinct words.

    ``lang_col`` names the words' language column: a word then takes the lemma of
    its own language, else that of a row without language.  ``lang`` fixes one
    language for all words.  Of several lemmas of a form the least counts."""
    if "lang" not in lemmas.columns:
        lemmas = lemmas.withColumn("lang", F.lit(None).cast("string"))
    if lang is not None:
        lemmas = lemmas.filter(F.col("lang").isNull() | (F.col("lang") == F.lit(lang)))
    least = F.min(F.lower("lemma"))
    keys = [word] if lang_col is None else [word, lang_col]
    d = words.select(*keys).distinct()
    if lang_col is None:
        any_lang = lemmas.groupBy(F.col("form").alias(word)).agg(least.alias("_any"))
        d = d.join(any_lang, word, "left").withColumn("_own", F.lit(None).cast("string"))
    else:
        own = lemmas.filter("lang IS NOT NULL").groupBy(F.col("form").alias(word), F.col("lang").alias(lang_col)).agg(least.alias("_own"))
        any_lang = lemmas.filter("lang IS NULL").groupBy(F.col("form").alias(word)).agg(least.alias("_any"))
        d = d.join(own, keys, "left").join(any_lang, word, "left")
    d = d.select(*keys, F.coalesce("_own", "_any", F.lower(word)).alias(out))
    return words.join(d, keys, "left").withColumn(out, F.coalesce(out, F.lower(word)))


# -------------------------------------------------------- aggregations -----

def count_senses(words: DataFrame, word_synsets: DataFrame, senses: DataFrame, word: str = "word") -> DataFrame:
    """AGG1: senses per word, 0 when none."""
    ws = word_synsets.select(F.col("lemma").alias(word), F.col("id").alias("synset_id"))
    c = ws.join(senses.select("synset_id"), "synset_id").groupBy(word).agg(F.count(F.lit(1)).alias("n_senses"))
    return words.select(word).distinct().join(c, word, "left").select(
        word, F.coalesce("n_senses", F.lit(0)).cast("bigint").alias("n_senses"))


def count_synsets(words: DataFrame, word_synsets: DataFrame, word: str = "word") -> DataFrame:
    """AGG2: synsets per word, 0 when none."""
    c = word_synsets.groupBy(F.col("lemma").alias(word)).agg(F.count(F.lit(1)).alias("n_synsets"))
    return words.select(word).distinct().join(c, word, "left").select(
        word, F.coalesce("n_synsets", F.lit(0)).cast("bigint").alias("n_synsets"))


def word_synset_index(word_synsets: DataFrame) -> DataFrame:
    """AGG3: per word the list of synset ids (in answer order) and an
    id -> pos map where the last answer wins on duplicate ids."""
    ids = word_synsets.groupBy("lemma").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("ids"))
    last = word_synsets.groupBy("lemma", "id").agg(F.max_by("pos", "ord").alias("pos"))
    m = last.groupBy("lemma").agg(F.map_from_entries(F.collect_list(F.struct("id", "pos"))).alias("id2pos"))
    return ids.join(m, "lemma")


def all_synset_words(word_synsets: DataFrame, senses: DataFrame, trg_lang: str, word: str = "word") -> DataFrame:
    """AGG4: bag of lemmas over all synsets of each word (duplicates kept, exploded)."""
    ws = word_synsets.select(F.col("lemma").alias(word), "id")
    return synset_lemmas(ws, senses, trg_lang, word=word, synset="id").select(word, "lemma")


def distinct_synsets(word_synsets: DataFrame, word: str = "lemma") -> DataFrame:
    """AGG5: distinct synset ids of each word."""
    return word_synsets.select(word, "id").dropDuplicates([word, "id"])


def union_lemmas(*bags: DataFrame) -> DataFrame:
    """SET3: bag union (duplicates kept)."""
    out = bags[0]
    for b in bags[1:]:
        out = out.unionByName(b)
    return out


def lookup_stats(words: DataFrame, word_synsets: DataFrame, senses: DataFrame, edges: DataFrame,
                 word: str = "word") -> DataFrame:
    """AGG14: lookups per kind: distinct keys requested / found / missing.
    The reference counts remote calls; here a "call" is a distinct key."""
    w = words.select(word).distinct()
    ws = word_synsets.select(F.col("lemma").alias(word), F.col("id").alias("synset_id"))
    syn_found = w.join(ws.select(word).distinct(), word, "left_semi")
    req_syn = w.join(ws, word).select("synset_id").distinct()
    sense_found = req_syn.join(senses.select("synset_id").distinct(), "synset_id", "left_semi")
    edge_found = req_syn.join(edges.select("synset_id").distinct(), "synset_id", "left_semi")
    word_sense_found = w.join(ws.join(senses.select("synset_id").distinct(), "synset_id").select(word).distinct(),
                              word, "left_semi")

    def row(kind, req, found):
        return req.agg(F.count(F.lit(1)).alias("requested")).select(
            F.lit(kind).alias("kind"), "requested", found.select(F.count(F.lit(1))).scalar().alias("found"))

    out = (row("synset_ids", w, syn_found).unionByName(row("senses", w, word_sense_found))
           .unionByName(row("synset_info", req_syn, sense_found)).unionByName(row("edges", req_syn, edge_found)))
    return out.withColumn("missing", F.col("requested") - F.col("found"))
