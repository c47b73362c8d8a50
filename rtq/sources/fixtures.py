"""Test fixtures derived from the driver tables (FIXTURES.md part B).

Each fixture exists twice: a Spark DataFrame builder (used by the library
and by ``__spark_entry__.queries``) and an independent DuckDB text (used by
``oracle_sql``).  Both read the same parquet tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtq.functions.text import NON_WORD

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def H(c) -> Column:
    """Portable hash: first 7 hex digits of md5 as bigint."""
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("bigint")


def N(c) -> Column:
    """Short normaliser used to build the fixture vocabulary."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), NON_WORD, " ")


def lp_of_lang(lang: Column) -> Column:
    return F.when(lang == "en", F.lit("en-de")).otherwise(F.concat(lang, F.lit("-en")))


def n_vectors(spark: SparkSession, sf_dir: str) -> Column:
    """Number of rows of ``embeddings`` as a scalar subquery (no cross join)."""
    return table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()


def seg_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of a conversation stand for (source, back translation).
    Turns are numbered consecutively, so the next turn is an equi-join on
    (conv_id, turn + 1): no window over a whole conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a = c.alias("a")
    b = c.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    lp = (F.when(F.col("a.conv_id") % 4 == 0, "en-de").when(F.col("a.conv_id") % 4 == 1, "fr-en")
          .when(F.col("a.conv_id") % 4 == 2, "de-en").otherwise("es-en"))
    return j.select((F.col("a.conv_id") * 1000 + F.col("a.turn")).cast("bigint").alias("pair_id"),
                    lp.alias("lp"), F.col("a.text").alias("src"), F.col("b.text").alias("trg"))


# Round trip of ``seg_labelled``: endings lost, an article gone, another word, a longer form.
DAMAGE = [("(ing|ed|s) ", " "), (" (the|der|le|el) ", " x "), (" [a-f]([a-z]{5})", " y$1"), ("([g-m][a-z]{4}) ", "$1ful ")]


def seg_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document and a damaged round trip of it, keyed by its doc_id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    j = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    trg = F.col("text")
    for pattern, instead in DAMAGE:
        trg = F.regexp_replace(trg, pattern, instead)
    return j.select(F.col("doc_id").alias("pair_id"), lp_of_lang(F.col("lang")).alias("lp"), F.col("text").alias("src"), trg.alias("trg"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    both = [F.coalesce(F.split(N(c), " "), none) for c in ("src", "trg")]
    toks = seg_conv(spark, sf_dir).select(F.explode(F.array_distinct(F.concat(*both))).alias("tok"))
    return toks.filter(F.col("tok") != "").distinct()


def token_vectors(spark: SparkSession, sf_dir: str, words: DataFrame | None = None,
                  with_vector: bool = True) -> DataFrame:
    """Hashed embedding lookup: token -> embeddings[H(token) % n]."""
    v = vocab(spark, sf_dir) if words is None else words
    e = table(spark, sf_dir, "embeddings")
    t = v.select(F.col("tok").alias("token"), (H("tok") % n_vectors(spark, sf_dir)).alias("vec_id"))
    cols = ["vec_id"] + (["embedding"] if with_vector else [])
    return t.join(e.select(*cols), "vec_id").select("token", "vec_id", *cols[1:])


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crude suffix stripping, a stand-in for a lemma dictionary."""
    v = vocab(spark, sf_dir)
    l = F.regexp_replace("tok", "(tion|ing|ent|ed|es|en|er|s)$", "")
    return v.select(F.col("tok").alias("form"), F.when(l == "", F.col("tok")).otherwise(l).alias("lemma"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule stems, a stand-in for a stemmer (applied to words of any language)."""
    v = vocab(spark, sf_dir)
    st = F.regexp_replace("tok", "(ing|ly|ed|s)$", "")
    return v.select(F.col("tok").alias("form"), F.when(st == "", F.col("tok")).otherwise(st).alias("lemma"))


def word_synsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocab(spark, sf_dir)
    x = v.select("tok", F.posexplode(F.array(H("tok"), H(F.concat("tok", F.lit("#1"))))).alias("ord", "h"))
    n = n_vectors(spark, sf_dir)
    pos = F.when(F.col("h") % 4 == 0, "VERB").when(F.col("h") % 4 == 1, "ADJECTIVE").otherwise("NOUN")
    return x.filter(F.col("h") % 5 != 0).select(
        F.col("tok").alias("lemma"), F.col("ord").cast("int").alias("ord"),
        (F.lit(1) + F.col("h") % (n - 1)).cast("bigint").alias("id"), pos.alias("pos"))


def words_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source words of the conversations with their language pair; many forms occur in several."""
    s = seg_conv(spark, sf_dir).select(F.substring("lp", 1, 2).alias("src_lang"), F.substring("lp", 4, 2).alias("trg_lang"),
                                       F.explode(F.split(N("src"), " ")).alias("word"))
    return s.filter("word <> ''").distinct()


def synsets_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form has another synset in each language pair, and none in some."""
    w = words_by_language(spark, sf_dir).withColumn("h", H(F.concat_ws("@", "word", "src_lang", "trg_lang")))
    return w.filter("h % 5 <> 0").select(F.col("word").alias("lemma"), "src_lang", "trg_lang",
                                         (F.lit(1) + F.col("h") % (n_vectors(spark, sf_dir) - 1)).cast("bigint").alias("id"))


def lemmas_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of two languages, and those of every language under null."""
    own = words_by_language(spark, sf_dir).filter("src_lang IN ('de', 'fr')").select(
        F.col("src_lang").alias("lang"), F.col("word").alias("form"), F.concat("word", "src_lang").alias("lemma")).distinct()
    return own.unionByName(lemmas(spark, sf_dir).select(F.lit(None).cast("string").alias("lang"), "form", "lemma"))


def synset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    half = F.floor(F.col("vec_id") / 2).cast("bigint")
    lang = F.when(F.col("vec_id") % 3 == 0, "EN").when(F.col("vec_id") % 3 == 1, "MUL").otherwise("FR")
    hyper = e.filter("vec_id >= 2").select(F.col("vec_id").alias("synset_id"), half.alias("target"),
                                          F.lit("HYPERNYM").alias("relation_group"), lang.alias("language"))
    hypo = e.filter("vec_id >= 2").select(half.alias("synset_id"), F.col("vec_id").alias("target"),
                                         F.lit("HYPONYM").alias("relation_group"), F.lit("MUL").alias("language"))
    anto = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("synset_id"), (F.col("vec_id") + 1).alias("target"),
                                             F.lit("ANTONYM").alias("relation_group"), F.lit("EN").alias("language"))
    other = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("synset_id"), F.col("vec_id").alias("target"),
                                              F.lit("OTHER").alias("relation_group"), F.lit("EN").alias("language"))
    return hyper.unionAll(hypo).unionAll(anto).unionAll(other)


def senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = word_synsets(spark, sf_dir)
    cap = F.concat(F.upper(F.substring("lemma", 1, 1)), F.substr(F.col("lemma"), F.lit(2)))
    lang = F.when(F.col("id") % 3 == 0, "EN").when(F.col("id") % 3 == 1, "FR").otherwise("DE")
    a = ws.filter("ord = 0").select(F.col("id").alias("synset_id"), cap.alias("full_lemma"), "pos", lang.alias("language"))
    b = ws.select(F.col("id").alias("synset_id"), F.col("lemma").alias("full_lemma"), "pos", F.lit("EN").alias("language"))
    return a.unionAll(b)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    l = table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("system"), lp_of_lang(F.col("lang")).alias("lp"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("score"), F.col("n_chars").cast("double").alias("pred"))


# ---------------------------------------------------------------------------
# DuckDB texts of the same fixtures, for the oracle.
# ---------------------------------------------------------------------------

def _h(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}),1,7)) AS BIGINT)"


def _n(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"


def _damaged(x: str) -> str:
    for pattern, instead in DAMAGE:
        x = f"regexp_replace({x}, '{pattern}', '{instead.replace('$', chr(92))}', 'g')"
    return x


DUCK: dict[str, tuple[list[str], str]] = {
    "nvec": ([], "SELECT count(*) AS n FROM embeddings"),
    "seg_conv": ([], """SELECT conv_id*1000+turn AS pair_id,
       CASE conv_id%4 WHEN 0 THEN 'en-de' WHEN 1 THEN 'fr-en' WHEN 2 THEN 'de-en' ELSE 'es-en' END AS lp, src, trg
FROM (SELECT conv_id, turn, text AS src, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS trg FROM conversations) x
WHERE trg IS NOT NULL"""),
    "seg_labelled": ([], f"""SELECT d.doc_id AS pair_id, CASE WHEN d.lang='en' THEN 'en-de' ELSE d.lang || '-en' END AS lp,
       d.text AS src, {_damaged('d.text')} AS trg FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""),
    "vocab": (["seg_conv"], f"""SELECT DISTINCT tok FROM (SELECT unnest(string_split({_n('text')}, ' ')) AS tok
  FROM (SELECT src AS text FROM seg_conv UNION ALL SELECT trg FROM seg_conv) y) z WHERE tok <> ''"""),
    "token_vectors": (["vocab", "nvec"], f"""SELECT v.tok AS token, e.vec_id, e.embedding
FROM vocab v CROSS JOIN nvec c JOIN embeddings e ON e.vec_id = {_h('v.tok')} % c.n"""),
    "lemmas": (["vocab"], """SELECT tok AS form, CASE WHEN l='' THEN tok ELSE l END AS lemma
FROM (SELECT tok, regexp_replace(tok,'(tion|ing|ent|ed|es|en|er|s)$','') AS l FROM vocab) x"""),
    "stems": (["vocab"], """SELECT tok AS form, CASE WHEN l='' THEN tok ELSE l END AS lemma
FROM (SELECT tok, regexp_replace(tok,'(ing|ly|ed|s)$','') AS l FROM vocab) x"""),
    "word_synsets": (["vocab", "nvec"], f"""SELECT tok AS lemma, CAST(ord AS INTEGER) AS ord, CAST(1 + h % (n-1) AS BIGINT) AS id,
       CASE WHEN h%4=0 THEN 'VERB' WHEN h%4=1 THEN 'ADJECTIVE' ELSE 'NOUN' END AS pos
FROM (SELECT tok, 0 AS ord, {_h('tok')} AS h FROM vocab UNION ALL SELECT tok, 1, {_h("concat(tok,'#1')")} FROM vocab) x
CROSS JOIN nvec c WHERE h%5 <> 0"""),
    "words_by_language": (["seg_conv"], f"""SELECT DISTINCT word, src_lang, trg_lang FROM (
  SELECT unnest(string_split({_n('src')}, ' ')) AS word, substr(lp,1,2) AS src_lang, substr(lp,4,2) AS trg_lang FROM seg_conv) x WHERE word <> ''"""),
    "synsets_by_language": (["words_by_language", "nvec"], f"""SELECT word AS lemma, src_lang, trg_lang, CAST(1 + h % (n-1) AS BIGINT) AS id
FROM (SELECT *, {_h("concat_ws('@', word, src_lang, trg_lang)")} AS h FROM words_by_language) x CROSS JOIN nvec c WHERE h % 5 <> 0"""),
    "lemmas_by_language": (["words_by_language", "lemmas"], """SELECT DISTINCT src_lang AS lang, word AS form, word || src_lang AS lemma
FROM words_by_language WHERE src_lang IN ('de', 'fr') UNION ALL SELECT NULL, form, lemma FROM lemmas"""),
    "synset_edges": ([], """SELECT vec_id AS synset_id, CAST(FLOOR(vec_id/2) AS BIGINT) AS target, 'HYPERNYM' AS relation_group,
       CASE vec_id%3 WHEN 0 THEN 'EN' WHEN 1 THEN 'MUL' ELSE 'FR' END AS language FROM embeddings WHERE vec_id>=2
UNION ALL SELECT CAST(FLOOR(vec_id/2) AS BIGINT), vec_id, 'HYPONYM', 'MUL' FROM embeddings WHERE vec_id>=2
UNION ALL SELECT vec_id, vec_id+1, 'ANTONYM', 'EN' FROM embeddings WHERE vec_id%10=0
UNION ALL SELECT vec_id, vec_id, 'OTHER', 'EN' FROM embeddings WHERE vec_id%50=0"""),
    "senses": (["word_synsets"], """SELECT id AS synset_id,
       concat(CASE WHEN substr(lemma,1,1)='ß' THEN 'SS' ELSE upper(substr(lemma,1,1)) END, substr(lemma,2)) AS full_lemma,
       pos, CASE id%3 WHEN 0 THEN 'EN' WHEN 1 THEN 'FR' ELSE 'DE' END AS language FROM word_synsets WHERE ord=0
UNION ALL SELECT id, lemma, pos, 'EN' FROM word_synsets"""),
    "scored": ([], """SELECT d.doc_id AS id, d.source AS system,
       CASE WHEN d.lang='en' THEN 'en-de' ELSE concat(d.lang,'-en') END AS lp,
       CAST(l.quality-l.toxic AS DOUBLE) AS score, CAST(d.n_chars AS DOUBLE) AS pred
FROM documents d JOIN labels l ON d.doc_id=l.doc_id"""),
}


def duck_with(extra: list[tuple[str, str]] | None, body: str, uses: list[str] = ()) -> str:
    """Build ``WITH <fixtures...>, <extra...> <body>`` including dependencies."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for d in DUCK[name][0]:
            add(d)
        order.append(name)

    for u in uses:
        add(u)
    ctes = [f"{n} AS ({DUCK[n][1]})" for n in order]
    ctes += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
