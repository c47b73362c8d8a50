"""Error classes and segment features: JN9, JN11, CLS1, AGG9.

Word pairs ``(pair_id, k, s, t)`` get a class by the first rule that applies
(one CASE chain); lexicon distances are computed once per *distinct* word
pair and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtq.functions.text import char_length_or_1
from rtq.operators.lexicon import stopword_language
from rtq.operators.scoring import FEATURES

CLASSES = ["SAME", "EXTRA", "MISS", "STOPWORD", "SENSE", "INFL", "DERI", "NONE"]


def stopword_flags(pairs: DataFrame, stopwords: DataFrame, lang: str = "src_lang") -> DataFrame:
    """JN9: are s and t stop words of the pair's language (zh list or English)?
    A loaded list may have any size, so the join's form is left to AQE."""
    sw = stopwords.select("lang", "word").distinct()
    p = pairs.withColumn("_sl", stopword_language(F.col(lang)))
    for side in ("s", "t"):
        flag = sw.select(F.col("lang").alias("_sl"), F.col("word").alias(side), F.lit(True).alias(side + "_stop"))
        p = p.join(flag, ["_sl", side], "left").withColumn(side + "_stop", F.coalesce(side + "_stop", F.lit(False)))
    return p.drop("_sl")


def classify_pair(pairs: DataFrame, lang: str = "src_lang") -> DataFrame:
    """CLS1: class and how its contribution is measured.

    Needs ``s, t, s_stop, t_stop, s_lemma, t_lemma``.  ``measure``:
    ``one_over_n`` (EXTRA/MISS/STOPWORD), ``path_surface`` (zh, both short),
    ``cos_surface`` (zh otherwise, INFL, DERI), ``path_lemma`` (SENSE), ``zero``.
    """
    s, t = F.col("s"), F.col("t")
    ls, lt = F.char_length(s), F.char_length(t)
    zh = F.col(lang) == "zh"
    both_long = (ls > 1) & (lt > 1)
    lemmas_equal = F.col("s_lemma") == F.col("t_lemma")
    lemmas_nested = F.contains(F.col("t_lemma"), F.col("s_lemma")) | F.contains(F.col("s_lemma"), F.col("t_lemma"))
    cls = (F.when(s == t, "SAME")
           .when((s == "") | ((lt > 1) & (ls < 2)), "EXTRA")
           .when((t == "") | ((lt < 2) & (ls > 1)), "MISS")
           .when(F.col("t_stop") & F.col("s_stop"), "STOPWORD")
           .when(zh, "SENSE")
           .when(both_long & lemmas_equal, "INFL")
           .when(both_long & lemmas_nested, "DERI")
           .when(both_long, "SENSE")
           .otherwise("NONE"))
    measure = (F.when(F.col("cls").isin("EXTRA", "MISS", "STOPWORD"), "one_over_n")
               .when((F.col("cls") == "SENSE") & zh & (ls < 4) & (lt < 4), "path_surface")
               .when((F.col("cls") == "SENSE") & zh, "cos_surface")
               .when(F.col("cls").isin("INFL", "DERI"), "cos_surface")
               .when(F.col("cls") == "SENSE", "path_lemma")
               .otherwise("zero"))
    return pairs.withColumn("cls", cls).withColumn("measure", measure)


def pair_key(a, b):
    """Id of a word pair: both words, the length of the first one ahead, so no two pairs share it."""
    return F.concat(F.char_length(a).cast("string"), F.lit(":"), F.col(a), F.lit(" "), F.col(b))


WORD_KEY = ["_lang", "s", "t"]


def _language(rows: DataFrame, lang: str = "src_lang") -> DataFrame:
    """A key column for the language: one value stands for null."""
    return rows.withColumn("_lang", F.coalesce(F.col(lang), F.lit("")))


def distinct_words(pairs: DataFrame) -> DataFrame:
    """The distinct ``(src_lang, s, t)`` of word pairs, a missing language as ''."""
    return _language(pairs).select(*WORD_KEY).distinct().withColumnRenamed("_lang", "src_lang")


def spread_to_rows(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of ``pairs(pair_id, k, src_lang, n, s, t)`` with the classes and
    contributions of their words (one row per distinct word pair); what
    ``one_over_n`` measures goes by the row's own length."""
    out = _language(pairs).join(_language(words).drop("src_lang", "n"), WORD_KEY).drop("_lang")
    if "contrib" not in words.columns:
        return out
    return out.withColumn("contrib", F.when(F.col("measure") == "one_over_n", F.lit(1.0) / F.col("n")).otherwise(F.col("contrib")))


def distance_requests(classified: DataFrame) -> DataFrame:
    """Distinct word pairs that need a lexicon distance (rules 5 and 9)."""
    surf = classified.filter(F.col("measure") == "path_surface").select(F.col("s").alias("w1"), F.col("t").alias("w2"))
    lem = classified.filter(F.col("measure") == "path_lemma").select(F.col("s_lemma").alias("w1"), F.col("t_lemma").alias("w2"))
    d = surf.unionByName(lem).distinct()
    return d.withColumn("wp", pair_key("w1", "w2"))


def numbered_requests(classified: DataFrame) -> DataFrame:
    """The requests under a number instead of their words.  Write them before use:
    the numbers go by task."""
    return distance_requests(classified).withColumn("wp", F.monotonically_increasing_id())


def attach_pair_distance(classified: DataFrame, distances: DataFrame, cosines: DataFrame) -> DataFrame:
    """JN11: attach the distance of each distinct word pair, and the surface
    cosine; then the contribution of every pair.

    Only rows whose measure needs a lookup are joined, so equal words and empty
    sides, the most frequent pairs, are no join keys."""
    by_path, by_cosine = F.col("measure").isin("path_surface", "path_lemma"), F.col("measure") == "cos_surface"
    d = distances.select(F.col("w1").alias("_w1"), F.col("w2").alias("_w2"), "distance", "sense_by_path", "sense_by_cosine")
    cs = cosines.select(F.col("w1").alias("s"), F.col("w2").alias("t"), F.col("cos").alias("surface_cos"))
    c = classified.withColumn("_w1", F.when(F.col("measure") == "path_lemma", F.col("s_lemma")).otherwise(F.col("s"))) \
        .withColumn("_w2", F.when(F.col("measure") == "path_lemma", F.col("t_lemma")).otherwise(F.col("t")))
    c = c.filter(by_path).join(d, ["_w1", "_w2"], "left").unionByName(
        c.filter(by_cosine).join(cs, ["s", "t"], "left"), allowMissingColumns=True).unionByName(
        c.filter(~by_path & ~by_cosine), allowMissingColumns=True)
    contrib = (F.when(F.col("measure") == "one_over_n", F.lit(1.0) / F.col("n"))
               .when(F.col("measure") == "cos_surface", F.col("surface_cos"))
               .when(F.col("measure").isin("path_surface", "path_lemma"), F.col("distance"))
               .otherwise(F.lit(0.0)))
    return c.withColumn("contrib", contrib).drop("_w1", "_w2")


def segment_features(segments: DataFrame, contributions: DataFrame, key: str = "pair_id") -> DataFrame:
    """AGG9: six features per segment = sums of the contributions by class;
    segments without pairs get zeros; null text gives null features (Q12)."""
    cls_of = {"EXTRA": "EXTRA", "MISS": "MISS", "STOPWORD": "STOPWORD", "INFL": "INFL", "DERI": "DERI", "SENSE": "SENSE"}
    aggs = [F.sum(F.when(F.col("cls") == c, F.col("contrib")).otherwise(F.lit(0.0))).alias(f)
            for f, c in cls_of.items()]
    aggs += [F.sum(F.when(F.col("cls") == "SENSE", F.col("sense_by_path"))).alias("sense_by_path"),
             F.sum(F.when((F.col("cls") == "SENSE") & ~F.col("has_path_flag"), F.col("contrib"))).alias("sense_by_cosine"),
             F.count(F.lit(1)).alias("n_pairs")]
    c = contributions.withColumn("has_path_flag", F.coalesce(F.col("sense_by_path").isNotNull(), F.lit(False)))
    g = c.groupBy(key).agg(*aggs)
    out = segments.join(g, key, "left")
    valid = F.col("src").isNotNull() & F.col("trg").isNotNull()
    for f in FEATURES:
        out = out.withColumn(f, F.when(valid, F.coalesce(F.col(f), F.lit(0.0))))
    return out.withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)).cast("bigint"))
