"""Composed plans over the fixtures: pieces with vector classes, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtq.functions import vectors as V
from rtq.functions.text import char_length_or_1, strip_marker
from rtq.plans.segments import SPLIT_LONG, seg_tokens
from rtq.session import cut_lineage
from rtq.sources import fixtures as FX

#: Distinct words up to which their classes are sent to the tokens (some 100 bytes a
#: word and executor); beyond it the tokens are shuffled to them.
BROADCAST_WORDS = 500_000


def piece_vectors(spark, sf) -> DataFrame:
    """Vector table keyed by class (= embedding row)."""
    return FX.table(spark, sf, "embeddings").select(F.col("vec_id").alias("cls"), "embedding")


def pieces_with_class(spark, sf, segs=None, split_long=SPLIT_LONG) -> DataFrame:
    """TOKEN -> JN5: pieces of both sides with their vector class."""
    toks = seg_tokens(spark, sf, segs, split_long)
    toks = cut_lineage(toks, "tokens")  # read twice
    words = toks.select(strip_marker("piece").alias("tok")).distinct()
    tv = cut_lineage(FX.token_vectors(spark, sf, words=words, with_vector=False), "token-classes")  # its size is known then
    few = tv.count() <= BROADCAST_WORDS
    if few:
        tv = F.broadcast(tv)
    j = V.token_vector_join(toks, tv.withColumn("embedding", F.lit(None).cast("array<float>")), "piece")
    j = j.select("pair_id", "side", "pos", "piece", F.col("vec_id").alias("cls"))
    # Shuffled tokens are put in order again: what is written or shuffled next is half as large then.
    return j if few else j.sortWithinPartitions("pair_id", "side", "pos")


def first_piece_vectors(spark, sf, words: DataFrame, word: str = "word", split_long=SPLIT_LONG) -> DataFrame:
    """word -> embedding of its first piece (for SC9), over distinct words."""
    w = words.select(F.col(word).alias("word")).distinct()
    first = F.col("word") if split_long is None else F.when(
        F.char_length("word") > split_long, F.substring("word", 1, 4)).otherwise(F.col("word"))
    w = w.withColumn("tok", first)
    tv = FX.token_vectors(spark, sf, words=w.select("tok").distinct(), with_vector=True)
    return w.join(tv.withColumnRenamed("token", "tok"), "tok").select("word", "embedding")


def lexicon_edges(spark, sf) -> DataFrame:
    """Edges as the lexicon service sends them: hypernyms only (PRJ12 at load)."""
    from rtq.operators.lexicon import any_hypernym_edges
    return any_hypernym_edges(FX.synset_edges(spark, sf))


def with_language(pairs: DataFrame, segs_norm: DataFrame) -> DataFrame:
    """Word pairs ``(pair_id, k, s, t)`` with the language and length of their segment."""
    return pairs.join(segs_norm.select("pair_id", "src_lang", char_length_or_1("nsrc").cast("double").alias("n")), "pair_id")


def classified_words(spark, sf, pairs: DataFrame) -> DataFrame:
    """JN9 + JN10 + CLS1 over the distinct word pairs of a language: the rows of
    ``pairs(src_lang, s, t)`` are not looked up one by one."""
    from rtq.operators import features as FE
    from rtq.operators import lexicon as L
    p = cut_lineage(FE.distinct_words(pairs), "distinct-words")
    p = FE.stopword_flags(p, cut_lineage(L.load_stopwords(spark), "stopwords"))
    lem = cut_lineage(FX.lemmas(spark, sf), "lemmas")
    p = L.lemma_join(p, lem, word="s", out="s_lemma", lang_col="src_lang")
    p = L.lemma_join(p, lem, word="t", out="t_lemma", lang_col="src_lang")
    return cut_lineage(FE.classify_pair(p), "classified-words")


def contributions(spark, sf, pairs: DataFrame) -> DataFrame:
    """Classes and contributions of word pairs ``(pair_id, k, s, t, src_lang, n)``:
    measured per distinct word pair, joined to the rows once."""
    from rtq.functions.vectors import word_cosine
    from rtq.operators import features as FE
    from rtq.operators import paths as P
    pairs = cut_lineage(pairs, "word-pairs")
    words = classified_words(spark, sf, pairs)
    req = cut_lineage(FE.numbered_requests(words), "requests")
    ends = req.select(F.col("w1").alias("word")).unionByName(req.select(F.col("w2").alias("word")))
    dist = P.sense_distance(req, FX.word_synsets(spark, sf), lexicon_edges(spark, sf), first_piece_vectors(spark, sf, ends))
    cos_pairs = words.filter(F.col("measure") == "cos_surface").select(F.col("s").alias("w1"), F.col("t").alias("w2")).distinct()
    ends = cos_pairs.select(F.col("w1").alias("word")).unionByName(cos_pairs.select(F.col("w2").alias("word")))
    cosines = word_cosine(cos_pairs, first_piece_vectors(spark, sf, ends), "w1", "w2", "cos")
    measured = FE.attach_pair_distance(words.withColumn("n", F.lit(None).cast("double")), dist, cosines)
    return FE.spread_to_rows(pairs, measured)


def feature_table(spark, sf, segs: DataFrame | None = None, technique: str = "TOK",
                  stats: dict | None = None) -> DataFrame:
    """Entry 1 of the reference as one plan: segments -> six features each."""
    from rtq.operators import align as A
    from rtq.operators import features as FE
    from rtq.plans.segments import seg_normalized

    segs = FX.seg_conv(spark, sf) if segs is None else segs
    norm = seg_normalized(spark, sf, segs)
    pieces = cut_lineage(pieces_with_class(spark, sf, segs))
    pairs = A.word_alignment(pieces, piece_vectors(spark, sf), technique, stats=stats)
    return FE.segment_features(segs, contributions(spark, sf, with_language(pairs, norm)))
