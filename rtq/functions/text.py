"""Scalar text functions (SC1-SC7, SC11, SC12), tokenisation (TOKEN),
word numbering (WIN1) and word text from pieces (AGG7).

All are built-in Spark expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical results:
# the contraction rewrites of the English normaliser, applied in this order.
CONTRACTIONS = [
    ("n't", " not"),
    ("'re", " are"),
    ("'s", " is"),
    ("'d", " would"),
    ("'ll", " will"),
    ("'t", " not"),
    ("'ve", " have"),
    ("'m", " am"),
]

# Word-start marker of sentence pieces and the end-of-sentence piece.
MARK = "▁"
EOS_PIECE = MARK + "<EOS>"
# Characters that also start a word when pieces are combined (substring test).
COMBINE_BREAKS = ".,?!:"

# Unicode-aware "non-word" class; equals Python's \W on the data we use (Q8).
NON_WORD = r"[^\p{L}\p{N}_]+"
NOT_HAN = "[^一-龥]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_en(x) -> Column:
    """SC1: lower, contractions, runs of non-word characters -> one space."""
    c = F.lower(_c(x))
    for old, new in CONTRACTIONS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, NON_WORD, " ")


def normalize_zh(x) -> Column:
    """SC2: keep only CJK unified ideographs U+4E00-U+9FA5."""
    return F.regexp_replace(_c(x), NOT_HAN, "")


def normalize_text(x, lang) -> Column:
    """SC3: ``zh`` -> SC2, every other language -> SC1."""
    return F.when(_c(lang) == "zh", normalize_zh(x)).otherwise(normalize_en(x))


def strip_marker(x) -> Column:
    """SC4: remove the word-start marker."""
    return F.replace(_c(x), F.lit(MARK), F.lit(""))


def capitalize_first(x) -> Column:
    """SC5: upper-case the first character only (not initcap)."""
    c = _c(x)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def contains_either(a, b) -> Column:
    """SC6: one string contains the other."""
    return F.contains(_c(a), _c(b)) | F.contains(_c(b), _c(a))


def char_length_or_1(x) -> Column:
    """SC7: characters of the normalised source, 0 -> 1."""
    return F.greatest(F.coalesce(F.char_length(_c(x)), F.lit(0)), F.lit(1))


def quote_clean(x) -> Column:
    """SC11: double quote -> single quote (lexicon text)."""
    return F.replace(_c(x), F.lit('"'), F.lit("'"))


def lower_word(x) -> Column:
    """SC12."""
    return F.lower(_c(x))


def split_language_pair(df: DataFrame, lp: str = "lp") -> DataFrame:
    """PRJ3: src_lang = first two, trg_lang = last two characters of ``lp``."""
    return df.withColumn("src_lang", F.substring(F.col(lp), 1, 2)).withColumn(
        "trg_lang", F.expr(f"right({lp}, 2)")
    )


def piece_array(text, split_long: int | None = None) -> Column:
    """Pieces of a normalised text as an array (word-start marker on the first
    piece of every word).  ``split_long=k`` applies the fixture's piece rule:
    a word longer than k characters becomes its first 4 characters + the rest."""
    words = F.filter(F.split(_c(text), " "), lambda w: w != "")
    if split_long is None:
        return F.transform(words, lambda w: F.concat(F.lit(MARK), w))
    return F.flatten(F.transform(words, lambda w: F.when(
        F.char_length(w) > split_long,
        F.array(F.concat(F.lit(MARK), F.substring(w, 1, 4)), F.substr(w, F.lit(5))))
        .otherwise(F.array(F.concat(F.lit(MARK), w)))))


def with_end(pieces: Column) -> Column:
    """The pieces of a text and its end-of-sentence piece."""
    return F.concat(pieces, F.array(F.lit(EOS_PIECE)))


def tokenize(df: DataFrame, text: str, key: str = "pair_id", side: str | None = None,
             out_pos: str = "pos", out_piece: str = "piece", eos: bool = True,
             split_long: int | None = None) -> DataFrame:
    """TOKEN: normalised text -> one row per piece ``(key, [side], pos, piece)``.

    Every whitespace-separated word becomes one piece (or two under the piece
    rule) carrying the word-start marker; the end-of-sentence piece is
    appended.  Whole texts, no cap.
    """
    pieces = piece_array(text, split_long)
    if eos:
        pieces = with_end(pieces)
    cols = [key] + ([side] if side else [])
    return df.select(*cols, F.posexplode(pieces).alias(out_pos, out_piece)).withColumn(
        out_pos, F.col(out_pos).cast("int"))


def tokenize_with_pieces(tokens: DataFrame, word_pieces: DataFrame, key: str = "pair_id",
                         side: str | None = "side") -> DataFrame:
    """TOKEN with a ``word_pieces(word, pos, piece)`` table: each marked word is
    replaced by its pieces (first piece keeps the marker); unknown words stay whole."""
    cols = [key] + ([side] if side else [])
    w = tokens.withColumn("word", strip_marker("piece"))
    j = w.join(word_pieces.withColumnRenamed("pos", "ppos").withColumnRenamed("piece", "wp"),
               "word", "left")
    j = j.withColumn("piece2", F.when(F.col("wp").isNull(), F.col("piece"))
                     .when(F.col("ppos") == 0, F.concat(F.lit(MARK), F.col("wp")))
                     .otherwise(F.col("wp")))
    j = j.withColumn("ppos", F.coalesce(F.col("ppos"), F.lit(0)))
    win = Window.partitionBy(*cols).orderBy("pos", "ppos")
    return j.select(*cols, (F.row_number().over(win) - 1).cast("int").alias("pos"),
                    F.col("piece2").alias("piece"))


def word_index(pieces: DataFrame, key_cols: list[str], pos: str = "pos", piece: str = "piece",
               combine_breaks: bool = False) -> DataFrame:
    """WIN1: running count of word starts; pieces before the first start are dropped."""
    start = F.startswith(F.col(piece), F.lit(MARK))
    if combine_breaks:
        start = start | (F.expr(f"instr('{COMBINE_BREAKS}', {piece})") > 0) | (F.col(piece) == "")
    win = Window.partitionBy(*key_cols).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = pieces.withColumn("word_no", F.sum(start.cast("int")).over(win).cast("int"))
    return out.filter(F.col("word_no") >= 1)


def combine_word_text(pieces: DataFrame, key_cols: list[str], pos: str = "pos",
                      piece: str = "piece", combine_breaks: bool = True) -> DataFrame:
    """AGG7: word text = ordered concatenation of its pieces, marker removed."""
    w = word_index(pieces, key_cols, pos, piece, combine_breaks)
    g = w.groupBy(*key_cols, "word_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(piece)))).alias("ps"))
    return g.select(*key_cols, "word_no",
                    strip_marker(F.array_join(F.transform("ps", lambda s: s[piece]), "")).alias("word"))
