"""Driver queries for text functions and tokenisation (SC1-SC7, SC11, SC12, TOKEN, WIN1, AGG7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rtq.functions import text as T
from rtq.plans.registry import register
from rtq.sources import fixtures as FX
from rtq.sources.fixtures import duck_with

from rtq.plans.segments import SPLIT_LONG, seg_normalized, seg_tokens  # noqa: F401


def duck_norm_en(x: str) -> str:
    c = f"lower({x})"
    for old, new in T.CONTRACTIONS:
        c = f"replace({c}, '{old.replace(chr(39), chr(39) * 2)}', '{new}')"
    return f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"


def duck_norm_zh(x: str) -> str:
    return f"regexp_replace({x}, '[^一-龥]', '', 'g')"


def duck_norm(x: str, lang: str) -> str:
    return f"CASE WHEN {lang} = 'zh' THEN {duck_norm_zh(x)} ELSE {duck_norm_en(x)} END"


def duck_pieces(x: str, split_long: int | None = SPLIT_LONG) -> str:
    words = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    if split_long is None:
        p = f"list_transform({words}, lambda w: '▁' || w)"
    else:
        p = (f"flatten(list_transform({words}, lambda w: CASE WHEN length(w) > {split_long} "
             f"THEN ['▁' || substr(w, 1, 4), substr(w, 5)] ELSE ['▁' || w] END))")
    return f"list_concat({p}, ['▁<EOS>'])"


# Normalised segments and their pieces, shared by later query modules.
DUCK_SEGN = ("segn", f"""SELECT pair_id, lp, substr(lp, 1, 2) AS src_lang,
  {duck_norm('src', 'substr(lp, 1, 2)')} AS nsrc, {duck_norm('trg', 'substr(lp, 1, 2)')} AS ntrg FROM seg_conv""")
DUCK_TOKS = ("toks", f"""SELECT pair_id, side, CAST(pos AS INTEGER) AS pos, piece FROM (
  SELECT pair_id, side, unnest(range(len(p))) AS pos, unnest(p) AS piece FROM (
    SELECT pair_id, 'src' AS side, {duck_pieces('nsrc')} AS p FROM segn
    UNION ALL SELECT pair_id, 'trg', {duck_pieces('ntrg')} FROM segn) a) b""")


@register("SC1_normalize_en", f"SELECT conv_id, turn, {duck_norm_en('text')} AS norm FROM conversations")
def q_sc1(spark, sf):
    return FX.table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_en("text").alias("norm"))


# The texts hold no Han character: vowels stand for some, a and e for the first and last of the range kept,
# i for the one after it.
VOWELS, HAN = "aeiou", "\u4e00\u9fa5\u9fa6中文"
D_HAN = f"translate(text, '{VOWELS}', '{HAN}')"


@register("SC2_normalize_zh", f"""SELECT conv_id, turn, {duck_norm_zh('text')} AS norm, {duck_norm_zh(D_HAN)} AS norm_han
FROM conversations""")
def q_sc2(spark, sf):
    return FX.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.normalize_zh("text").alias("norm"), T.normalize_zh(F.translate("text", VOWELS, HAN)).alias("norm_han"))


@register("SC3_normalize_text", f"SELECT doc_id, {duck_norm('text', 'lang')} AS norm FROM documents")
def q_sc3(spark, sf):
    return FX.table(spark, sf, "documents").select("doc_id", T.normalize_text("text", "lang").alias("norm"))


@register("TOKEN_tokenize_segments", duck_with([DUCK_SEGN, DUCK_TOKS], "SELECT * FROM toks", ["seg_conv"]))
def q_token(spark, sf):
    return seg_tokens(spark, sf)


@register("SC4_strip_marker", duck_with([DUCK_SEGN, DUCK_TOKS],
                                        "SELECT pair_id, side, pos, replace(piece, '▁', '') AS token FROM toks",
                                        ["seg_conv"]))
def q_sc4(spark, sf):
    return seg_tokens(spark, sf).select("pair_id", "side", "pos", T.strip_marker("piece").alias("token"))


@register("WIN1_word_index", duck_with([DUCK_SEGN, DUCK_TOKS], """SELECT * FROM (
  SELECT pair_id, side, pos, CAST(sum(CASE WHEN starts_with(piece, '▁') THEN 1 ELSE 0 END)
     OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS word_no
  FROM toks) x WHERE word_no >= 1""", ["seg_conv"]))
def q_win1(spark, sf):
    return T.word_index(seg_tokens(spark, sf), ["pair_id", "side"]).select("pair_id", "side", "pos", "word_no")


@register("AGG7_combine_word_text", duck_with([DUCK_SEGN, DUCK_TOKS], """SELECT pair_id, side, word_no,
  replace(string_agg(piece, '' ORDER BY pos), '▁', '') AS word FROM (
  SELECT *, CAST(sum(CASE WHEN starts_with(piece, '▁') OR instr('.,?!:', piece) > 0 THEN 1 ELSE 0 END)
     OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS word_no
  FROM toks) x WHERE word_no >= 1 GROUP BY pair_id, side, word_no""", ["seg_conv"]))
def q_agg7(spark, sf):
    return T.combine_word_text(seg_tokens(spark, sf), ["pair_id", "side"])


@register("SC5_capitalize_first", duck_with(None, """SELECT tok,
  concat(CASE WHEN substr(tok,1,1)='ß' THEN 'SS' ELSE upper(substr(tok,1,1)) END, substr(tok,2)) AS cap FROM vocab""",
                                            ["vocab"]))
def q_sc5(spark, sf):
    return FX.vocab(spark, sf).select("tok", T.capitalize_first("tok").alias("cap"))


@register("SC6_contains_either", duck_with([DUCK_SEGN, DUCK_TOKS], """SELECT a.pair_id, a.pos,
  (contains(replace(a.piece,'▁',''), replace(b.piece,'▁','')) OR contains(replace(b.piece,'▁',''), replace(a.piece,'▁',''))) AS related
FROM toks a JOIN toks b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 'src' AND b.side = 'trg'""", ["seg_conv"]))
def q_sc6(spark, sf):
    t = seg_tokens(spark, sf).withColumn("w", T.strip_marker("piece"))
    a = t.filter("side = 'src'").select("pair_id", "pos", F.col("w").alias("a"))
    b = t.filter("side = 'trg'").select("pair_id", "pos", F.col("w").alias("b"))
    return a.join(b, ["pair_id", "pos"]).select("pair_id", "pos", T.contains_either("a", "b").alias("related"))


@register("SC7_char_length_or_1", duck_with([DUCK_SEGN], """SELECT pair_id,
  CAST(greatest(length(nsrc), 1) AS INTEGER) AS n FROM segn""", ["seg_conv"]))
def q_sc7(spark, sf):
    return seg_normalized(spark, sf).select("pair_id", T.char_length_or_1("nsrc").cast("int").alias("n"))


@register("SC11_quote_clean", """SELECT conv_id, turn, replace(text, '"', '''') AS text,
  replace(text, ' ', '''') AS quoted FROM conversations""")
def q_sc11(spark, sf):
    """``quoted``: the texts hold no double quote, so blanks become some first."""
    quoted = F.translate("text", " ", '"')
    return FX.table(spark, sf, "conversations").select("conv_id", "turn", T.quote_clean("text").alias("text"), T.quote_clean(quoted).alias("quoted"))


@register("SC12_lower_word", "SELECT doc_id, lower(text) AS text FROM documents")
def q_sc12(spark, sf):
    return FX.table(spark, sf, "documents").select("doc_id", T.lower_word("text").alias("text"))
