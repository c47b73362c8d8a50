"""Normalised segments and their pieces (shared by plans and queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rtq.functions import text as T
from rtq.sources import fixtures as FX

SPLIT_LONG = 6  # fixture piece rule: words longer than 6 characters -> 2 pieces


def seg_normalized(spark, sf, segs=None):
    s = FX.seg_conv(spark, sf) if segs is None else segs
    lang = F.substring("lp", 1, 2)
    return s.select("pair_id", "lp", lang.alias("src_lang"), T.normalize_text("src", lang).alias("nsrc"),
                    T.normalize_text("trg", lang).alias("ntrg"))


def seg_tokens(spark, sf, segs=None, split_long=SPLIT_LONG):
    n = seg_normalized(spark, sf, segs)
    both = n.select("pair_id", F.lit("src").alias("side"), F.col("nsrc").alias("text")).unionAll(
        n.select("pair_id", F.lit("trg").alias("side"), F.col("ntrg").alias("text")))
    return T.tokenize(both, "text", "pair_id", "side", split_long=split_long)
