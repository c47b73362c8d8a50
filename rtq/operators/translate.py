"""Back translation: JN13 and INF1.

Texts are translated once per distinct (language pair, text).  Stored
translations are joined; only the remainder goes to the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtq.session import cut_lineage

#: Shuffle keys the texts of one language pair are dealt to.
PAIR_TASKS = 256


def attach_back_translation(segments: DataFrame, translations: DataFrame, text: str = "mt") -> tuple[DataFrame, DataFrame]:
    """JN13: left join segments to finished translations on (src_lang,
    trg_lang, text).  Returns (segments with ``trg``, distinct untranslated
    remainder ``(src_lang, trg_lang, text)``)."""
    seg = segments.withColumn("src_lang", F.substring("lp", 1, 2)).withColumn("trg_lang", F.expr("right(lp, 2)"))
    # A text stored more than once has the least of its translations.
    tr = translations.groupBy("src_lang", "trg_lang", F.col("text").alias(text)).agg(F.min("translation").alias("trg"))
    joined = seg.drop("trg") if "trg" in seg.columns else seg
    joined = joined.join(tr, ["src_lang", "trg_lang", text], "left")
    todo = seg.select("src_lang", "trg_lang", F.col(text).alias("text")).distinct().join(
        translations.select("src_lang", "trg_lang", "text"), ["src_lang", "trg_lang", "text"], "left_anti")
    return joined, todo


def batch_translate(todo: DataFrame, make_translator: Callable[[str, str], Callable[[list[str]], list[str]]],
                    batch_size: int = 64) -> DataFrame:
    """INF1: translate ``(src_lang, trg_lang, text)`` back into the source
    language with a user-supplied model.  Rows are clustered by language pair,
    each pair over up to ``PAIR_TASKS`` tasks; a task loads the model of a pair
    once and translates Arrow batches.
    ``make_translator(from_lang, to_lang)`` returns ``f(list[str]) -> list[str]``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[tuple[str, str], Callable] = {}
        for pdf in batches:
            out = []
            for (sl, tl), g in pdf.groupby(["src_lang", "trg_lang"], sort=False):
                key = (tl, sl)  # back translation: target language -> source language
                if key not in models:
                    models[key] = make_translator(tl, sl)
                f = models[key]
                texts = g["text"].tolist()
                res = []
                for i in range(0, len(texts), batch_size):
                    res += list(f(texts[i:i + batch_size]))
                out.append(pd.DataFrame({"src_lang": sl, "trg_lang": tl, "text": texts, "translation": res}))
            if out:
                yield pd.concat(out, ignore_index=True)
    salt = F.pmod(F.xxhash64("text"), F.lit(PAIR_TASKS))
    clustered = todo.repartition("src_lang", "trg_lang", salt).sortWithinPartitions("src_lang", "trg_lang")
    return clustered.mapInPandas(run, "src_lang string, trg_lang string, text string, translation string")


def lexicon_translate(todo: DataFrame, dictionary: DataFrame) -> DataFrame:
    """INF1 test double as a plain join: word-by-word substitution through a
    ``dictionary(form, lemma)`` table; unknown words are kept.  Whole texts."""
    # A text is named by a number while its words are looked up: beside each of its words it would be shuffled once a word.
    texts = cut_lineage(todo.select("src_lang", "trg_lang", "text", F.monotonically_increasing_id().alias("_id")), "numbered-texts")
    words = texts.select("_id", F.posexplode(F.split(F.col("text"), " ")).alias("pos", "w"))
    d = cut_lineage(dictionary.groupBy(F.col("form").alias("w")).agg(F.min("lemma").alias("tw")), "dictionary")
    t = words.join(d, "w", "left").withColumn("tw", F.coalesce("tw", "w"))
    g = t.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tw"))).alias("ws"))
    out = g.select("_id", F.array_join(F.transform("ws", lambda x: x["tw"]), " ").alias("translation"))
    return texts.join(out, "_id").select("src_lang", "trg_lang", "text", "translation")


def complete_back_translation(segments: DataFrame, store: DataFrame, translate: Callable[[DataFrame], DataFrame],
                              text: str = "mt") -> DataFrame:
    """Entry 2: stored translations first, the rest through ``translate``, joined back."""
    _, todo = attach_back_translation(segments, store, text)
    fresh = translate(todo)
    full = store.select("src_lang", "trg_lang", "text", "translation").unionByName(fresh)
    joined, _ = attach_back_translation(segments, full, text)
    return joined
