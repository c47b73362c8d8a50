"""License scans (operator 5): a positional rare-token index of licence texts.

A template is indexed by its words that the fewest templates share (highest
IDF), each with its place.  A file's places of such words, less the template
places, vote for a start; a start that enough words agree on is a candidate,
and counts when the template's mandatory phrase stands at its place there.
Phrases of the base rules are the same with every word mandatory.

All of it is array arithmetic within the row (no shuffle, no user function);
texts without any indexed word are settled by one regular expression.  The
templates are a fixed small table compiled into the plan.

Defined cases: a null or empty text has no words and no labels (empty strings,
score 0, null places); repeated rows are scanned one by one; an empty table
gives no rows; input columns are kept by ``scan``, its own replace those of the
same name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtq.llm.names import guarded
from rtq.llm.queries import register, table

#: What lies between words: of the lower-cased text, and of the text as it is.
#: (Splitting at these ASCII sets is several times faster than matching words.)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Indexed words of a template, and the share of them that must agree on a start.
RARE_WORDS, AGREE = 4, 0.6

#: Words never indexed.
FUNCTION_WORDS = frozenset("in of the to and by is are this or with any use v from under into work terms free subject".split())

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Label, licence text, mandatory phrase within it.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]


@dataclass(frozen=True)
class Template:
    label: str
    rare: tuple[tuple[str, int], ...]   # word, place
    must: tuple[str, ...]
    must_at: int

    @property
    def need(self) -> int:
        return max(1, math.ceil(AGREE * len(self.rare)))


def _spread(templates: list[tuple[str, str, str]]) -> dict[str, int]:
    """In how many templates a word stands."""
    df: dict[str, int] = {}
    for _, text, _ in templates:
        for w in set(text.split()):
            df[w] = df.get(w, 0) + 1
    return df


def build_index(templates: list[tuple[str, str, str]]) -> list[Template]:
    """Per template the content words of highest IDF, ties to the longer and then
    to the earlier."""
    df, out = _spread(templates), []
    for label, text, must in templates:
        words, must = text.split(), must.split()
        at = next(i for i in range(len(words)) if words[i: i + len(must)] == must)
        content = [i for i, w in enumerate(words) if w.isalpha() and w not in FUNCTION_WORDS]
        rare = sorted(content, key=lambda i: (df[words[i]], -len(words[i]), i))[:RARE_WORDS]
        out.append(Template(label, tuple((words[i], i) for i in sorted(rare)), tuple(must), at))
    return out


def _phrases(base: list[tuple[str, str]], templates: list[tuple[str, str, str]]) -> list[tuple[str, tuple[str, ...], int]]:
    """(label, words, place of its rarest word)."""
    df, out = _spread(templates), []
    for phrase, label in base:
        words = tuple(phrase.split())
        content = [i for i, w in enumerate(words) if w not in FUNCTION_WORDS] or range(len(words))
        out.append((label, words, min(content, key=lambda i: (df.get(words[i], 0), -len(words[i]), i))))
    return out


def _same(words: Column, start: Column, phrase: tuple[str, ...]) -> Column:
    return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, len(phrase)) == F.array(*[F.lit(w) for w in phrase]))


@guarded()
def scan(docs: DataFrame, text: str = "text", base: list[tuple[str, str]] = BASE,
         templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index, df = build_index(templates), _spread(templates)
    phrases = _phrases(base, templates)
    sought = sorted({w for t in index for w, _ in t.rare} | {p[1][p[2]] for p in phrases})
    # Any label needs the rarest word of its mandatory phrase.
    needed = sorted({min(t.must, key=lambda w: (df[w], -len(w))) for t in index} | {p[1][p[2]] for p in phrases})
    keep = [c for c in docs.columns if c not in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    t = F.coalesce(F.col(text), F.lit(""))
    gate = t.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, needed)) + ")(?![a-z0-9])")
    # lower() alone would turn two non-ASCII letters into ASCII ones.
    low = F.lower(F.replace(F.replace(t, F.lit("\u212a"), F.lit("κ")), F.lit("\u0130"), F.lit("ι")))
    words, found = F.col("_w"), F.col("_f")
    step = docs.select(*keep, F.split(t, RAW_GAP).alias("_p"), F.when(gate, F.filter(F.split(low, GAP), lambda w: w != "")).otherwise(
        F.array().cast("array<string>")).alias("_w"))
    n = F.size("_p")
    step = step.withColumn("n_words", (n - (F.get("_p", F.lit(0)) == "").cast("int") - ((n > 1) & (F.get("_p", n - 1) == "")).cast("int")).cast("long"))
    step = step.withColumn("_f", F.filter(F.transform(words, lambda w, i: F.when(
        w.isin(*sought), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull()))

    def places(word: str, at: int) -> Column:
        return F.transform(F.filter(found, lambda x: x["w"] == word), lambda x: x["i"] - at)

    def base_places(phrase: tuple[str, ...], at: int) -> Column:
        return F.filter(places(phrase[at], at), lambda s: _same(words, s, phrase))

    def first_start(tp: Template, starts: Column) -> Column:
        """The least start that enough rare words agree on (they lie side by side
        in the sorted votes) and where the mandatory phrase stands."""
        agreed = F.transform(starts, lambda s, i: F.when(
            (F.get(starts, i + (tp.need - 1)) == s) & _same(words, s + tp.must_at, tp.must), s))
        return F.get(F.filter(agreed, lambda s: s.isNotNull()), F.lit(0))

    def share(tp: Template, starts: Column, start: Column) -> Column:
        return F.coalesce(F.size(F.filter(starts, lambda s: s == start)) / F.lit(float(len(tp.rare))), F.lit(0.0))

    step = step.withColumns({f"_b{k}": base_places(ws, at) for k, (_, ws, at) in enumerate(phrases)})
    step = step.withColumns({f"_s{k}": F.sort_array(F.concat(*[places(w, at) for w, at in tp.rare])) for k, tp in enumerate(index)})
    step = step.withColumns({f"_v{k}": first_start(tp, F.col(f"_s{k}")) for k, tp in enumerate(index)})
    all_base = F.concat(*[F.col(f"_b{k}") for k in range(len(phrases))])
    base_names = F.array(*[F.when(F.size(f"_b{k}") > 0, F.lit(label)) for k, (label, _, _) in enumerate(phrases)])
    names = F.array(*[F.when(F.col(f"_v{k}").isNotNull(), F.lit(tp.label)) for k, tp in enumerate(index)])
    score = F.greatest(F.lit(0.0), *[F.when(F.col(f"_v{k}").isNotNull(), share(tp, F.col(f"_s{k}"), F.col(f"_v{k}"))).otherwise(F.lit(0.0))
                                     for k, tp in enumerate(index)])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    none = F.size(all_base) == 0
    return step.select(*keep, "n_words", F.size(all_base).cast("long").alias("n_base"),
                       F.when(~none, F.array_min(all_base)).cast("long").alias("first_word"),
                       F.when(~none, F.array_max(all_base)).cast("long").alias("last_word"),
                       listed(base_names).alias("base_labels"), listed(F.concat(base_names, names)).alias("labels"),
                       F.when(none, F.when(F.size(found) > 0, score).otherwise(F.lit(0.0))).otherwise(F.lit(1.0)).alias("score"))


def _oracle() -> str:
    lit = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = [(p.split(), label) for p, label in BASE]
    index = build_index(TEMPLATES)
    hit = [f"list_filter(range(len(w) - {len(p) - 1}), lambda i: w[i+1:i+{len(p)}] = {lit(p)})" for p, _ in phrases]
    rare = ", ".join(f"({k}, '{w}', {at})" for k, t in enumerate(index) for w, at in t.rare)
    must = ", ".join(f"({k}, '{t.label}', {t.must_at}, {lit(t.must)}, {t.need}, {len(t.rare)})" for k, t in enumerate(index))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     b AS (SELECT r, {', '.join(f'{h} AS b{k}' for k, h in enumerate(hit))} FROM d),
     u AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
     rare(t, x, pos) AS (VALUES {rare}),
     must(t, label, pos, ws, need, n) AS (VALUES {must}),
     v AS (SELECT r, t, i - pos AS s, count(*) AS c FROM u JOIN rare USING (x) GROUP BY ALL),
     ok AS (SELECT v.r, must.label, v.t, v.s, v.c / must.n AS share FROM v JOIN must USING (t) JOIN d USING (r)
            WHERE v.c >= must.need AND v.s + must.pos >= 0 AND d.w[v.s + must.pos + 1 : v.s + must.pos + len(must.ws)] = must.ws),
     best AS (SELECT r, list(DISTINCT label) AS names, max(share) AS score FROM (SELECT r, t, label, min_by(share, s) AS share FROM ok GROUP BY r, t, label) GROUP BY r),
     a AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, {' || '.join(f'b{k}' for k in range(len(hit)))} AS base,
                  list_filter([{', '.join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))}], lambda x: x IS NOT NULL) AS bl,
                  coalesce(best.names, []) AS tl, coalesce(best.score, 0) AS score
           FROM d JOIN b USING (r) LEFT JOIN best USING (r))
SELECT doc_id, n_words, len(base)::BIGINT AS n_base, list_min(base)::BIGINT AS first_word, list_max(base)::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(bl)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(bl || tl)), ','), '') AS labels,
       round(CASE WHEN len(base) > 0 THEN 1.0 ELSE score END, 6)::DOUBLE AS score FROM a
"""


@register("op5_license_scans", _oracle())
def op5_license_scans(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))
