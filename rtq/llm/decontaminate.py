"""Benchmark decontamination (operator 4): windows of canonical templates.

Numbers, names and units become typed placeholders, so a question asked again
with other values keeps its template.  Windows of 8 template words are joined
by hash, those with too few plain words by their words as written; every hit names an item, and a place of the item relative to the text
(the diagonal).  Hits of an item are then checked for slot consistency: along a
diagonal, equal values of the item's slots in found windows must meet equal
values in the text.
A text is contaminated by an item when consistent windows cover half of the
item's words.

The item side is counted: up to ``BROADCAST_WINDOWS`` windows it is broadcast,
so that only hits are shuffled; beyond that both sides meet by a shuffled join.

Defined cases: a null or empty text has no windows; items shorter than a window
(8 words) have one window of their own length; equal items are found each; repeated rows of a
document give one set of pairs; empty tables give no pairs; extra columns are
not carried by ``find_leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtq.llm.names import guarded
from rtq.llm.queries import register, table
from rtq.session import cut_lineage

WINDOW, LEAST_LITERALS, COVERAGE = 8, 4, 0.5
#: Kinds of a window's hash, as bits: of its template, of its words as written.
TEMPLATE, LITERAL = 1, 2
BROADCAST_WINDOWS = 1_000_000
#: Keys (16 bytes each) of texts with a hit that are looked up by a broadcast.
BROADCAST_TEXTS = 1_000_000
#: Marks a name; no text word contains it, as the word pattern ends at it.
NAME = "\x01"
#: A capitalised word after another word or a comma in the same sentence.
NAME_RULE = r"([\p{L}\p{N},;:]\s)(\p{Lu}\p{Ll}+)"
TOKEN = r"\x01?\p{L}[\p{L}\p{M}]*|[0-9]+(?:[.,:][0-9]+)*"
#: Unit words.
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters "
         "litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
         "cent cents dollar dollars euro euros percent meter meters metre metres gram grams").split()


def _tokens(text: Column) -> Column:
    """Lower-cased words and numbers; names keep their mark in front."""
    marked = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(NAME), F.lit(" ")), NAME_RULE, "$1" + NAME + "$2")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def _canonical(token: Column) -> Column:
    """A token starts with the name mark, a digit or a letter, in this order of bytes."""
    return (F.when(token < "\x02", F.lit("<name>")).when(token < ":", F.lit("<number>"))
            .when(token.isin(*UNITS), F.lit("<unit>")).otherwise(token))


def _plain(token: Column) -> Column:
    """The token as written, without the name mark."""
    return F.ltrim(token, F.lit(NAME))


def _window_hash(hashes: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])


def _forms(raw: Column) -> list[Column]:
    """Word hashes of the template and of the words as written."""
    return [F.transform(raw, lambda x: F.xxhash64(_canonical(x))), F.transform(raw, lambda x: F.xxhash64(_plain(x)))]


def _windows(width: int) -> Column:
    """Of columns n, template and literal: (at, hash, kinds) of every window of ``width`` words; a
    window without slots is both kinds at once."""
    def hashes(i):
        return F.struct(i.alias("at"), _window_hash(F.col("template"), i, width).alias("t"), _window_hash(F.col("literal"), i, width).alias("w"))

    def kinds(x):
        one = lambda h, k: F.struct(x["at"].alias("at"), h.alias("hash"), F.lit(k).cast("int").alias("kinds"))
        return F.when(x["t"] == x["w"], F.array(one(x["t"], TEMPLATE + LITERAL))).otherwise(F.array(one(x["t"], TEMPLATE), one(x["w"], LITERAL)))
    none = F.array().cast("array<struct<at:int,hash:bigint,kinds:int>>")
    return F.when(F.col("n") >= width, F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.col("n") - width), hashes), kinds))).otherwise(none)


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, item_words, item_at (place), hash and kinds of every window; an item
    shorter than a window has one of its own length.  A window with enough plain
    words is looked up by its template, any other by its words as written."""
    t = items.select("item_id", _tokens(F.col("text")).alias("raw"))
    template, literal = _forms(F.col("raw"))
    t = t.select("item_id", F.transform("raw", _canonical).alias("form"), F.size("raw").alias("n"), template.alias("template"), literal.alias("literal"))
    own = F.coalesce(*[F.when(F.col("n") == k, _windows(k)) for k in range(1, WINDOW)], _windows(WINDOW))
    w = t.select("item_id", "n", "form", F.explode_outer(own).alias("w")).select("item_id", "n", "form", "w.*")
    enough = F.size(F.filter(F.slice("form", F.col("at") + 1, WINDOW), lambda x: ~x.startswith("<"))) >= LEAST_LITERALS
    w = w.withColumn("kinds", F.when(enough, F.col("kinds").bitwiseAND(F.lit(TEMPLATE))).otherwise(F.col("kinds").bitwiseAND(F.lit(LITERAL))))
    return w.where("kinds <> 0").select("item_id", F.col("n").alias("item_words"), F.col("at").alias("item_at"), "hash", "kinds")


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, item_words, item_at, at, template): a text's windows
    that are an item's, by template or only as written."""
    template, literal = _forms(F.col("raw"))
    t = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), _tokens(F.col("text")).alias("raw"))
    t = t.select("doc_id", "text_key", F.size("raw").alias("n"), template.alias("template"), literal.alias("literal"))
    # The lengths of items shorter than a window: at most WINDOW - 1 rows.
    short = [r.item_words for r in windows.where(F.col("item_words") < WINDOW).select("item_words").distinct().collect()]
    t = t.select("doc_id", "text_key", F.concat(*[_windows(k) for k in [WINDOW, *sorted(short)]]).alias("w"))
    # The outer form: for the inner one the optimizer adds a filter on the array
    # below, which would make every word anew for each window.
    t = t.select("doc_id", "text_key", F.explode_outer("w").alias("w")).select(
        "doc_id", "text_key", F.col("w.at").alias("at"), F.col("w.hash").alias("hash"), F.col("w.kinds").alias("text_kinds"))
    small = windows.count() <= BROADCAST_WINDOWS
    hit = t.join(F.broadcast(windows) if small else windows, "hash").withColumn("kinds", F.col("kinds").bitwiseAND(F.col("text_kinds")))
    return hit.where("kinds <> 0").select("doc_id", "text_key", "item_id", "item_words", "item_at", "at", (F.col("kinds") == TEMPLATE).alias("template"))


def _doc(text_key: Column) -> Column:
    return F.struct("doc_id", text_key.alias("text_key")).alias("doc")


def find_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs doc_id, item_id with ``n_windows`` (distinct item windows found), the
    ``covered`` share of the item's words and ``slots_changed``: whether a slot
    has another value than in the item.

    Found templates are counted per diagonal first; a diagonal whose slot values
    contradict each other does not count.  Windows found as written always do."""
    windows = cut_lineage(item_windows(items), "item-windows")
    # Structs are equal when their null fields are, so rows with a null ID find each other.
    hits = _hits(docs, windows).select(_doc(F.col("text_key")), F.struct("item_id").alias("item"), "item_words", "item_at", "at", "template")
    hits = cut_lineage(hits.distinct(), "hits").withColumn("shift", F.col("at") - F.col("item_at"))
    width = F.least(F.lit(WINDOW), F.col("item_words"))
    diagonals = hits.where("template").groupBy("doc", "item", "item_words", "shift").agg(
        F.min("at").alias("lo"), (F.max("at") + width).alias("hi"), F.collect_set("item_at").alias("places"))
    # Slot values along a diagonal: the item's from its table, the text's from its words there.
    # Only texts with a hit are moved: up to BROADCAST_TEXTS keys are sent to the table.
    found = cut_lineage(diagonals.select("doc").distinct(), "found")
    if found.count() <= BROADCAST_TEXTS:
        found = F.broadcast(found)
    texts = docs.where(F.col("text").isNotNull()).select(_doc(F.xxhash64("text")), "text")
    texts = texts.join(found, "doc", "left_semi").dropDuplicates(["doc"])
    raw = texts.select("doc", _tokens(F.col("text")).alias("raw"))
    part = diagonals.join(raw, "doc").select(
        "doc", "item", "shift", "lo", "places", width.alias("width"), F.slice("raw", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("words"))
    slots = items.select(F.struct("item_id").alias("item"), F.posexplode(_tokens(F.col("text"))).alias("place", "value"))
    slots = slots.withColumn("form", _canonical(F.col("value"))).where(F.col("form").startswith("<")).groupBy("item").agg(
        F.collect_list(F.struct("place", "form", "value")).alias("slots"))
    # Slots met are those inside a found window, not all between the first and the last.
    pairs = part.join(slots, "item", "left").select("doc", "item", "shift", F.transform(F.filter(
        F.coalesce("slots", F.array().cast("array<struct<place:int,form:string,value:string>>")),
        lambda s: F.exists("places", lambda p: (s["place"] >= p) & (s["place"] < p + F.col("width")))),
        lambda s: F.struct(s["form"].alias("form"), s["value"].alias("mine"),
                           F.get("words", s["place"] + F.col("shift") - F.col("lo")).alias("theirs"))).alias("met"))
    mine = F.transform("met", lambda m: F.struct(m["form"], m["mine"]))
    pairs = pairs.select("doc", "item", "shift",
                         (F.size(F.array_distinct("met")) == F.size(F.array_distinct(mine))).alias("consistent"),
                         F.exists("met", lambda m: m["mine"] != m["theirs"]).alias("changed"))
    # A hit by template counts on a consistent diagonal, a hit as written anywhere.
    key = ["doc", "item", "shift"]
    counted = [*hits.columns, "changed"]
    good = hits.where("template").join(pairs.where("consistent").select(*key, "changed"), key).select(*counted).unionByName(
        hits.where(~F.col("template")).withColumn("changed", F.lit(False)).select(*counted))
    places = good.groupBy("doc", "item", "item_words").agg(
        F.sort_array(F.collect_set("item_at")).alias("places"), F.max("changed").alias("slots_changed"))
    span = F.aggregate(F.transform("places", lambda p, i: F.least(width, F.coalesce(F.get("places", i + 1) - p, width))),
                       F.lit(0), lambda a, x: a + x)
    out = places.select("doc.doc_id", "doc.text_key", "item.item_id", F.size("places").cast("long").alias("n_windows"),
                        (span / F.col("item_words")).alias("covered"), "slots_changed")
    return out.where(F.col("covered") >= coverage)


@guarded()
def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    bad = cut_lineage(find_leaks(docs, items).select("doc_id", "text_key").distinct(), "contaminated")
    keyed = docs.withColumn("_k", F.xxhash64("text"))
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_k2"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_k2")), "left_anti").select(*docs.columns)


_UNIT_SQL = ", ".join(f"'{u}'" for u in UNITS)
ORACLE = rf"""
WITH tok AS (
       SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(lower(regexp_replace(replace(text, chr(1), ' '),
              '([\p{{L}}\p{{N}},;:]\s)(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(1) || '\2', 'g')), '\x01?\p{{L}}[\p{{L}}\p{{M}}]*|[0-9]+(?:[.,:][0-9]+)*') AS w FROM documents
       UNION ALL
       SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(lower(regexp_replace(replace(text, chr(1), ' '),
              '([\p{{L}}\p{{N}},;:]\s)(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(1) || '\2', 'g')), '\x01?\p{{L}}[\p{{L}}\p{{M}}]*|[0-9]+(?:[.,:][0-9]+)*') FROM benchmark),
     form AS (SELECT *, list_transform(w, lambda x: CASE WHEN starts_with(x, chr(1)) THEN '<name>' WHEN regexp_matches(x, '^[0-9]') THEN '<number>'
                     WHEN x IN ({_UNIT_SQL}) THEN '<unit>' ELSE x END) AS f FROM tok),
     win AS (SELECT side, id, r, len(f) AS n, i, array_to_string(f[i+1:i+{WINDOW}], ' ') AS s,
                    len(list_filter(f[i+1:i+{WINDOW}], lambda x: NOT starts_with(x, '<'))) AS literals
             FROM (SELECT *, unnest(range(len(f) - {WINDOW - 1})) AS i FROM form WHERE len(f) >= {WINDOW})),
     hit AS (SELECT DISTINCT d.id AS doc_id, d.r, b.id AS item_id, b.r AS br, b.n, b.i AS item_at, d.i - b.i AS shift
             FROM win d JOIN win b ON d.side = 'd' AND b.side = 'b' AND d.s = b.s AND b.literals >= {LEAST_LITERALS}),
     diag AS (SELECT doc_id, r, item_id, br, shift, min(item_at) AS lo, max(item_at) + {WINDOW} AS hi FROM hit GROUP BY ALL),
     met AS (SELECT g.doc_id, g.r, g.item_id, g.br, g.shift, b.f[p + 1] AS form, b.w[p + 1] AS mine, d.w[p + g.shift + 1] AS theirs
             FROM (SELECT *, unnest(range(lo, hi)) AS p FROM diag) g JOIN form b ON b.side = 'b' AND b.r = g.br JOIN form d ON d.side = 'd' AND d.r = g.r
             WHERE starts_with(b.f[p + 1], '<')),
     odd AS (SELECT doc_id, r, item_id, br, shift, count(DISTINCT (form, mine, theirs)) <> count(DISTINCT (form, mine)) AS bad,
                    bool_or(mine <> theirs) AS changed FROM met GROUP BY ALL),
     good AS (SELECT h.*, coalesce(odd.changed, false) AS changed FROM hit h LEFT JOIN odd USING (doc_id, r, item_id, br, shift) WHERE NOT coalesce(odd.bad, false)),
     cov AS (SELECT doc_id, r, item_id, n, count(DISTINCT p) AS words FROM (SELECT *, unnest(range(item_at, item_at + {WINDOW})) AS p FROM good) GROUP BY ALL),
     agg AS (SELECT doc_id, r, item_id, count(DISTINCT item_at) AS n_windows, bool_or(changed) AS slots_changed FROM good GROUP BY ALL)
SELECT DISTINCT doc_id, item_id, n_windows::BIGINT AS n_windows, round(words / n, 6)::DOUBLE AS covered, slots_changed
FROM cov JOIN agg USING (doc_id, r, item_id) WHERE words / n >= {COVERAGE}
"""


@register("op4_decontamination", ORACLE)
def op4_decontamination(spark, sf_dir):
    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_windows", F.round("covered", 6).alias("covered"), "slots_changed")
