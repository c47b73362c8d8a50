"""Quality rules (operator 3): a table of thresholds compiled into one projection.

Every metric is a built-in expression over the whole text, so the scan, the
metrics and the verdict are one stage without a shuffle or a user function.

Defined cases: a null or empty text has no words, all metrics 0 and fails the
base rules; repeated rows are judged one by one; an empty table gives no rows;
extra columns of the input are kept by ``judge`` unless they clash with a
metric's name, which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtq.llm.names import guarded
from rtq.llm.queries import register, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages.
STOP_WORDS = ("the be to of and that have with is are this "
              "der die das und ist von mit für den ein "
              "le la les de des et un une que pour "
              "el los las en y por con para del se").split()


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high`` (None: no bound)."""
    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds; ratios are per word, per line or per character as named.
RULES = (
    Rule("n_words", low=50, high=1_000_000),
    Rule("mean_word_length", low=2.0, high=16.0),
    Rule("symbols_per_word", high=0.25),
    Rule("stop_word_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.30),
    Rule("bullet_line_ratio", high=0.90),
    Rule("ellipsis_line_ratio", high=0.30),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _window_hashes(words: Column, n: Column) -> Column:
    """Hash of every 3-word window in order.  Hashes are compared within one
    text only, where 64 bits tell windows apart."""
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def _sorted_windows(hashes: Column) -> Column:
    """(hash, place) of every window, equal windows side by side; null where all
    windows differ, so that only texts with a repeat are sorted."""
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeat_starts(ordered: Column) -> Column:
    """Places of the windows that equal a neighbour in the sorted list, ascending."""
    return F.sort_array(F.filter(F.transform(ordered, lambda x, k: F.when(
        F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda x: x.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words the windows at these places cover: 3 each, less what the next one covers."""
    return F.coalesce(F.aggregate(F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3)))),
                                  F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long"))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the metrics of every whole text as columns.

    The array steps are separate projections so that each is evaluated once."""
    words, n, lines = F.col("_w"), F.col("_n"), F.col("_lines")
    t = F.col("_t")
    step = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({
        "_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)),
    }).withColumn("_n", F.size("_w"))
    step = step.withColumn("_win", _window_hashes(words, n))
    step = step.withColumn("_win", _sorted_windows(F.col("_win")))
    step = step.withColumn("_win", _repeat_starts(F.col("_win")))
    step = step.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_repeat_words": _covered(F.col("_win")),
        "_n_lines": F.size(lines),
        "_n_distinct": F.size(F.array_distinct(lines)),
        "_n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "_n_bullet": F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))),
        "_n_ellipsis": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    })
    return step.withColumns({
        "n_dup_lines": (F.col("_n_lines") - F.col("_n_distinct")).cast("long"),
        "mean_word_length": _ratio(F.col("word_chars"), n),
        "symbols_per_word": _ratio(F.col("n_symbols"), n),
        "stop_word_ratio": _ratio(F.col("_n_stop"), n),
        "dup_line_ratio": _ratio(F.col("_n_lines") - F.col("_n_distinct"), F.col("_n_lines")),
        "bullet_line_ratio": _ratio(F.col("_n_bullet"), F.col("_n_lines")),
        "ellipsis_line_ratio": _ratio(F.col("_n_ellipsis"), F.col("_n_lines")),
    }).drop("_t", "_w", "_n", "_lines", "_win", "_n_lines", "_n_distinct", "_n_stop", "_n_bullet", "_n_ellipsis")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression from the threshold table."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.metric) >= F.lit(r.low))
        if r.high is not None:
            verdict = verdict & (F.col(r.metric) <= F.lit(r.high))
    return verdict


@guarded()
def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add metrics, ``base_failed`` and ``kept`` to every row."""
    m = with_metrics(docs, text)
    m = m.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return m.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


_METRIC_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l
           FROM documents),
     rows AS (SELECT row_number() OVER () AS r, * FROM d),
     tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM rows WHERE len(w) >= 3),
     win AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM tri),
     rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
     cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
     m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
                  length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
                  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
                  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
                  len(list_filter(w, lambda x: list_contains([{', '.join("'" + w + "'" for w in STOP_WORDS)}], lower(x)))) AS n_stop,
                  len(list_filter(l, lambda x: left(ltrim(x), 1) IN ('-', '*', '•'))) AS n_bullet,
                  len(list_filter(l, lambda x: (suffix(rtrim(x), '...') OR suffix(rtrim(x), '…')))) AS n_ell
           FROM rows LEFT JOIN cov USING (r))
"""

ORACLE = _METRIC_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND n_words <= 1000000
       AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 16.0
       AND n_symbols / n_words <= 0.25 AND n_stop / n_words >= 0.01
       AND n_dup_lines / n_lines <= 0.30 AND n_bullet / n_lines <= 0.90
       AND n_ell / n_lines <= 0.30 AS kept
FROM m
"""


@register("op3_quality_rules", ORACLE)
def op3_quality_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
