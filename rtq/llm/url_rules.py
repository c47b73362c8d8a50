"""URL filters (operator 2): sort-merge range join of urls and nested rules.

A host turns into a reversed-label key (``www.example.com`` -> ``com.example.www.``),
so a rule for a host and its subdomains is the interval of keys with that
prefix.  Urls and rules are dealt by key range and sorted together; a sweep per
range keeps the stack of rule hosts that enclose the current key, innermost
last.  A url takes the innermost host that has a rule whose path starts the
url's path, and there the longest such path.

A range begins in the middle of intervals, so every range also gets the rules
that enclose its first key: these are equi-joined on the prefixes of the split
keys.  Split keys carry a row salt, so a hot host is dealt over many ranges.

Defined cases: a url that is null or has no ``://`` has empty host and path and
takes the default verdict; a rule with an empty host fits every host; of equal
rules with different verdicts ``block`` wins; repeated rows are judged one by
one; an empty rule table leaves the default; extra columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtq.llm.queries import register, table

#: Sampled keys per range from which the split keys are taken.
SAMPLE_PER_RANGE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ROW = "part int, place string, kind int, key string, path string, host string, verdict string, id {id}"


def url_host(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), url), "://", 1)).otherwise(F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(after) + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    after = F.concat(F.lit("x"), F.substring_index(url, "://", 1))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(after) + 3)).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by a dot; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _split_points(places: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` split keys from a sample of bounded size."""
    want = SAMPLE_PER_RANGE * ranges
    n = places.count()
    if ranges <= 1 or not n:
        return []
    got = sorted(r[0] for r in places.sample(min(1.0, want / n), seed=7).limit(4 * want).collect())
    return sorted({got[i * len(got) // ranges] for i in range(1, ranges)}) if got else []


def _enclosing(key: str) -> set[str]:
    """The keys whose intervals hold this one: its prefixes at label ends."""
    return {"", *(key[: i + 1] for i, c in enumerate(key) if c == ".")}


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by range, place and kind (rules before urls)."""
    part, stack = None, []  # entries: key, host, {path: verdict}, path lengths descending
    for b in batches:
        out = []
        for p, kind, key, path, host, verdict, i in zip(b["part"], b["kind"], b["key"], b["path"], b["host"],
                                                        b["verdict"], b["id"], strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}, []))
                paths, lengths = stack[-1][2:]
                if paths.get(path) != "block":
                    paths[path] = verdict
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            found = next(((h + path[:n], paths[path[:n]]) for _, h, paths, lengths in reversed(stack)
                          for n in lengths if len(path) >= n and path[:n] in paths), (None, None))
            out.append((i, host, path, *found))
        if out:
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"]).astype(object)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row per url row: its id, host, path, the rule that decided (null: none) and the verdict.

    ``rules``: host, path, verdict."""
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.coalesce(F.col(url_col), F.lit(""))
    id_type = dict(urls.dtypes)[id_col]
    rows = urls.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    end = F.lit("\0")
    rows = rows.withColumn("place", F.concat("key", end, F.hex(F.xxhash64("id", "path"))))
    splits = _split_points(rows.select("place"), ranges)

    @F.pandas_udf("int")
    def part_of(place: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(splits, x) for x in place], dtype="int32")

    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
                         F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.withColumn("key", host_key(F.col("host"))).withColumn("place", F.concat("key", end))
    heads = spark.createDataFrame([(i + 1, k) for i, s in enumerate(splits) for k in _enclosing(s.split("\0", 1)[0])],
                                  "part int, key string")
    both = rules.withColumn("part", part_of("place")).unionByName(
        rules.join(heads, "key").select("host", "path", "verdict", "key", "place", "part")).distinct()
    none = F.lit(None)
    both = both.select("part", "place", F.lit(0).alias("kind"), "key", "path", "host", "verdict", none.cast(id_type).alias("id"))
    rows = rows.select(part_of("place").alias("part"), "place", F.lit(1).alias("kind"), "key", "path", "host",
                       none.cast("string").alias("verdict"), "id")
    dealt = rows.unionByName(both).repartition(ranges, "part").sortWithinPartitions("part", "place", "kind")
    out = dealt.mapInPandas(_sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r AS (SELECT *, CASE
             WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
             WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@register("op2_url_filters", ORACLE)
def op2_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
