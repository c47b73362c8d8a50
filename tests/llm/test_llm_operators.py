"""The ten operators on small literal tables: defined cases and brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rtq.llm import decontaminate, language_id, licenses, mixing, near_dups, quality, sharding, substrings, url_rules, warc
from rtq.llm.registry import ORACLES, QUERIES
from rtq.session import scratch_path

from conftest import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i % 37} the of{i % 11} and" for i in range(60))
ODD = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 3), (3, PROSE, "en", "a", 1), (3, PROSE, "en", "a", 1),
       (4, PROSE + " tail", None, None, 1), (5, "x" * 20000 + " " + "lorem ipsum " * 9000, "fr", "b", 1), (None, "null id text", "de", "b", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def words(text, gap=r"[\x20\x09-\x0D]+"):
    return [w for w in re.split(gap, text or "") if w]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    from oracle_harness import compare, duck_connect
    info = compare(QUERIES[name](spark, SF001), duck_connect(SF001), ORACLES[name])
    assert info["ok"], info


def test_quality(odd, empty):
    rows = quality.judge(odd.withColumn("kept", F.lit("clash"))).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if not r.text)
    assert [r.n_words for r in rows if r.doc_id in (0, 1, 2)] == [0, 0, 0]
    assert quality.judge(empty).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "v", ""), (4, "v", ""), (5, "w", "big" * 50000)],
                                  "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    got = {(r.id, r.record_type, r.refers_to): r for r in warc.read_archive(spark, path).collect()}
    assert set(got) == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)}
    rec = bytes(got[(2, "response", None)].record)
    head, body = rec.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and body == "<p>é</p>".encode() + b"\r\n\r\n"
    assert bytes(got[(1, "revisit", 2)].payload) == "<p>é</p>".encode() and bytes(got[(1, "revisit", 2)].record).endswith(b"\r\n\r\n\r\n\r\n")
    assert spark.read.parquet(path + "/payloads").count() == 3
    warc.write_archive(pages.limit(0), path + "-none")
    assert warc.read_archive(spark, path + "-none").count() == 0


def test_warc_urls_come_back(spark):
    """Every control character, percent signs that look like one, null and empty."""
    urls = [None, "", "http://a/%0A%09", "http://é/ü?q=日本"] + [f"http://a/{chr(c)}x{chr(c)}é%0A" for c in [*range(32), 127]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("same"))
    path = scratch_path(spark, "warc-urls")
    warc.write_archive(pages, path, date=F.timestamp_seconds(F.lit(0)))
    rows = warc.read_archive(spark, path).collect()
    assert {r.id: r.url for r in rows} == dict(enumerate(urls)) and len(rows) == len(urls)
    for r in rows:
        head = bytes(r.header).decode().split("\r\n")
        assert head[0] == "WARC/1.1" and head[-2:] == ["", ""] and "WARC-Date: 1970-01-01T00:00:00Z" in head
        target = [x[17:] for x in head if x.startswith("WARC-Target-URI: ")]
        want = urls[r.id] and re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", urls[r.id])
        assert target == ([] if want is None else [want])


def test_clashing_names(spark, odd, empty):
    """Extra columns named like the operators' own come back unchanged."""
    names = ["_k", "_id", "_k2", "_n", "_node", "_t", "_w", "_win", "_h", "_H2", "_d", "_f", "_b0", "_p", "_c3", "_part", "_at", "_up", "extra0"]
    docs = odd
    for n in names:
        docs = docs.withColumn(n, F.lit("x" + n))
    items = spark.createDataFrame([(1, "word1 the of1 and word2 the of2 and word3 the of3 and word4")], "item_id long, text string")
    items = items.select(*(F.col("item_id" if c.endswith("id") else "text").alias(c) for c in spark.read.parquet(SF001 + "/benchmark.parquet").columns))
    runs = {"judge": quality.judge, "scan": licenses.scan, "shards": lambda d: sharding.assign_shards(d, limit=4000),
            "dedupe": near_dups.dedupe, "clean": lambda d: decontaminate.clean(d, items)}
    for name, run in runs.items():
        plain, got = run(odd), run(docs)
        for n in names:
            assert got.select(n).distinct().collect() in ([("x" + n,)], []), (name, n)
        assert got.columns == plain.columns[:5] + names + plain.columns[5:], name
        assert got.count() == plain.count(), name


def test_url_rules_against_brute_force(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "", "block"), ("com", "/x", "block"), ("com", "/x/y", "allow")]
    urls = [(i, u) for i, u in enumerate(["http://example.net/en/1", "http://q.example.net/de", "http://a.example.net", "HTTP://B.A.example.NET/en/?q",
            "https://z.com/x/y/z", "https://z.com/xa", "https://net", "nothing", None, "http://notnet/", "ftp://anexample.net/en/", "://com/x#f"] * 3)]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    df = spark.createDataFrame(urls, "page_id long, url string")
    out = url_rules.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=5)
    assert {r.page_id: tuple(r)[1:] for r in out.collect()} == {i: judge(u) for i, u in urls}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.judge_urls(df, none).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)
    assert url_rules.judge_urls(df.limit(0), none).count() == 0


def test_decontamination(spark, odd, empty):
    item = "In the year 1999 a train with Robert travels 300 km from the city in 5 hours and 300 km back at night"
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    other = item.replace("300", "450").replace("Robert", "Alice").replace("1999", "2011")
    broken = item.replace("300 km from", "450 km from")
    rows = odd.unionByName(spark.createDataFrame([(10, "so " + other + " end", None, None, 1), (11, "so " + item + " end", None, None, 1),
                                                  (12, "so " + broken + " end", None, None, 1)], SCHEMA))
    got = {r.doc_id: r for r in decontaminate.find_leaks(rows, items).collect()}
    assert got[10].slots_changed and not got[11].slots_changed and got[11].covered > 0.9
    assert 12 not in got and set(got) == {10, 11}
    left = decontaminate.clean(rows, items)
    assert left.columns == rows.columns and left.count() == rows.count() - 2
    assert decontaminate.clean(empty, items).count() == 0
    assert decontaminate.find_leaks(rows, items.limit(0)).count() == 0


def test_licenses(spark, odd, empty):
    rows = odd.select("doc_id", "text", F.lit("clash").alias("labels")).unionByName(spark.createDataFrame(
        [(20, "x Under the MIT License. Apache License, Version 2! CC BY-NC", ""), (21, "This work is licensed under the GNU General Public License, version 3.", ""),
         (22, "mit license", ""), (23, "Permission is hereby granted, free of charge, to any person obtaining", "")], "doc_id long, text string, labels string"))
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert (got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels) == (3, 1, 9, "apache-2,cc-by-nc,mit")
    assert got[21].labels == "gpl-3" and got[21].n_base == 0 and got[21].first_word is None
    assert got[23].labels == "mit" and got[0].labels == "" and got[0].n_words == 0 and got[3].score == 0
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("hot", [100, 10**9])
def test_substrings_against_brute_force(spark, docs, odd, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_WORDS", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 20000)
    rows = docs.select("doc_id", "text").collect()
    seen, want = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        w = words(r.text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p:p + 20])
            if key in seen:
                gone[p:p + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[r.doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.strip_repeats(docs).collect()}
    assert got == want
    strange = {r.doc_id: r for r in substrings.strip_repeats(odd).collect()}
    assert strange[3].n_removed == 0 and strange[4].n_removed == 240 and strange[0].n_words == 0
    assert strange[0].kept_sha256 == hashlib.sha256(b"").hexdigest() and None in strange


def test_language_id(spark, docs, odd, empty):
    sample = language_id.training_sample(docs)
    out = language_id.identify(docs.drop("n_chars"), sample).where(language_id.fold(F.col("doc_id")) == 2)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    got = language_id.identify(odd.withColumn("score", F.lit("clash")), sample).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert language_id.identify(empty, sample).count() == 0 and language_id.training_sample(empty) == {}
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_suffix_automaton_finds_longest_matches():
    text, sample = "abracadabrazz", "cadabrab"
    p = language_id.Parser({"x": sample})
    (lang, score, bits), = p.predict([text])
    phrases, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i:i + n + 1] in sample:
            n += 1
        i, phrases = i + n, phrases + 1
    assert lang == "x" and score == 1.0 and bits == pytest.approx(phrases * 3.0 / len(text))


def test_sharding(spark, odd, empty):
    same = spark.createDataFrame([(9, "y" * 100, "en", "a", 1)] * 300, SCHEMA)
    out = sharding.assign_shards(odd.unionByName(same).withColumn("shard_id", F.lit("clash")), limit=4000)
    rows = out.collect()
    assert len(rows) == len(ODD) + 300
    size = Counter()
    for r in rows:
        assert r.row_bytes == len((r.text or "").encode())
        size[r.shard_id] += r.row_bytes
    assert all(n <= 4000 for s, n in size.items() if not s.startswith("big-")) and sum(s.startswith("big-") for s in size) == 1
    assert sharding.assign_shards(empty, 4000).count() == 0
    large = spark.createDataFrame([(9, "z" * 5000, "en", "a", 1)] * 3 + [(9, "w" * 5000, "en", "a", 1), (1, "s", "en", "a", 1)], SCHEMA)
    assert len({r.shard_id for r in sharding.assign_shards(large, 4000).collect()}) == 5


def brute_classes(texts):
    def bag(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))

    bags, up = {i: bag(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (texts[a] == texts[b] or 5 * sum((bags[a] & bags[b]).values()) >= 4 * sum((bags[a] | bags[b]).values()) > 0):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, docs, odd, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in near_dups.near_classes(docs).collect()}
    assert got == brute_classes(texts)
    kept = near_dups.dedupe(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "3", "5", "None"]
    assert near_dups.dedupe(empty).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    import random
    rng = random.Random(3)
    base = [f"w{rng.randrange(40)}" for _ in range(150)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        texts[i] = " ".join(w * (1 + (i % 30 == 7)))
    monkeypatch.setattr(near_dups, "SMALL", 2)
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_classes(rows).collect()}
    want = brute_classes(texts)
    assert 1 < len(set(want.values())) < 90 and got == want


def test_bag_minhash_estimates_weighted_jaccard():
    import numpy as np
    rng = np.random.default_rng(1)
    g = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    sig = near_dups.bag_minhash(np.repeat([0, 1], 300), np.concatenate([g, g]), np.concatenate([a, b]), 2, m=4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_mixing(spark, docs, odd, empty):
    out = mixing.mix_rows(docs).collect()
    assert len(out) == docs.count() and all(r.size == len(words(r.text)) and r.taken <= 3 * r.size for r in out)
    total = Counter()
    for r in out:
        total[r.source] += r.taken
    assert all(abs(total[r.source] - r.target) <= 2 for r in out)
    assert sorted(map(tuple, mixing.mix_rows(docs).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in out)
    strange = mixing.mix_rows(odd.withColumn("size", F.lit("clash"))).collect()
    assert len(strange) == len(ODD) and sum(r.taken for r in strange if not (r.text or "").strip()) == 0
    assert mixing.mix_rows(empty).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_apportion_is_highest_quotients():
    targets, seats = [53.0, 24.0, 23.0, 7.5, 0.0], 17
    q = sorted(((v / (2 * k + 1), -i) for i, v in enumerate(targets) for k in range(seats) if v), reverse=True)[:seats]
    assert mixing.apportion(targets, seats).tolist() == [sum(-j == i for _, j in q) for i in range(5)]


def test_pipeline_equals_its_stages(spark, docs):
    out = corpus_pipeline.run(spark, SF001)
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    keep = docs.select("doc_id", F.size(F.split("text", " ")).alias("n"))
    dirty = {r.doc_id for r in decontaminate.find_leaks(docs, bench).select("doc_id").distinct().collect()}
    classes = {r.doc_id: r.class_id for r in near_dups.near_classes(docs).collect()}
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids and not ids & dirty and all(classes[i] == i for i in ids) and keep.count() == docs.count()
    assert out.columns[:5] == docs.columns


def leaks(spark, items, texts):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(list(texts), "doc_id long, text string")
    return rows, items, {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(rows, items).collect()}


def test_decontamination_of_short_items_and_sparse_windows(spark):
    short, sparse = "What is 37 + 48 * 12 - 9?", "Compute 12 + 34 + 56 + 78 + 90 and 11 + 22 + 33 + 44 then add 5, 6, 7, 8."
    texts = [(1, f"so: {short} end"), (2, f"so: {sparse} end"), (3, short.replace("48", "49")), (4, sparse.replace("33", "99").replace("56", "65")), (5, short), (6, "")]
    rows, items, got = leaks(spark, [short, sparse, ""], texts)
    assert set(got) == {(1, 0), (5, 0), (2, 1)} and got[1, 0].n_windows == 1
    assert all(r.covered == 1 and not r.slots_changed for r in got.values())
    assert sorted(r.doc_id for r in decontaminate.clean(rows, items).collect()) == [3, 4, 6]


def test_decontamination_of_null_ids_and_edits_between_hits(spark):
    item = "the old farmer sold 300 eggs at the market in town and later about 300 more were given to the poor people of a small village near by"
    edited = item.replace("later about 300 more", "afterwards roughly 450 extra")
    rows, items, got = leaks(spark, [item], [(None, "so " + item), (1, edited), (2, "something else")])
    assert set(got) == {(None, 0), (1, 0)} and got[None, 0].covered == 1
    assert got[1, 0].covered == pytest.approx(24 / 28) and not got[1, 0].slots_changed
    assert [r.doc_id for r in decontaminate.clean(rows, items).collect()] == [2]
