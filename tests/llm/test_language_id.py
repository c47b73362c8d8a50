"""Operator 7 against a plain parser, and what a worker holds."""

import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rtq.llm import language_id
from rtq.llm.language_id import BLOCK, Parser, automata, learn, training_sample

from conftest import SF001


def folded(text):
    """Letters lower-cased, everything else one blank a run."""
    out = []
    for c in text or "":
        c = c.lower() if c.isalpha() else " "
        if c != " " or not out or out[-1] != " ":
            out.append(c)
    return out


def plain(texts, sample):
    """Greedy longest phrases by substring search, block by block."""
    known, out = {k: "".join(folded(v)) for k, v in sample.items()}, []
    for text in texts:
        codes = folded(text)
        bits = {}
        for lang in sorted(known):
            n = 0
            for a in range(0, len(codes), BLOCK):
                block, i = codes[a: a + BLOCK], 0
                while i < len(block):
                    j = i + 1
                    while j < len(block) and "".join(block[i: j + 1]) in known[lang]:
                        j += 1
                    i, n = j, n + 1
            bits[lang] = n * np.log2(max(2, len(known[lang]))) / max(1, len(codes))
        best = min(bits, key=lambda k: (bits[k], k)) if bits else None
        out.append((best, bits[best]) if best and any(c != " " for c in codes) else ("und", 0.0))
    return out


def test_whole_table_against_a_plain_parser(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    sample = training_sample(docs, rows=4, chars=400)
    rows = language_id.identify(docs, sample).select("text", "lang_pred", "bits").collect()
    want = plain([r.text for r in rows], sample)
    assert [r.lang_pred for r in rows] == [w[0] for w in want]
    assert np.allclose([r.bits for r in rows], [w[1] for w in want])


def test_ties_go_to_the_first_language():
    assert Parser({"b": "same", "a": "same", "c": "other"}).predict(["same same"])[0][:2] == ("a", 0.0)


def test_long_texts_come_in_slices(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcde .,é", k=n)) for n in (0, 1, 255, 256, 257, 1000, 5000)]
    parser = Parser({"x": "abcabdeaecd ebda", "y": "ccdé eéa"})
    whole = parser.predict_all(texts)
    monkeypatch.setattr(language_id, "SLICE_CHARS", 700)
    assert parser.predict_all(texts) == whole


def test_search_by_key_equals_the_table(monkeypatch):
    sample, texts = {"x": "abcabdeaecd ebda", "y": "ccdé eéa"}, ["abc dec", "éa ccd zz", "q"]
    want = Parser(sample).predict(texts)
    monkeypatch.setattr(language_id, "DENSE_CELLS", 0)
    parser = Parser(sample)
    assert parser.table is None and parser.predict(texts) == want


def test_automata_are_small_to_send(spark):
    """About the size of the edges, whatever the alphabet; a worker adds the table alone."""
    sample = training_sample(spark.read.parquet(f"{SF001}/documents.parquet"))
    model = automata(sample)
    letters = sum(map(len, sample.values()))
    assert len(pickle.dumps(model)) < 30 * letters + model.code.nbytes
    parser = Parser(model)
    held = sum(x.nbytes for x in (parser.table, model.code, model.keys, model.targets))
    assert held < 4 * model.states * model.size + 30 * letters + model.code.nbytes


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i % 37} the of{i % 11} and" for i in range(60))


def test_short_texts_and_unlabelled_tables_stay(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    short = spark.createDataFrame([(1, "a", None, "s", 1), (2, "你好世界", None, "s", 4), (3, "A.", None, "s", 2), (4, "12 !", None, "s", 4),
                                   (5, None, None, None, None), (6, "鵺" * 5000, None, "s", 5000)], SCHEMA)
    kept = language_id.accepted(short, learn(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == short.columns
    assert language_id.accepted(short, learn(short)).count() == 6  # nothing learned, nothing rejected
    labelled = language_id.accepted(docs, learn(docs))
    assert labelled.where("lang is not null and length(text) > 0").count() >= 0.99 * docs.where("lang is not null and text rlike '\\\\p{L}'").count()


def test_clashing_names(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumns({c: F.lit("clash") for c in ("_own", "_p", "codes", "bits")})
    out = language_id.identify(docs, training_sample(docs, rows=2))
    row = out.first()
    assert row._own == row._p == row.codes == "clash" and row.bits != "clash"


@pytest.mark.parametrize("table", ["odd", "unlabelled", "empty"])
def test_pipeline_on_odd_tables(spark, table):
    """Nulls, empty, repeated and very long texts, extra columns; no label; no row."""
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 3), (3, PROSE, "en", "a", 1), (3, PROSE, "en", "a", 1),
            (4, PROSE.replace("word", "wurd"), None, None, 1), (5, "x" * 20000 + " " + "lorem ipsum " * 9000, "fr", "b", 1), (None, "null id text", "de", "b", 1)]
    rows = [] if table == "empty" else [(*r[:2], None, *r[3:]) if table == "unlabelled" else r for r in rows]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("_own", "_n", "row", "size")})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SF001)
        assert docs.columns[: len(columns)] == columns, name
        assert table == "empty" or name == "mixing" or docs.count() <= before
    got = {r.doc_id for r in docs.collect()}
    assert (3 in got and {r._own for r in docs.collect()} == {"clash"}) if rows else not got


def test_every_labelled_row_counts(spark):
    """A word that only late parts of many later rows hold is learned; costs come from all rows."""
    rows = [(i, "alpha beta gamma " * 120 + ("zulu yankee xray " * 30 if i >= 300 else ""), "aa", "s", 1) for i in range(400)]
    rows += [(1000 + i, "uno dos tres quatro " * 60, "bb", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    learned = learn(docs)
    assert {"alpha", "zulu", "yankee", "xray"} <= set(learned.sample["aa"].split())
    counted = {(r.lang, r.word): r.n0 + r.n1 for r in language_id.word_counts(language_id.labelled(docs)).collect()}
    kept = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert counted["aa", "zulu"] == 30 * sum(300 <= i < 400 for i in kept) and counted["bb", "uno"] == 60 * sum(i >= 1000 for i in kept)
    assert language_id.accepted(docs, learned).count() == len(rows)
    junk = spark.createDataFrame([(1, "qxz jvk wpf " * 200, None, "s", 1)], SCHEMA)
    assert language_id.accepted(junk, learned).count() == 0


def test_a_worker_lays_out_one_language_at_a_time():
    sample = {k: "".join(random.Random(k).choices("abcdefg ", k=2000)) for k in ("x", "y", "z", "zz")}
    parser, texts = Parser(sample), [sample["y"][100:900], sample["x"][:500], "gfedcba"]
    assert parser.table.nbytes < 4 * parser.model.states * parser.model.size / 3
    assert [r[0] for r in parser.predict(texts)][:2] == ["y", "x"] and parser.predict(texts) == parser.predict(texts)
    assert [r[2] for r in parser.predict(texts)] == [w[1] for w in plain(texts, sample)]


def test_frequent_words_by_parts(spark):
    rows = [(lang, f"w{'abcdefgh'[i % 8]}{'xyz'[i // 8 % 3]}{'klmno'[i // 24]}", 7 * i % 31, 0) for lang in ("p", "q") for i in range(120)]
    counts = spark.createDataFrame(rows, "lang string, word string, n0 long, n1 long")
    got = language_id.frequent_words(counts, F.col("n0") + F.col("n1"), 100)
    best = [w for _, w in sorted((-n, w) for lang, w, n, _ in rows if lang == "p" and n)][:20]
    assert got == {"p": " ".join(best), "q": " ".join(best)}


def test_a_filter_on_the_result_does_not_predict_twice(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out, name = language_id._predicted(docs, {"a": "some words", "b": "other words"}, "text")
    p = F.col(name)
    cost = out.select("lang", p["bits"].alias("bits"), p["codes"].alias("codes")).where("codes >= 2").groupBy("lang").agg(F.max("bits"))
    assert cost._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
