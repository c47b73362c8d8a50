"""Lookups by language, and stores that hold a key twice (JN10, JN13)."""

from rtq.operators import lexicon as L
from rtq.operators import translate as TR


def test_lemmas_by_language(spark):
    lem = spark.createDataFrame([("en", "die", "dice"), ("de", "die", "die"), ("en", "gift", "gift"), ("de", "gift", "toxin"),
                                 ("de", "gift", "poison"), (None, "x", "Any")], "lang string, form string, lemma string")
    rows = [("en", "die"), ("de", "die"), ("en", "gift"), ("de", "gift"), ("fr", "gift"), ("de", "x"), (None, "x"), ("en", None)]
    words = spark.createDataFrame(rows, "src_lang string, s string")
    got = {(r.src_lang, r.s): r.lemma for r in L.lemma_join(words, lem, word="s", lang_col="src_lang").collect()}
    assert got == {("en", "die"): "dice", ("de", "die"): "die", ("en", "gift"): "gift", ("de", "gift"): "poison",
                   ("fr", "gift"): "gift", ("de", "x"): "any", (None, "x"): "x", ("en", None): None}


def test_store_with_repeated_text(spark):
    seg = spark.createDataFrame([(1, "en-de", "a"), (2, "en-de", "b")], "id int, lp string, mt string")
    store = spark.createDataFrame([("en", "de", "a", "y"), ("en", "de", "a", "x")],
                                  "src_lang string, trg_lang string, text string, translation string")
    joined, todo = TR.attach_back_translation(seg, store)
    assert {r.id: r.trg for r in joined.collect()} == {1: "x", 2: None} and joined.count() == 2
    assert [r.text for r in todo.collect()] == ["b"]
    whole = TR.complete_back_translation(seg, store, lambda t: t.selectExpr("*", "upper(text) AS translation"))
    assert {r.id: r.trg for r in whole.collect()} == {1: "x", 2: "B"}
