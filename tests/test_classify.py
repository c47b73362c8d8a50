"""CLS1 golden rules with literal rows (FIXTURES.md part C)."""

from rtq.operators import features as FE
from rtq.operators import lexicon as L


def test_rules(spark):
    rows = [("a", "a", "en"), ("", "dog", "en"), ("x", "dog", "en"), ("dog", "", "en"), ("dog", "x", "en"),
            ("the", "of", "en"), ("x", "y", "en"), ("dogs", "dog", "en"), ("play", "player", "en"),
            ("cat", "dog", "en"), ("你好世", "世界你好", "zh"), ("你好", "世界", "zh")]
    df = spark.createDataFrame([(i, s, t, lang) for i, (s, t, lang) in enumerate(rows)],
                               "k int, s string, t string, src_lang string")
    df = FE.stopword_flags(df, L.load_stopwords(spark))
    lem = spark.createDataFrame([("dogs", "dog")], "form string, lemma string")
    df = L.lemma_join(df, lem, word="s", out="s_lemma")
    df = L.lemma_join(df, lem, word="t", out="t_lemma")
    out = {r.k: (r.cls, r.measure) for r in FE.classify_pair(df).collect()}
    assert [out[i] for i in range(len(rows))] == [
        ("SAME", "zero"), ("EXTRA", "one_over_n"), ("EXTRA", "one_over_n"), ("MISS", "one_over_n"),
        ("MISS", "one_over_n"), ("STOPWORD", "one_over_n"), ("NONE", "zero"), ("INFL", "cos_surface"),
        ("DERI", "cos_surface"), ("SENSE", "path_lemma"), ("SENSE", "cos_surface"), ("SENSE", "path_surface")]


def test_null_text_gives_null_features(spark):
    segs = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "pair_id long, src string, trg string")
    contribs = spark.createDataFrame([], "pair_id long, cls string, contrib double, sense_by_path double")
    out = {r.pair_id: r for r in FE.segment_features(segs, contribs).collect()}
    assert out[1].SENSE is None and out[2].SENSE == 0.0
