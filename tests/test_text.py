"""Golden strings for the text functions (FIXTURES.md part C)."""

import pytest
from pyspark.sql import functions as F

from rtq.functions import text as T

CASES = [
    ("I can't", "i ca not"),
    ("It's Ann's", "it is ann is"),
    ("they'd we'll I've I'm you're", "they would we will i have i am you are"),
    ("a_b--c!", "a_b c "),
]


@pytest.mark.parametrize("raw,expected", CASES)
def test_normalize_en(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(T.normalize_en("x")).first()[0] == expected


def test_normalize_zh_and_dispatch(spark):
    df = spark.createDataFrame([("你好, world 世界!", "zh"), ("Hello, World", "en")], "x string, lang string")
    out = [r[0] for r in df.select(T.normalize_text("x", "lang")).collect()]
    assert out == ["你好世界", "hello world"]


def test_capitalize_first_not_initcap(spark):
    df = spark.createDataFrame([("hello world",), ("ßa",), ("",)], "x string")
    assert [r[0] for r in df.select(T.capitalize_first("x")).collect()] == ["Hello world", "SSa", ""]


def test_char_length_or_1(spark):
    df = spark.createDataFrame([("",), ("abc",), (None,)], "x string")
    assert [r[0] for r in df.select(T.char_length_or_1("x")).collect()] == [1, 3, 1]


def test_tokenize_and_words(spark):
    df = spark.createDataFrame([(1, "ab extraordinary  c")], "pair_id long, text string")
    toks = T.tokenize(df, "text", split_long=6).orderBy("pos").collect()
    assert [t.piece for t in toks] == ["▁ab", "▁extr", "aordinary", "▁c", "▁<EOS>"]
    words = T.combine_word_text(T.tokenize(df, "text", split_long=6), ["pair_id"]).orderBy("word_no").collect()
    assert [w.word for w in words] == ["ab", "extraordinary", "c", "<EOS>"]
