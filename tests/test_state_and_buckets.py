"""STR1's state by key, SNK3's buckets, AGG6 over vector columns."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from rtq.functions import vectors as V
from rtq.operators import lexicon as L
from rtq.session import scratch_path
from rtq.sources import io as IO
from rtq.streaming.incremental import current_features, incremental_features, latest_versions, unknown_versions

SCHEMA = "pair_id BIGINT, fingerprint STRING, src STRING"


def test_incremental_state(spark):
    inp, out, ck = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    computed = []

    def features(batch):
        computed.append(sorted((r.pair_id is None, r.pair_id, r.src) for r in batch.collect()))
        return batch.filter("src IS NOT NULL").select("pair_id", F.length("src").alias("n"))

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{inp}/run={uuid.uuid4().hex}")
        incremental_features(spark, inp, SCHEMA, out, ck, features)
        return {r.pair_id: r.n for r in current_features(spark, out).collect()}

    # One input column has the name of a state column; the folder name is no part of a version.
    assert run([(1, "x", "a"), (2, "x", "bb"), (2, "x", "bb"), (None, "x", "c")]) == {1: 1, 2: 2, None: 1}
    assert run([(1, "x", "a"), (3, "x", "ddd"), (None, "x", "c")]) == {1: 1, 2: 2, 3: 3, None: 1}
    assert run([(1, "x", "aaaa"), (2, "x", None)]) == {1: 4, 2: None, 3: 3, None: 1}
    assert run([(1, "x", "a")]) == {1: 1, 2: None, 3: 3, None: 1}  # back to the first version
    assert [[r[1:] for r in c] for c in computed] == [
        [(1, "a"), (2, "bb"), (None, "c")], [(3, "ddd")], [(1, "aaaa"), (2, None)], [(1, "a")]]
    assert run([]) == {1: 1, 2: None, 3: 3, None: 1}


def test_newest_version_of_a_batch(spark):
    rows = spark.createDataFrame([((1, "old"), (1, "f9")), ((1, "new"), (2, "f1")), ((2, "a"), (1, "f1")), ((2, "b"), (1, "f2"))],
                                 "_row struct<k: int, v: string>, _arrived struct<time: int, file: string>")
    got = latest_versions(rows, "k")
    assert sorted((r._key, r._row.v) for r in got.collect()) == [(1, "new"), (2, "b")]
    log = got.select(F.col("_key").alias("k"), "fingerprint", F.lit(0).alias("stream_batch"))
    assert unknown_versions(got, log, "k").count() == 0 and unknown_versions(got, None, "k").count() == 2


def test_bucketed_lookup_shuffles_keys_only(spark):
    path = scratch_path(spark, "lexicon")
    rows = [(f"w{i % 50}", 0, i, "n") for i in range(200)] + [(None, 0, 999, "n")]
    table = spark.createDataFrame(rows, "lemma string, ord int, id bigint, pos string")
    written = IO.materialize_lexicon(table, path, "lemma", 4)
    again = IO.attach_lexicon(spark, path, "lemma string, ord int, id bigint, pos string", "lemma", 4)
    words = spark.createDataFrame([(f"w{i}",) for i in range(0, 60, 3)], "word string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for lexicon in (written, again):
            found = L.word_synset_join(words, lexicon)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1, plan
            assert sorted(map(tuple, lexicon.collect()), key=str) == sorted(rows, key=str)
            want = sum(4 if i < 50 else 1 for i in range(0, 60, 3))
            assert found.count() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_word_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(40, 5))
    rows = [(i % 3, i % 4, i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(0, 0, 99, None)]
    df = spark.createDataFrame(rows, "k int, word_no int, pos int, embedding array<double>")
    for agg, f in (("AVG", np.mean), ("MAX", np.max)):
        got = {(r.k, r.word_no): r.vector for r in V.combine_word_vectors(df, ["k"], agg).collect()}
        assert len(got) == 12
        for (k, w), v in got.items():
            mine = vectors[[i for i in range(40) if (i % 3, i % 4) == (k, w)]]
            assert np.allclose(v, f(mine, axis=0), atol=1e-12)


def test_texts_are_not_shuffled_with_their_words(spark):
    import re
    from rtq.operators import translate as TR
    todo = spark.createDataFrame([("de", "en", "a b a c"), ("de", "en", ""), ("fr", "en", "a b a c"), ("de", "en", None)], "src_lang string, trg_lang string, text string")
    words = spark.createDataFrame([("a", "x"), ("a", "w"), ("c", "z")], "form string, lemma string")
    out = TR.lexicon_translate(todo, words)
    assert sorted(map(tuple, out.collect())) == [("de", "en", "", ""), ("de", "en", "a b a c", "w b w z"), ("fr", "en", "a b a c", "w b w z")]
    kept = re.search(r"Generate posexplode\(split\(.*?\)\), \[(.*?)\]", out._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "text" not in kept, kept
