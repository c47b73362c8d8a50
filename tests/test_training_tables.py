"""Training rows of every labelled document, and languages in the lexicon key."""

import __spark_entry__ as E
from conftest import SF001
from oracle_harness import compare, duck_connect
from rtq.operators import lexicon as L
from rtq.plans import q_ml
from rtq.sources import fixtures as FX


def test_labelled_features_match_sql(spark):
    sql = q_ml.LABELLED_SQL
    info = compare(E.queries()["ML0_labelled_features"](spark, SF001), duck_connect(SF001), sql)
    assert info["ok"], info
    assert info["spark_rows"] == FX.table(spark, SF001, "labels").count()


def test_tables_are_apart_and_scaled_alone(spark):
    rows = spark.createDataFrame([(i, "s", float(i % 9) - 1) for i in range(400)], "id long, system string, score double")
    train, test = (t.collect() for t in q_ml.train_and_test(rows))
    assert {r.id for r in train} | {r.id for r in test} == set(range(400)) and not {r.id for r in train} & {r.id for r in test}
    for part in (train, test):
        assert min(r.score for r in part) == 0 and max(r.score for r in part) == 100


def test_a_shared_form_keeps_its_language(spark):
    words = spark.createDataFrame([("gift", "en", "de"), ("gift", "de", "en"), ("gift", None, "en")], "word string, src_lang string, trg_lang string")
    syn = spark.createDataFrame([("gift", "en", "de", 1), ("gift", "de", "en", 2)], "lemma string, src_lang string, trg_lang string, id long")
    senses = spark.createDataFrame([(1, "Geschenk", "DE"), (1, "present", "EN"), (2, "poison", "EN")], "synset_id long, full_lemma string, language string")
    pair = ("src_lang", "trg_lang")
    got = L.word_synset_join(words, syn, langs=pair).collect()
    assert {(r.src_lang, r.id) for r in got} == {("en", 1), ("de", 2), (None, None)}
    got = L.word_sense_join(words, syn, senses, langs=pair, target="trg_lang").collect()
    assert {(r.src_lang, r.full_lemma) for r in got} == {("en", "Geschenk"), ("de", "poison"), (None, None)}


def test_boosting_starts_from_checkpointed_rows(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.sql import functions as F

    from rtq.operators import scoring as S
    rows = spark.range(60).select("id", *((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / 7).alias(f) for i, f in enumerate(S.FEATURES)),
                                  F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(90)).cast("double")).alias("score"))
    va = VectorAssembler(inputCols=S.FEATURES, outputCol="features", handleInvalid="keep")
    ready = S.training_rows(va.transform(rows))
    assert ready.count() == 54 and ready.columns == ["features", "score"]
    # Nothing but the written rows: no scan, exchange or assembling function.
    assert "ExistingRDD" in ready._jdf.queryExecution().sparkPlan().toString().strip().split("\n")[0]
    plain = Pipeline(stages=[va, GBTRegressor(labelCol="score", maxIter=3, maxDepth=7, stepSize=0.1, seed=42)]).fit(
        S.in_few_tasks(rows.filter("score IS NOT NULL")))
    got, want = (sorted((r["id"], r["prediction"]) for r in S.predict(m, rows).collect()) for m in (S.fit_gbt(rows, max_iter=3), plain))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 1e-9


def test_one_task_grows_the_trees_of_spark(spark, monkeypatch):
    """Without a job a tree: trees, predictions and importances of Spark's trainer."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.sql import functions as F

    from rtq.operators import scoring as S
    rows = spark.range(3000).select("id", *((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3 + 400 * i)) / 7).alias(f) for i, f in enumerate(S.FEATURES)),
                                    F.pmod(F.xxhash64("id"), F.lit(90)).cast("double").alias("score"))
    ready = S.training_rows(VectorAssembler(inputCols=S.FEATURES, outputCol="features", handleInvalid="keep").transform(rows))
    want = GBTRegressor(labelCol="score", maxIter=6, maxDepth=7, stepSize=0.1, seed=42).fit(ready)
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, fit=GBTRegressor.fit: fit(self, data) if data.count() < 3 else None)
    m = S.fit_gbt(rows, max_iter=6).stages[-1]
    assert [t.numNodes for t in m.trees] == [t.numNodes for t in want.trees] and list(m.treeWeights) == list(want.treeWeights)
    assert (m.getMaxIter(), m.getMaxDepth(), m.getStepSize()) == (6, 7, 0.1)
    assert max(abs(a - b) for a, b in zip(m.featureImportances.toArray(), want.featureImportances.toArray())) < 1e-9
    both = zip(m.transform(ready).collect(), want.transform(ready).collect(), strict=True)
    assert max(abs(a.prediction - b.prediction) for a, b in both) < 1e-9
