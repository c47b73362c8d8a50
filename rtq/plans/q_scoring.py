"""Driver queries for scoring/evaluation operators (PRJ1-6, AGG10-13, ML, SET1, TOP1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rtq.operators import scoring as S
from rtq.plans.registry import register
from rtq.sources import fixtures as FX
from rtq.sources.fixtures import duck_with

R6 = "round({x}, 6)"


def _prepared(spark, sf):
    """scored -> clamp -> min-max of score and of pred (each on its own range)."""
    s = S.clamp_score(FX.scored(spark, sf))
    return S.minmax_0_100(S.minmax_0_100(s, "score"), "pred")


_PREP_SQL = [("clamped", "SELECT id, system, lp, CASE WHEN score < 0 THEN 0.0 ELSE score END AS score, pred FROM scored"),
             ("prepared", """SELECT id, system, lp,
   CASE WHEN (SELECT max(score) FROM clamped) > (SELECT min(score) FROM clamped)
        THEN (score - (SELECT min(score) FROM clamped)) / ((SELECT max(score) FROM clamped) - (SELECT min(score) FROM clamped)) * 100.0 END AS score,
   CASE WHEN (SELECT max(pred) FROM clamped) > (SELECT min(pred) FROM clamped)
        THEN (pred - (SELECT min(pred) FROM clamped)) / ((SELECT max(pred) FROM clamped) - (SELECT min(pred) FROM clamped)) * 100.0 END AS pred
 FROM clamped""")]


@register("PRJ1_assign_batches", """SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 500) AS INTEGER) AS batch_no
FROM documents""")
def q_prj1(spark, sf):
    """Consecutive batches of 500 documents in doc_id order."""
    d = FX.table(spark, sf, "documents").select("doc_id")
    return S.assign_batches(d, 500, "doc_id")


@register("PRJ2_resume_from", """SELECT doc_id, batch_no FROM (
  SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 500) AS INTEGER) AS batch_no FROM documents) x
WHERE batch_no >= 1""")
def q_prj2(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id")
    return S.resume_from(S.assign_batches(d, 500, "doc_id"), 1)


@register("PRJ3_split_language_pair", duck_with(None, """SELECT pair_id, lp, substr(lp, 1, 2) AS src_lang, right(lp, 2) AS trg_lang
FROM seg_conv""", ["seg_conv"]))
def q_prj3(spark, sf):
    from rtq.functions.text import split_language_pair
    return split_language_pair(FX.seg_conv(spark, sf).select("pair_id", "lp"))


@register("PRJ4_language_pairs", duck_with(None, "SELECT DISTINCT lp FROM scored", ["scored"]))
def q_prj4(spark, sf):
    return S.language_pairs(FX.scored(spark, sf))


@register("PRJ4b_filter_language_pair", duck_with(None, "SELECT id, lp FROM scored WHERE lp = 'en-de'", ["scored"]))
def q_prj4b(spark, sf):
    return S.filter_language_pair(FX.scored(spark, sf), "en-de").select("id", "lp")


@register("PRJ5_clamp_score", duck_with(None, "SELECT id, CASE WHEN score < 0 THEN 0.0 ELSE score END AS score FROM scored",
                                        ["scored"]))
def q_prj5(spark, sf):
    return S.clamp_score(FX.scored(spark, sf)).select("id", "score")


@register("AGG10_minmax_0_100", duck_with(_PREP_SQL, "SELECT id, score, pred FROM prepared", ["scored"]))
def q_agg10(spark, sf):
    return _prepared(spark, sf).select("id", "score", "pred")


@register("AGG11_system_scores", duck_with(_PREP_SQL, """SELECT system, avg(score) / 10 AS score, avg(pred) / 10 AS pred
FROM prepared GROUP BY system""", ["scored"]))
def q_agg11(spark, sf):
    return S.system_scores(_prepared(spark, sf))


@register("AGG12_pearson", duck_with(_PREP_SQL, """SELECT corr(pred, score) AS pearson FROM (
  SELECT system, avg(score) / 10 AS score, avg(pred) / 10 AS pred FROM prepared GROUP BY system) x""", ["scored"]))
def q_agg12(spark, sf):
    return S.pearson(S.system_scores(_prepared(spark, sf)))


@register("AGG13_mse", duck_with(_PREP_SQL, "SELECT avg(pow(score - pred, 2)) AS mse FROM prepared", ["scored"]))
def q_agg13(spark, sf):
    return S.mse(_prepared(spark, sf), "score", "pred")


@register("ML1_train_val_split", duck_with(None, """SELECT id, CAST(('0x' || substr(md5(concat('42:', CAST(id AS VARCHAR))), 1, 8)) AS BIGINT) % 10000 < 2000 AS is_val
FROM scored""", ["scored"]))
def q_ml1(spark, sf):
    train, val = S.train_val_split(FX.scored(spark, sf), "id", 42, 0.2)
    return train.select("id", F.lit(False).alias("is_val")).unionByName(val.select("id", F.lit(True).alias("is_val")))


@register("SET1_union_batches", """SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 500) AS INTEGER) AS batch_no
FROM documents""")
def q_set1(spark, sf):
    d = S.assign_batches(FX.table(spark, sf, "documents").select("doc_id"), 500, "doc_id")
    return S.union_batches([d.filter(F.col("batch_no") == 0), d.filter(F.col("batch_no") >= 1)])


@register("TOP1_preview", duck_with(None, "SELECT id, system, score FROM scored ORDER BY id LIMIT 5", ["scored"]))
def q_top1(spark, sf):
    return S.preview(FX.scored(spark, sf).select("id", "system", "score"), "id", 5)
