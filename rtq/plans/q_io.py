"""Driver queries for sources, sinks, back translation and the incremental stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rtq.operators import scoring as S
from rtq.operators import translate as TR
from rtq.plans.registry import register
from rtq.sources import fixtures as FX
from rtq.sources import io as IO
from rtq.sources.fixtures import _h, duck_with


@register("SRC1_read_segments", duck_with(None, """SELECT CAST(pair_id AS VARCHAR) AS id, lp, src, trg AS mt, trg
FROM seg_conv""", ["seg_conv"]))
def q_src1(spark, sf):
    path = IO.scratch_path(spark, "segments-csv")
    IO.write_features(IO.with_segment_columns(FX.seg_conv(spark, sf)), path, fmt="csv")
    return IO.read_segments(spark, path).select("id", "lp", "src", "mt", "trg")


@register("SRC2_read_scored", duck_with(None, "SELECT * FROM scored", ["scored"]))
def q_src2(spark, sf):
    path = IO.scratch_path(spark, "scored-csv")
    IO.write_features(FX.scored(spark, sf), path, fmt="csv")
    return IO.read_scored(spark, path, "id BIGINT, system STRING, lp STRING, score DOUBLE, pred DOUBLE")


@register("SNK1_write_features", duck_with(None, "SELECT * FROM scored", ["scored"]))
def q_snk1(spark, sf):
    path = IO.scratch_path(spark, "features")
    IO.write_features(FX.scored(spark, sf), path)
    return spark.read.parquet(path)


@register("SNK2_write_batches", duck_with(None, """SELECT pair_id, lp,
  CAST(floor((row_number() OVER (ORDER BY pair_id) - 1) / 100) AS INTEGER) AS batch_no FROM seg_conv""", ["seg_conv"]))
def q_snk2(spark, sf):
    path = IO.scratch_path(spark, "batches")
    b = S.assign_batches(FX.seg_conv(spark, sf).select("pair_id", "lp"), 100, "pair_id")
    IO.write_batches(b, path)
    IO.write_batches(b.filter("batch_no = 0"), path)  # re-running a batch replaces only its partitions
    return spark.read.parquet(path).select("pair_id", "lp", F.col("batch_no").cast("int"))


@register("SNK3_materialize_lexicon", duck_with(None, "SELECT lemma, ord, id, pos FROM word_synsets", ["word_synsets"]))
def q_snk3(spark, sf):
    path = IO.scratch_path(spark, "lexicon")
    return IO.materialize_lexicon(FX.word_synsets(spark, sf), path, "lemma").select("lemma", "ord", "id", "pos")


@register("SNK3b_bucketed_lookup", duck_with(None, """SELECT v.tok AS word, w.ord, w.id, e.target, e.relation_group
FROM vocab v JOIN word_synsets w ON w.lemma = v.tok JOIN synset_edges e ON e.synset_id = w.id""",
                                             ["vocab", "word_synsets", "synset_edges"]))
def q_snk3b(spark, sf):
    """JN1 then JN4 over a bucketed lexicon: only the looked-up keys are shuffled."""
    from rtq.operators import lexicon as L
    words = FX.vocab(spark, sf).withColumnRenamed("tok", "word")
    synsets = IO.materialize_lexicon(FX.word_synsets(spark, sf), IO.scratch_path(spark, "synsets"), "lemma")
    edges = IO.materialize_lexicon(FX.synset_edges(spark, sf), IO.scratch_path(spark, "edges"), "synset_id")
    found = L.word_synset_join(words, synsets).select("word", "ord", "id", F.col("id").alias("synset_id"))
    return L.synset_edge_join(found, edges).select("word", "ord", "id", "target", "relation_group")


def _store(spark, sf):
    """Finished translations for half of the texts (the rest is the remainder)."""
    seg = FX.seg_conv(spark, sf)
    texts = seg.select(F.substring("lp", 1, 2).alias("src_lang"), F.expr("right(lp, 2)").alias("trg_lang"),
                       F.col("trg").alias("text")).distinct()
    half = texts.filter(FX.H("text") % 2 == 0)
    return TR.lexicon_translate(half, FX.lemmas(spark, sf))


_LEX_SQL = """SELECT src_lang, trg_lang, text, string_agg(coalesce(l.lemma, w), ' ' ORDER BY pos) AS translation FROM (
  SELECT src_lang, trg_lang, text, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos
  FROM {src}) x LEFT JOIN (SELECT form, min(lemma) AS lemma FROM lemmas GROUP BY form) l ON l.form = x.w
  GROUP BY src_lang, trg_lang, text"""
_TEXTS = ("texts", "SELECT DISTINCT substr(lp, 1, 2) AS src_lang, right(lp, 2) AS trg_lang, trg AS text FROM seg_conv")
_HALF = ("half", f"SELECT * FROM texts WHERE {_h('text')} % 2 = 0")
_STORE = ("store", _LEX_SQL.format(src="half"))


@register("JN13_attach_back_translation", duck_with([_TEXTS, _HALF, _STORE], """SELECT s.pair_id, t.translation AS trg
FROM seg_conv s LEFT JOIN store t ON t.src_lang = substr(s.lp, 1, 2) AND t.trg_lang = right(s.lp, 2) AND t.text = s.trg""",
                                                   ["seg_conv", "lemmas"]))
def q_jn13(spark, sf):
    seg = IO.with_segment_columns(FX.seg_conv(spark, sf)).withColumn("pair_id", F.col("id").cast("bigint"))
    joined, _ = TR.attach_back_translation(seg, _store(spark, sf), "mt")
    return joined.select("pair_id", "trg")


@register("INF1_batch_translate", duck_with([_TEXTS, _HALF, ("todo", "SELECT * FROM texts EXCEPT SELECT * FROM half")],
                                            _LEX_SQL.format(src="todo"), ["seg_conv", "lemmas"]))
def q_inf1(spark, sf):
    seg = IO.with_segment_columns(FX.seg_conv(spark, sf))
    _, todo = TR.attach_back_translation(seg, _store(spark, sf), "mt")
    return TR.lexicon_translate(todo, FX.lemmas(spark, sf))


def _lower_model(from_lang, to_lang):
    """Stand-in for a translation model (a real one is loaded here, once per task)."""
    return lambda texts: [t.lower() for t in texts]


@register("INF1b_batch_translate_model", duck_with([_TEXTS, _HALF], """SELECT src_lang, trg_lang, text, lower(text) AS translation
FROM (SELECT * FROM texts EXCEPT SELECT * FROM half) x""", ["seg_conv"]))
def q_inf1b(spark, sf):
    seg = IO.with_segment_columns(FX.seg_conv(spark, sf))
    _, todo = TR.attach_back_translation(seg, _store(spark, sf), "mt")
    return TR.batch_translate(todo, _lower_model)


def _str1_oracle():
    from rtq.plans import q_features  # noqa: F401  (registers AGG9 first)
    from rtq.plans.registry import ORACLES
    return ORACLES["AGG9_segment_features"]


@register("STR1_incremental_features", _str1_oracle())
def q_str1(spark, sf):
    """Files arrive in three runs: half of the segments, a third of them with the
    sides exchanged; the other half beside repeated ones; the corrected ones.  The
    current features equal the batch feature table."""
    from rtq.plans.q_features import same_position_features
    from rtq.streaming.incremental import current_features, incremental_features
    inp, out, ck = (IO.scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ck"))
    seg = FX.seg_conv(spark, sf)
    schema = "pair_id BIGINT, lp STRING, src STRING, trg STRING"
    feats = lambda b: same_position_features(spark, sf, b).select("pair_id", "EXTRA", "MISS", "STOPWORD", "INFL", "DERI", "SENSE")
    wrong = seg.filter("pair_id % 6 = 0").select("pair_id", "lp", F.col("trg").alias("src"), F.col("src").alias("trg"))
    runs = [seg.filter("pair_id % 2 = 0 AND pair_id % 6 <> 0").unionByName(wrong),
            seg.filter("pair_id % 2 = 1 OR pair_id % 6 = 2"),
            seg.filter("pair_id % 6 = 0")]
    for n, rows in enumerate(runs):
        rows.write.parquet(f"{inp}/part={n}")
        incremental_features(spark, inp, schema, out, ck, feats)
    return current_features(spark, out)
