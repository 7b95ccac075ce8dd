"""Queries over vector algebra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators.dictionaries import Dictionary, apply_dictionary
from ..operators.linear import apply_linear
from ..operators.windows import peak_normalised, standardised
from ..sources.tables import long_scores, scores, vectors
from .base import registrar, sql, tidy

ENTRIES: dict = {}
register = registrar(ENTRIES)


def _long(df, vec):
    return tidy(long_scores(df.select("row_id", F.col(vec).alias("v")), "v"))


#: A small fixed map: component c reads dimensions c and c + 8, halved and doubled.
MAP = np.zeros((8, 64))
for _c in range(8):
    MAP[_c, _c], MAP[_c, _c + 8] = 0.5, 2.0
_MAPPED = "SELECT row_id, component, 0.5 * score + 2.0 * o AS score FROM (SELECT s.*, lead(score, 8) OVER (PARTITION BY row_id ORDER BY component) AS o FROM s) WHERE component < 8"


@register("p01_affine_transform", sql(_MAPPED, "row_id component", "score"))
def _(spark, d):
    """A matrix product over wide rows."""
    return _long(apply_linear(vectors(spark, d), MAP), "scores")


@register("p02_narrow_affine", sql(_MAPPED, "row_id component", "score"))
def _(spark, d):
    """The same map as array expressions, inside generated code."""
    return _long(vectors(spark, d).withColumn("v", V.affine(F.col("vec"), MAP.tolist())), "v")


@register("p03_inverse_transform", sql("SELECT row_id, component, CASE WHEN component < 8 THEN score ELSE 0.0 END AS score FROM s", "row_id component", "score"))
def _(spark, d):
    """Decoding the first eight coordinates."""
    keep = np.eye(64)[:8]
    coded = apply_linear(vectors(spark, d), keep)
    return _long(apply_linear(coded, keep.T, vec="scores", out="restored"), "restored")


@register("p04_l2_normalize", sql("SELECT row_id, component, 3 * score / greatest(sqrt(sum(9 * score * score) OVER (PARTITION BY row_id)), 1e-12) AS score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.l2_normalize(V.scale(F.col("vec"), 3.0))), "v")


@register("p05_subtract_center", sql("SELECT row_id, component, score - 0.01 * component AS score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.subtract(F.col("vec"), V.literal([0.01 * k for k in range(64)]))), "v")


@register("p07_energy", sql("SELECT row_id, component, score * score / sum(score * score) OVER (PARTITION BY row_id) AS energy FROM s", "row_id component", "energy"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.energy(F.col("vec"))), "v").withColumnRenamed("score", "energy")


_TOP = "SELECT row_id, component, CASE WHEN rn {} 5 THEN score ELSE 0.0 END AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(score) DESC, component) AS rn FROM s)"


@register("p08_keep_topk", sql(_TOP.format("<="), "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.keep_topk(F.col("vec"), 5)), "v")


@register("p09_ablate_topk", sql(_TOP.format(">"), "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.ablate_topk(F.col("vec"), 5)), "v")


@register("p10_restore_norm", sql("SELECT row_id, component, k / greatest(sqrt(sum(k * k) OVER w), 1e-12) * sqrt(sum(score * score) OVER w) AS score FROM (SELECT *, CASE WHEN component < 16 THEN score ELSE 0.0 END AS k FROM s) WINDOW w AS (PARTITION BY row_id)", "row_id component", "score"))
def _(spark, d):
    half = F.transform("vec", lambda x, i: F.when(i < 16, x).otherwise(0.0))
    return _long(vectors(spark, d).withColumn("v", V.restore_norm(half, F.col("vec"))), "v")


@register("p11_clamp_components", sql("SELECT row_id, component, CASE component WHEN 3 THEN 0.5 WHEN 7 THEN -0.25 ELSE score END AS score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.clamp(F.col("vec"), {3: 0.5, 7: -0.25})), "v")


@register("p12_additive_steering", sql("SELECT row_id, component, score + CASE component WHEN 2 THEN 0.75 WHEN 5 THEN -0.5 ELSE 0.0 END AS score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.steer(F.col("vec"), np.eye(64).tolist(), {2: 0.75, 5: -0.5})), "v")


@register("p13_capped_steering", sql("SELECT row_id, component, score + CASE WHEN o > 0 THEN greatest(0.0, least(o, cap - score)) WHEN o < 0 THEN least(0.0, greatest(o, cap - score)) ELSE 0.0 END AS score FROM (SELECT *, CASE component % 3 WHEN 0 THEN 0.2 WHEN 1 THEN -0.2 ELSE 0.0 END AS o, 0.05 AS cap FROM s)", "row_id component", "score"))
def _(spark, d):
    s = scores(spark, d)
    o = F.when(F.col("component") % 3 == 0, 0.2).when(F.col("component") % 3 == 1, -0.2).otherwise(0.0)
    return tidy(s.select("row_id", "component", (F.col("score") + V.capped_offset(F.col("score"), o, 0.05)).alias("score")))


@register("p15_initial_step_override", sql("SELECT row_id, component, score + CASE WHEN row_id = 0 THEN 1.0 ELSE 0.25 END AS score FROM s", "row_id component", "score"))
def _(spark, d):
    s = scores(spark, d)
    return tidy(s.select("row_id", "component", (F.col("score") + F.when(F.col("row_id") == 0, 1.0).otherwise(0.25)).alias("score")))


@register("p16_relu_encode", sql("SELECT row_id, component, greatest(score - 0.01, 0.0) AS score FROM s", "row_id component", "score"))
def _(spark, d):
    """A rectified dictionary."""
    return _long(apply_dictionary(vectors(spark, d), Dictionary(np.eye(64), np.eye(64), -0.01, kind="relu")), "codes")


@register("p16_threshold_encode", sql("SELECT row_id, component, CASE WHEN score > 0.05 THEN score ELSE 0.0 END AS score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(apply_dictionary(vectors(spark, d), Dictionary(np.eye(64), np.eye(64), kind="threshold", threshold=0.05)), "codes")


@register("p16_topk_encode", sql("SELECT row_id, component, CASE WHEN score > 0 AND row_number() OVER (PARTITION BY row_id ORDER BY greatest(score, 0) DESC, component) <= 6 THEN score ELSE 0.0 END AS score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(apply_dictionary(vectors(spark, d), Dictionary(np.eye(64), np.eye(64), kind="topk", k=6)), "codes")


@register("p17_decode", sql("SELECT row_id, component, 2.0 * greatest(score, 0.0) + 0.125 AS score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(apply_dictionary(vectors(spark, d), Dictionary(np.eye(64), 2 * np.eye(64), 0.0, 0.125, "relu"), decode=True, out="y"), "y")


@register("p18_layer_norm", sql("SELECT row_id, component, (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-5) AS score FROM s WINDOW w AS (PARTITION BY row_id)", "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.layer_norm(F.col("vec"))), "v")


@register("p24_split_sign", sql("SELECT row_id, component, greatest(score, 0.0) AS score FROM s UNION ALL SELECT row_id, component + 64, greatest(-score, 0.0) FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.split_sign(F.col("vec"))), "v")


@register("p24_split_sign_inverse", sql("SELECT row_id, component, score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(vectors(spark, d).withColumn("v", V.join_sign(V.split_sign(F.col("vec")))), "v")


@register("p26_interchange", "SELECT row_id, (i - 1)::BIGINT AS component, round((CASE WHEN i <= 10 THEN y[i] ELSE x[i] END)::DOUBLE, 6) + 0.0 AS score FROM (SELECT a.vec_id AS row_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), range(1, 65) t(i)")
def _(spark, d):
    """Base rows meet source rows by key."""
    v = vectors(spark, d)
    source = v.select((F.col("row_id") - 1).alias("row_id"), F.col("vec").alias("other"))
    mask = [1.0 if k < 10 else 0.0 for k in range(64)]
    return _long(v.join(source, "row_id").withColumn("v", V.interchange(F.col("vec"), F.col("other"), mask)), "v")


@register("p27_budgeted_mask", sql("SELECT component, logit, (logit > 0 AND row_number() OVER (ORDER BY logit DESC, component) <= 12)::BIGINT AS mask FROM (SELECT component, round(avg(score), 9) AS logit FROM s GROUP BY component)", "component mask", "logit"))
def _(spark, d):
    from pyspark.sql import Window

    m = scores(spark, d).groupBy("component").agg(F.round(F.avg("score"), 9).alias("logit"))
    rn = F.row_number().over(Window.orderBy(F.desc("logit"), "component"))
    return tidy(m.select("component", "logit", ((F.col("logit") > 0) & (rn <= 12)).cast("long").alias("mask")))


@register("p28_error_preserving_ablation", sql("SELECT row_id, component, score - CASE WHEN score > 0 AND row_number() OVER (PARTITION BY row_id ORDER BY greatest(score, 0) DESC, component) <= 4 THEN score ELSE 0.0 END AS score FROM s", "row_id component", "score"))
def _(spark, d):
    return _long(apply_dictionary(vectors(spark, d), Dictionary(np.eye(64), np.eye(64), kind="relu"), ablate=4, out="y"), "y")


@register("p29_neuron_edits", sql("SELECT row_id, component, score AS v, 0.0 AS constant, CASE WHEN score < 0.05 THEN 0.0 ELSE score END AS thresholded, -score AS inverted FROM s", "row_id component", "v constant thresholded inverted"))
def _(spark, d):
    v = F.col("score")
    return tidy(scores(spark, d).select("row_id", "component", v.alias("v"), F.lit(0.0).alias("constant"), F.when(v < 0.05, 0.0).otherwise(v).alias("thresholded"), (-v).alias("inverted")))


@register("p30_validation", "SELECT count(*)::BIGINT AS rows, 0::BIGINT AS not_finite, 0::BIGINT AS other_width FROM embeddings")
def _(spark, d):
    v = vectors(spark, d)
    return v.agg(F.count("*").alias("rows"), F.count_if(~V.all_finite(F.col("vec"))).alias("not_finite"), F.count_if(F.size("vec") != 64).alias("other_width"))


@register("p34_activation_labels", sql("SELECT row_id, component, CASE WHEN top > 0 THEN least(10, floor(10 * greatest(score, 0) / top)) ELSE 0 END::BIGINT AS label FROM (SELECT *, max(score) OVER (PARTITION BY component) AS top FROM s)", "row_id component label"))
def _(spark, d):
    from pyspark.sql import Window

    s = scores(spark, d).withColumn("top", F.max("score").over(Window.partitionBy("component")))
    return s.select("row_id", "component", S.activation_labels(F.col("score"), F.col("top")).alias("label"))


@register("p35_peak_normalised", sql("SELECT row_id, component, min(CASE WHEN abs(score) = top THEN row_id END) OVER (PARTITION BY component) AS peak, abs(score) / top AS share FROM (SELECT *, max(abs(score)) OVER (PARTITION BY component) AS top FROM s)", "row_id component peak", "share"))
def _(spark, d):
    return tidy(peak_normalised(scores(spark, d), "component", "row_id", "score").select("row_id", "component", "peak", "share"))


@register("p36_standardised", sql("SELECT row_id, component, (score - avg(score) OVER w) / stddev_samp(score) OVER w AS z FROM s WINDOW w AS (PARTITION BY component)", "row_id component", "z"))
def _(spark, d):
    return tidy(standardised(scores(spark, d), ["component"], "score").select("row_id", "component", "z"))


@register("p37_score_decomposition", sql("SELECT row_id, sum(score * (component + 1) / 64.0) AS score, sum(CASE WHEN component < 5 THEN score * (component + 1) / 64.0 ELSE 0 END) AS explained, sum(CASE WHEN component >= 5 THEN score * (component + 1) / 64.0 ELSE 0 END) AS remainder FROM s GROUP BY row_id", "row_id", "score explained remainder"))
def _(spark, d):
    t = F.col("score") * (F.col("component") + 1) / 64.0
    return tidy(scores(spark, d).groupBy("row_id").agg(F.sum(t).alias("total"), F.sum(F.when(F.col("component") < 5, t).otherwise(0.0)).alias("explained"), F.sum(F.when(F.col("component") >= 5, t).otherwise(0.0)).alias("remainder")).withColumnRenamed("total", "score"))


@register("f_scalar_functions", "SELECT doc_id, round(sqrt(n_chars), 6) AS root, md5(replace(text, chr(10), '↵')) AS visible, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS html, sha256(text) AS sha, ('0x' || left(sha256('7:' || doc_id), 15))::BIGINT AS seed FROM documents")
def _(spark, d):
    """Section 2.8: strings (of whole texts, as digests), hashes, derived seeds."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t = F.col("text")
    return docs.select("doc_id", F.round(F.sqrt("n_chars"), 6).alias("root"), F.md5(S.visible_newlines(t)).alias("visible"), F.md5(S.slug(t)).alias("slug"), F.md5(S.html_escape(t)).alias("html"), F.sha2(t, 256).alias("sha"), S.derived_seed(F.lit("7"), F.col("doc_id").cast("string")).alias("seed"))
