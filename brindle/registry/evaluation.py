"""Queries over reconstruction, receptive fields and scoring of explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import dictionaries, erf, joins
from ..sources.tables import scores, table, vectors
from .base import registrar, sql, tidy

ENTRIES: dict = {}
register = registrar(ENTRIES)

_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(score) DESC, component) AS rn FROM s)"


def _curve_sql(ks):
    return "SELECT k, avg(least(k, 64)) AS effective_k, avg(1 - kept / total) AS nmse, avg(kept / sqrt(kept * total)) AS cosine FROM (SELECT k, row_id, sum(CASE WHEN rn <= k THEN score * score ELSE 0 END) AS kept, sum(score * score) AS total FROM r, (SELECT unnest([" + ", ".join(map(str, ks)) + "])::BIGINT AS k) GROUP BY ALL) GROUP BY k"


@register("a16_row_errors", sql("SELECT row_id, sum(pow(score - CASE WHEN rn <= 8 THEN score ELSE 0 END, 2)) / sum(score * score) AS nmse, sum(CASE WHEN rn <= 8 THEN score * score ELSE 0 END) / sqrt(sum(CASE WHEN rn <= 8 THEN score * score ELSE 0 END) * sum(score * score)) AS cosine FROM r GROUP BY row_id", "row_id", "nmse cosine", _RANKED))
def _(spark, d):
    v = vectors(spark, d).withColumn("y", V.keep_topk(F.col("vec"), 8))
    return tidy(v.select("row_id", V.nmse(F.col("vec"), F.col("y")).alias("nmse"), V.cosine(F.col("vec"), F.col("y")).alias("cosine")))


@register("a17_reconstruction_curve", sql(_curve_sql([1, 2, 4, 8, 16, 32, 64]), "k", "effective_k nmse cosine", _RANKED))
def _(spark, d):
    """An orthonormal dictionary; one partial row per task and budget is shuffled."""
    eye = dictionaries.Dictionary(np.eye(64), np.eye(64))
    return tidy(dictionaries.reconstruction_curve(vectors(spark, d), eye, [1, 2, 4, 8, 16, 32, 64]).drop("method"))


@register("a18_sparse_curve", sql("SELECT k, avg(least(k, nz)) AS effective_k, avg((total - kept) / total) AS nmse, avg(CASE WHEN kept > 0 THEN sqrt(kept / total) ELSE 0 END) AS cosine FROM (SELECT k, row_id, sum(CASE WHEN rn <= k AND score > 0 THEN score * score ELSE 0 END) AS kept, count_if(score > 0) AS nz, sum(score * score) AS total FROM q, (SELECT unnest([1, 4, 16, 64])::BIGINT AS k) GROUP BY ALL) GROUP BY k", "k", "effective_k nmse cosine", "q AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY greatest(score, 0) DESC, component) AS rn FROM s)"))
def _(spark, d):
    relu = dictionaries.Dictionary(np.eye(64), np.eye(64), kind="relu")
    return tidy(dictionaries.reconstruction_curve(vectors(spark, d), relu, [1, 4, 16]).drop("method"))


@register("a19_methods_by_layer", sql("SELECT method, k, nmse FROM (SELECT 'positions' AS method, k, avg(1 - kept / total) AS nmse FROM (SELECT k, row_id, sum(CASE WHEN component < k THEN score * score ELSE 0 END) AS kept, sum(score * score) AS total FROM s, (SELECT unnest([4, 16])::BIGINT AS k) GROUP BY ALL) GROUP BY k UNION ALL SELECT 'topk', k, avg(1 - kept / total) FROM (SELECT k, row_id, sum(CASE WHEN rn <= k THEN score * score ELSE 0 END) AS kept, sum(score * score) AS total FROM r, (SELECT unnest([4, 16])::BIGINT AS k) GROUP BY ALL) GROUP BY k)", "method k", "nmse", _RANKED))
def _(spark, d):
    """Union of methods, with a control limited to the first coordinates."""
    s = scores(spark, d)
    v = vectors(spark, d)
    eye = dictionaries.Dictionary(np.eye(64), np.eye(64))
    top = dictionaries.reconstruction_curve(v, eye, [4, 16], method="topk").where("k < 64").select("method", "k", "nmse")
    per = s.withColumn("k", F.explode(F.array(F.lit(4).cast("long"), F.lit(16).cast("long")))).groupBy("k", "row_id").agg((1 - F.sum(F.when(F.col("component") < F.col("k"), F.col("score") * F.col("score")).otherwise(0.0)) / F.sum(F.col("score") * F.col("score"))).alias("e"))
    return tidy(top.unionByName(per.groupBy("k").agg(F.avg("e").alias("nmse")).select(F.lit("positions").alias("method"), "k", "nmse")))


_RESULTS = "SELECT lang, source, avg(n_chars) AS metric FROM documents GROUP BY ALL"


@register("a20_cross_dataset_mean", f"SELECT lang, round(avg(metric), 6) AS metric FROM ({_RESULTS}) GROUP BY lang")
def _(spark, d):
    """Means of means."""
    per = table(spark, d, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("metric"))
    return tidy(dictionaries.cross_dataset_mean(per, ["lang"], ["metric"]))


@register("a22_fallback_metric", "SELECT d.doc_id, coalesce(l.q, n_chars / 1000) AS metric FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::DOUBLE AS q FROM labels GROUP BY 1) l USING (doc_id)")
def _(spark, d):
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("q"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(marks, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("q", F.col("n_chars") / 1000).alias("metric"))


@register("a23_all_or_no_nulls", "SELECT lang, count(*)::BIGINT AS n, CASE WHEN lang = 'en' THEN NULL ELSE round(avg(n_chars), 6) END AS mean FROM documents GROUP BY lang")
def _(spark, d):
    docs = table(spark, d, "documents").select("lang", F.when(F.col("lang") != "en", F.col("n_chars").cast("double")).alias("v"))
    return tidy(joins.all_or_no_nulls(docs, ["lang"], "v"))


@register("a56_condition_summary", sql("SELECT label, count(*)::BIGINT AS completed, count_if(component % 5 <> 0)::BIGINT AS defined, count_if(component % 5 = 0)::BIGINT AS undefined, avg(CASE WHEN component % 5 <> 0 THEN score END) AS mean FROM s GROUP BY label", "label completed defined undefined", "mean"))
def _(spark, d):
    v = F.when(F.col("component") % 10 == 0, float("nan")).when(F.col("component") % 5 == 0, None).otherwise(F.col("score"))
    return tidy(erf.condition_summary(scores(spark, d).withColumn("v", v), ["label"], "v"))


@register("a57_component_fields", sql("SELECT label, quantile_cont(e, 0.5) AS median, avg(e) AS mean, min(e) AS min, max(e) AS max, count(e)::BIGINT AS recovered, count(*)::BIGINT AS tried FROM (SELECT label, row_id, CASE WHEN upper - lower = 1 THEN upper ELSE sqrt(greatest(lower, 1) * upper) END AS e FROM (SELECT label, row_id, min(CASE WHEN ok THEN len END) AS upper, arg_min(CASE WHEN ok THEN below END, CASE WHEN ok THEN len END) AS lower FROM (SELECT label, row_id, len, score > 0.1 AS ok, coalesce(lag(len) OVER (PARTITION BY row_id ORDER BY len), 0) AS below FROM s JOIN (SELECT unnest([1, 2, 3, 4, 6, 12, 48])::BIGINT AS len) l ON s.component = l.len) GROUP BY ALL)) GROUP BY label", "label recovered tried", "median mean min max"))
def _(spark, d):
    """Bounds, their geometric middle, and the summary."""
    lengths = [1, 2, 3, 4, 6, 12, 48]
    s = scores(spark, d).where(F.col("component").isin(lengths)).withColumnRenamed("component", "len")
    e = erf.recovery_estimates(s, ["label", "row_id"], "len", F.col("score") > 0.1)
    return tidy(erf.component_summary(e, ["label"], "estimate"))


@register("a58_gradient_field", sql("SELECT row_id, exp(sum(p * ln(dist))) AS geometric, sum(p * dist) AS arithmetic, min(CASE WHEN cum >= 0.5 - 1e-12 THEN dist END)::BIGINT AS radius50, min(CASE WHEN cum >= 0.9 - 1e-12 THEN dist END)::BIGINT AS radius90, min(CASE WHEN cum >= 0.95 - 1e-12 THEN dist END)::BIGINT AS radius95 FROM (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY dist) AS cum FROM (SELECT row_id, component + 1 AS dist, score * score / sum(score * score) OVER (PARTITION BY row_id) AS p FROM s)) GROUP BY row_id", "row_id radius50 radius90 radius95", "geometric arithmetic"))
def _(spark, d):
    from ..sources.tables import long_scores

    e = long_scores(vectors(spark, d).select("row_id", V.energy(F.col("vec")).alias("vec"))).select("row_id", (F.col("component") + 1).alias("dist"), F.col("score").alias("p"))
    return tidy(erf.gradient_statistics(e, ["row_id"], "dist", "p"))


@register("a60_field_histogram", "SELECT b.bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(1, 8))::BIGINT AS bin) b LEFT JOIN (SELECT CASE WHEN v >= 32 THEN 7 WHEN v >= 16 THEN 6 WHEN v >= 8 THEN 5 WHEN v >= 4 THEN 4 WHEN v >= 3 THEN 3 WHEN v >= 2 THEN 2 WHEN v >= 1 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM (SELECT value AS v FROM events) GROUP BY 1) USING (bin)")
def _(spark, d):
    return erf.field_histogram(table(spark, d, "events"), "value")


@register("a66_expected_label", sql("SELECT row_id, sum(component * exp(8 * score - top)) / sum(exp(8 * score - top)) AS expected FROM (SELECT *, max(8 * score) OVER (PARTITION BY row_id) AS top FROM s WHERE component <= 10) GROUP BY row_id", "row_id", "expected"))
def _(spark, d):
    s = scores(spark, d).where("component <= 10").withColumn("lp", F.col("score") * 8)
    return tidy(erf.expected_label(s, ["row_id"], "component", "lp"))


@register("a69_log_score_winner", sql("SELECT label, arg_max(row_id, (round(score, 9), -row_id)) AS winner FROM s WHERE component = 5 GROUP BY label", "label winner"))
def _(spark, d):
    s = scores(spark, d).where("component = 5").withColumn("score", F.round("score", 9))
    return s.groupBy("label").agg(F.max_by("row_id", F.struct("score", -F.col("row_id"))).alias("winner"))


@register("suffix_recovery", sql("SELECT row_id, rank, sign_ok, rank <= 8 AND sign_ok AS recovered FROM (SELECT row_id, component, score > 0 AS sign_ok, rank() OVER (PARTITION BY row_id ORDER BY abs(score) DESC) AS rank FROM s) WHERE component = 6", "row_id rank sign_ok recovered"))
def _(spark, d):
    """W1 with sign and threshold: is the target component found?"""
    s = scores(spark, d).withColumn("target", F.lit(6).cast("long"))
    return erf.suffix_recovery(s, ["row_id"], "component", "target", 8, 1)


@register("strict_json_labels", "SELECT event_id, round(value, 4) + 0.0 AS first, (event_id % 5)::DOUBLE AS second FROM events WHERE event_id % 4 = 0")
def _(spark, d):
    """Section 2.8: {"0": .., "1": ..} must hold exactly the indexed keys; a further key, one too few and
    text that is no such object give no labels."""
    e = table(spark, d, "events")
    v, w, kind = F.round("value", 4).cast("string"), (F.col("event_id") % 5).cast("string"), F.col("event_id") % 4
    whole = F.concat(F.lit('{"0": '), v, F.lit(', "1": '), w, F.lit("}"))
    more = F.concat(F.lit('{"0": '), v, F.lit(', "1": '), w, F.lit(', "2": 1}'))
    less = F.concat(F.lit('{"0": '), v, F.lit("}"))
    e = e.withColumn("labels", S.indexed_labels(F.when(kind == 0, whole).when(kind == 1, more).when(kind == 2, less).otherwise(F.col("props")), 2))
    return e.where("labels IS NOT NULL").select("event_id", (F.round(F.col("labels")[0], 4) + F.lit(0.0)).alias("first"), F.col("labels")[1].alias("second"))
