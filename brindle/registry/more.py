"""Queries over bases, contrasts, checkpoints and trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import audit, dictionaries, matching, sampling, statistics, windows
from ..operators.linear import apply_linear
from ..plans import fastica
from ..plans.lens import Lens, intervention
from ..sources.tables import long_scores, scores, table, vectors
from .base import registrar, sql, tidy

ENTRIES: dict = {}
register = registrar(ENTRIES)


@register("p14_intervention_map", "SELECT unnest([3, 7])::BIGINT AS component, unnest([0.5, -0.25])::DOUBLE AS value")
def _(spark, d):
    return spark.createDataFrame(sorted(intervention({3: 0.5, 7: -0.25}).items()), "component bigint, value double")


@register("p20_pca_encode", sql("SELECT count(*)::BIGINT AS n, sum(score * score) AS energy FROM s", "n", "energy"))
def _(spark, d):
    """P20, P25: an orthonormal basis of the whole space keeps the energy."""
    basis = fastica.pca_basis(np.diag(np.linspace(1, 2, 64)))
    return tidy(long_scores(apply_linear(vectors(spark, d), basis).select("row_id", F.col("scores").alias("vec"))).agg(F.count("*").alias("n"), F.sum(F.col("score") * F.col("score")).alias("energy")))


@register("p21_random_basis", sql("SELECT row_id, sqrt(sum(score * score)) AS norm FROM s GROUP BY row_id", "row_id", "norm"))
def _(spark, d):
    """Random orthonormal directions keep lengths."""
    basis = fastica.random_orthogonal(64, 64, 5)
    return tidy(apply_linear(vectors(spark, d), basis).select("row_id", V.norm(F.col("scores")).alias("norm")))


@register("p23_untrained_sparsity", sql("SELECT row_id, 8::BIGINT AS active FROM s GROUP BY row_id", "row_id active"))
def _(spark, d):
    """The tied random dictionary keeps exactly its budget of positive codes."""
    codes = dictionaries.apply_dictionary(vectors(spark, d), dictionaries.untrained(64, 256, 8, 1))
    return tidy(codes.select("row_id", F.size(F.filter("codes", lambda x: x > 0)).cast("int").alias("active")))


@register("p25_split_sign_basis", sql("SELECT row_id, component, score FROM s", "row_id component", "score"))
def _(spark, d):
    """Encode with twice as many non-negative features, decode exactly."""
    basis = fastica.random_orthogonal(64, 64, 9)
    dic = dictionaries.split_sign_dictionary(basis, basis.T)
    return tidy(long_scores(dictionaries.apply_dictionary(vectors(spark, d), dic, decode=True, out="y").select("row_id", F.col("y").alias("vec"))))


@register("j13_concept_target", "WITH p AS (SELECT a.vec_id AS row_id, b.vec_id AS match, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS cosine FROM embeddings a, embeddings b WHERE a.label = 3 AND b.label = 4) SELECT row_id, match, round(cosine, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p.cosine DESC, match) = 1")
def _(spark, d):
    """Nearest row of another concept, by the signed cosine."""
    v = vectors(spark, d)
    return tidy(matching.nearest(v.where("label = 3"), v.where("label = 4"), absolute=False))


@register("j21_selected_features", sql("SELECT component, row_id, score FROM s WHERE component IN (SELECT component FROM s GROUP BY component ORDER BY md5('6:' || component), component LIMIT 5)", "component row_id", "score"))
def _(spark, d):
    """Sampled components meet their stored values."""
    s = scores(spark, d)
    pick = sampling.sample_rows(s.select("component").distinct(), 5, "component", 6)
    return tidy(s.join(pick, "component", "left_semi").select("component", "row_id", "score"))


@register("a25_final_position_means", "WITH w AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1) SELECT role, count(*)::BIGINT AS n, round(avg(length(text)), 6) AS mean_length FROM conversations c JOIN w ON c.conv_id = w.conv_id AND c.turn = w.t GROUP BY role")
def _(spark, d):
    """Means at last positions."""
    last = windows.last_position(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    return tidy(last.groupBy("role").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean_length")))


@register("a39_top_tail_means", sql("SELECT label, count(*)::BIGINT AS n, avg(a) AS a, avg(b) AS b FROM (SELECT *, quantile_cont(a, 0.9) OVER (PARTITION BY label) AS edge FROM (SELECT label, row_id, max(score) FILTER (component = 0) AS a, max(score) FILTER (component = 1) AS b FROM s GROUP BY ALL)) WHERE a > edge GROUP BY label", "label n", "a b"))
def _(spark, d):
    v = vectors(spark, d).select("label", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    return tidy(statistics.top_tail_means(v, ["label"], "a", ["a", "b"], 0.9))


@register("a41_excess_over_null", sql("SELECT label, mean, median, mean - (SELECT avg(abs(score)) FROM s WHERE label = 0) AS excess FROM (SELECT label, avg(abs(score)) AS mean, quantile_cont(abs(score), 0.5) AS median FROM s GROUP BY label)", "label", "mean median excess"))
def _(spark, d):
    s = scores(spark, d).select("label", F.abs("score").alias("v"))
    return tidy(statistics.excess_over_null(s, "label", "v", 0).select("label", "mean", "median", "excess"))


@register("a43_seed_grid", "WITH p AS (SELECT a.n_regionkey::BIGINT AS a, b.n_regionkey::BIGINT AS b, abs(a.n_nationkey - b.n_nationkey) / 25.0 AS v FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey), m AS (SELECT a, b, avg(v) AS v FROM p GROUP BY ALL) SELECT a AS row, b AS col, round(v, 6) AS v FROM m UNION ALL SELECT b, a, round(v, 6) FROM m UNION ALL SELECT DISTINCT n_regionkey::BIGINT, n_regionkey::BIGINT, 1.0 FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("r"), F.col("n_nationkey").alias("k"))
    p = n.alias("x").join(n.alias("y"), F.col("x.r") < F.col("y.r")).select(F.col("x.r").alias("a"), F.col("y.r").alias("b"), (F.abs(F.col("x.k") - F.col("y.k")) / 25.0).alias("v"))
    return tidy(statistics.symmetric_grid(p, "a", "b", "v"))


@register("a45_checkpoint_moments", sql("SELECT row_id % 4 AS step, component, count(*)::BIGINT AS n, avg(score * score) AS raw2, avg(pow(score, 4)) AS raw4, kurtosis_pop(score) AS kurtosis, avg(abs(score) + ln(1 + exp(-2 * abs(score))) - ln(2)) AS logcosh FROM s GROUP BY ALL", "step component n", "raw2 raw4 kurtosis logcosh"))
def _(spark, d):
    """Stacked checkpoints in one pass."""
    s = scores(spark, d).withColumn("step", F.col("row_id") % 4)
    return tidy(statistics.grouped_moments(s, ["step", "component"], "score").drop("skewness"))


@register("a53_fallback_check", "SELECT doc_id, coalesce(q, r) AS metric, q IS NULL OR abs(q - r) <= 1e-7 AS agrees FROM (SELECT d.doc_id, l.q, (length(text) > 0)::INT::DOUBLE AS r FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::DOUBLE AS q FROM labels GROUP BY 1) l USING (doc_id))")
def _(spark, d):
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("q"))
    docs = table(spark, d, "documents").select("doc_id", (F.length("text") > 0).cast("int").cast("double").alias("r")).join(marks, "doc_id", "left")
    return statistics.fallback_check(docs, "q", "r").select("doc_id", "metric", "agrees")


@register("l11_positive_topk", sql("SELECT component, row_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, row_id) AS rn FROM s WHERE score > 0) WHERE rn <= 5", "component row_id rn", "score"))
def _(spark, d):
    """The filter on positive values comes before the ranking."""
    return tidy(windows.top_per_key(scores(spark, d).where("score > 0"), 5, ["component"], [F.desc("score"), F.col("row_id")]).select("component", "row_id", "score", "rn"))


@register("l12_top_influences", sql("SELECT row_id, component, p FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(p, 9) DESC, component) AS rn FROM (SELECT row_id, component, score * score / sum(score * score) OVER (PARTITION BY row_id) AS p FROM s)) WHERE rn <= 10", "row_id component", "p"))
def _(spark, d):
    e = long_scores(vectors(spark, d).select("row_id", V.energy(F.col("vec")).alias("vec"))).withColumn("p", F.col("score"))
    return tidy(windows.top_per_key(e, 10, ["row_id"], [F.desc(F.round("p", 9)), F.col("component")]).select("row_id", "component", "p"))


@register("m07_resume_from_checkpoint", "SELECT TRUE AS same")
def _(spark, d):
    """M7: five steps, a checkpoint, and five more from it give what ten steps give."""
    kept = {}
    rows = vectors(spark, d)
    whole = fastica.fit_fastica(rows, 4, max_iter=10, checkpoint=lambda i, w, *_: kept.setdefault(i, w))
    more = fastica.fit_fastica(rows, 4, max_iter=10, initial_unmixing=kept[5], start_iteration=5)
    return spark.createDataFrame([(bool(np.allclose(whole.reading, more.reading, atol=1e-6)),)], "same boolean")


@register("m12_resume_by_layer", "SELECT unnest([0, 1])::BIGINT AS layer")
def _(spark, d):
    """Layers that are fitted are left alone."""
    rows = vectors(spark, d)
    lens = Lens.fit(rows, 2, layer=0, max_iter=2, provenance={"m": 1})
    first = lens.layers[0]
    lens = Lens.fit(rows, 2, layer=1, max_iter=2, provenance={"m": 1}, lens=Lens.fit(rows, 2, layer=0, max_iter=2, provenance={"m": 1}, lens=lens))
    assert lens.layers[0] is first
    return spark.createDataFrame([(k,) for k in sorted(lens.layers)], "layer bigint")


@register("m15_unfitted_control", "SELECT TRUE AS white")
def _(spark, d):
    """A random rotation of the whitened space is white, too."""
    rows = vectors(spark, d)
    f = fastica.fit_fastica(rows, 6, max_iter=2, l2=False)
    w = fastica.unfitted_control(f, 3)
    cov = w @ fastica.scatter_matrix(rows, f.center) @ w.T / f.n_rows
    return spark.createDataFrame([(bool(np.allclose(cov, np.eye(6), atol=1e-6)),)], "white boolean")


@register("v01_preflight", "SELECT unnest(['revision', 'width']) AS field")
def _(spark, d):
    """V1: fields in which two provenance records differ."""
    bad = audit.preflight({"model": "m", "revision": "a", "width": 64}, {"model": "m", "revision": "b"}, ["model", "revision", "width"])
    return spark.createDataFrame([(x,) for x in bad], "field string")


@register("v03_fit_replay", "SELECT unnest(['center', 'reading', 'writing']) AS field, TRUE AS close")
def _(spark, d):
    """V3: fitting again gives the same matrices, whatever the partitioning."""
    rows = vectors(spark, d)
    a, b = (Lens.fit(rows.repartition(k, "row_id"), 4, max_iter=5).layers[0] for k in (2, 5))
    got = [(n, bool(np.allclose(getattr(a, n), getattr(b, n), rtol=1e-5, atol=1e-6))) for n in ("center", "reading", "writing")]
    return spark.createDataFrame(got, "field string, close boolean")


@register("v13_adapter_contract", sql("SELECT row_id, count(*)::BIGINT AS n_wrong FROM s WHERE FALSE GROUP BY row_id", "row_id n_wrong"))
def _(spark, d):
    """An encoder against its closed form, row by row; no row may differ."""
    rows = vectors(spark, d)
    got = long_scores(dictionaries.apply_dictionary(rows, dictionaries.Dictionary(np.eye(64), np.eye(64), kind="threshold", threshold=0.1)).select("row_id", F.col("codes").alias("vec")))
    want = scores(spark, d).select("row_id", "component", F.when(F.col("score") > 0.1, F.col("score")).otherwise(0.0).alias("want"))
    return got.join(want, ["row_id", "component"]).where(F.abs(F.col("score") - F.col("want")) > 1e-12).groupBy("row_id").agg(F.count("*").alias("n_wrong"))
