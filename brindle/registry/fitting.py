"""Queries over fitted lenses (M1-M15, A1-A3, A13, A82) by their invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.linear import sum_pass
from ..operators.statistics import component_statistics
from ..plans import fastica
from ..plans.lens import Lens
from ..sources.tables import long_scores, vectors
from .base import registrar, sql, tidy

ENTRIES: dict = {}
register = registrar(ENTRIES)


def fitted_lens(spark, d, k: int = 8, **options) -> tuple:
    rows = vectors(spark, d)
    return rows, Lens.fit(rows, k, max_iter=options.pop("max_iter", 20), **options)


@register("a01_mean_vector", sql("SELECT component, avg(score) AS mean FROM s GROUP BY component", "component", "mean"))
def _(spark, d):
    """A1: partial sums per task."""
    n, mean = fastica.mean_vector(vectors(spark, d))
    return tidy(spark.createDataFrame([(i, float(v)) for i, v in enumerate(mean)], "component bigint, mean double"))


@register("a02_scatter_matrix", sql("SELECT a.component AS i, b.component AS j, sum((a.score - a.m) * (b.score - b.m)) AS v FROM c a JOIN c b USING (row_id) GROUP BY ALL", "i j", "v", "c AS (SELECT *, avg(score) OVER (PARTITION BY component) AS m FROM s)"))
def _(spark, d):
    """A2: one matrix product per batch instead of a 64 x 64 self-join of the long form."""
    rows = vectors(spark, d)
    _, mean = fastica.mean_vector(rows)
    m = fastica.scatter_matrix(rows, mean)
    return tidy(spark.createDataFrame([(i, j, float(m[i, j])) for i in range(64) for j in range(64)], "i bigint, j bigint, v double"))


@register("a03_merged_kurtosis", sql("SELECT component, kurtosis_pop(score) AS kurtosis FROM s GROUP BY component", "component", "kurtosis", digits=5))
def _(spark, d):
    """A3, A4: power sums about the mean, merged over tasks."""
    k = fastica.excess_kurtosis(vectors(spark, d), np.eye(64))
    return tidy(spark.createDataFrame([(i, float(v)) for i, v in enumerate(k)], "component bigint, kurtosis double"), 5)


@register("a13_geometric_median", "SELECT 1::BIGINT AS stationary")
def _(spark, d):
    """At the median the unit vectors to all rows add up to nearly nothing."""
    rows = vectors(spark, d)
    m = fastica.geometric_median(rows, steps=200, tol=1e-9)
    pull = sum_pass(rows, lambda x: [((x - m) / np.maximum(np.linalg.norm(x - m, axis=1, keepdims=True), 1e-12)).sum(axis=0), np.array([len(x)], float)])
    return spark.createDataFrame([(int(np.linalg.norm(pull[0]) < 1e-4 * pull[1][0]),)], "stationary bigint")


@register("m02_whiteness", "SELECT i::BIGINT AS i, j::BIGINT AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM range(0, 64) a(i), range(0, 64) b(j)")
def _(spark, d):
    """M2: whitened rows have the identity as their covariance."""
    rows = vectors(spark, d)
    n, mean = fastica.mean_vector(rows, l2=True)
    w = fastica.whitening_matrix(fastica.scatter_matrix(rows, mean, l2=True), n, 64)
    cov = w @ fastica.scatter_matrix(rows, mean, l2=True) @ w.T / n
    return tidy(spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(64) for j in range(64)], "i bigint, j bigint, v double"))


@register("m03_fit_invariants", "SELECT unnest(['decorrelated', 'dual', 'ordered', 'unit_variance']) AS name, TRUE AS ok")
def _(spark, d):
    """M1-M6, L1: the unmixing is orthogonal, reading and writing are dual, strengths fall, and scores have
    unit variance."""
    rows, lens = fitted_lens(spark, d)
    x = lens.layers[0]
    s = long_scores(lens.transform(rows, 0).select("row_id", F.col("scores").alias("vec")))
    var = s.groupBy("component").agg(F.var_pop("score").alias("v")).agg(F.max(F.abs(F.col("v") - 1)).alias("e")).first()["e"]
    st = np.array(x.fitting["strengths"])
    cov = np.allclose(x.reading @ x.writing, np.eye(len(x.reading)), atol=1e-6)
    f = [("decorrelated", bool(var < 1e-6)), ("dual", bool(cov)), ("ordered", bool((np.diff(st) <= 1e-12).all())), ("unit_variance", bool(var < 1e-6))]
    return spark.createDataFrame(f, "name string, ok boolean")


@register("m04_deflation_invariants", "SELECT TRUE AS orthonormal")
def _(spark, d):
    f = fastica.fit_fastica(vectors(spark, d), 3, algorithm="deflation", max_iter=5)
    return spark.createDataFrame([(bool(np.allclose(f.unmixing @ f.unmixing.T, np.eye(3), atol=1e-8)),)], "orthonormal boolean")


@register("m08_history", "SELECT unnest([3, 6, 8])::BIGINT AS iteration, 11::BIGINT AS percentiles")
def _(spark, d):
    """M8, M9: objectives every third step and at the end."""
    f = fastica.fit_fastica(vectors(spark, d), 4, max_iter=8, objective_every=3)
    return spark.createDataFrame([(h["iteration"], len(h["percentiles"])) for h in f.history], "iteration bigint, percentiles bigint")


@register("m13_pca_variances", "SELECT TRUE AS sorted, TRUE AS trace_kept")
def _(spark, d):
    """Principal variances sum to the total variance."""
    rows = vectors(spark, d)
    n, mean = fastica.mean_vector(rows)
    m = fastica.scatter_matrix(rows, mean)
    values, _ = fastica.sample_pca(m, n)
    return spark.createDataFrame([(bool((np.diff(values) <= 1e-12).all()), bool(abs(values.sum() - np.trace(m) / (n - 1)) < 1e-9))], "sorted boolean, trace_kept boolean")


@register("flagship_lens_profile")
def flagship(spark, d):
    """Fit (K = 8), score every row, and profile the components: the engine's main path."""
    rows, lens = fitted_lens(spark, d)
    s = long_scores(lens.transform(rows, 0).select("row_id", F.col("scores").alias("vec")))
    return tidy(component_statistics(s).select("component", "n", "n_positive", "n_negative", "mean", "variance", "kurtosis", "tail"), 5)
