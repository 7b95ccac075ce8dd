"""Queries over statistics."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import agreement, statistics
from ..operators.dictionaries import class_contrast, dead_features, masked_mean, perturbation_norms
from ..plans.fastica import correlations
from ..sources.tables import scores, table, vectors
from .base import LONG, registrar, sql, tidy

ENTRIES: dict = {}
register = registrar(ENTRIES)

_SKEW = "coalesce(avg(pow(score - m, 3)) / pow(avg(pow(score - m, 2)), 1.5), 0)"
_M = "(SELECT *, avg(score) OVER (PARTITION BY component) AS m FROM s)"
_STATS = f"SELECT component, count(*)::BIGINT AS n, count_if(score > 0)::BIGINT AS n_positive, count_if(score < 0)::BIGINT AS n_negative, sum(CASE WHEN score > 0 THEN score * score ELSE 0 END) AS e_pos, sum(CASE WHEN score < 0 THEN score * score ELSE 0 END) AS e_neg, avg(score) AS mean, var_pop(score) AS variance, {_SKEW} AS skewness, kurtosis_pop(score) AS kurtosis, max(score * score) / sum(score * score) AS top_share2, max(pow(score, 4)) / sum(pow(score, 4)) AS top_share4 FROM {_M} GROUP BY component"
_TAIL = "CASE WHEN skewness > 0 THEN 1 WHEN skewness < 0 THEN -1 WHEN e_pos >= e_neg THEN 1 ELSE -1 END::BIGINT"


@register("a06_component_statistics", sql(f"SELECT *, n_positive / (n_positive + n_negative) AS positive_fraction, e_pos / (e_pos + e_neg) AS positive_energy, {_TAIL} AS tail, row_number() OVER (ORDER BY kurtosis DESC, component) AS kurtosis_rank FROM ({_STATS})", "component n n_positive n_negative tail kurtosis_rank", "e_pos e_neg mean variance skewness kurtosis top_share2 top_share4 positive_fraction positive_energy"))
def _(spark, d):
    """One aggregation over the long form."""
    return tidy(statistics.kurtosis_ranks(statistics.component_statistics(scores(spark, d))))


@register("a05_layer_kurtosis", sql("SELECT label, avg(k) AS mean, quantile_cont(k, 0.5) AS median FROM (SELECT label, component, kurtosis_pop(score) AS k FROM s GROUP BY ALL) GROUP BY label", "label", "mean median"))
def _(spark, d):
    """A5: per layer (here: label), the mean and median over components."""
    per = scores(spark, d).groupBy("label", "component").agg(statistics.population_excess(F.col("score")).alias("k"))
    return tidy(per.groupBy("label").agg(F.avg("k").alias("mean"), F.percentile("k", F.lit(0.5)).alias("median")))


@register("a10_contrast_objectives", sql("SELECT component, avg(abs(x) + ln(1 + exp(-2 * abs(x))) - ln(2)) AS logcosh, -avg(exp(-x * x / 2)) AS exp, avg(pow(x, 4)) / 4 AS cube, avg((exp(2 * x) - 1) / (exp(2 * x) + 1)) AS slope, stddev_pop(x) AS std FROM (SELECT component, 8 * score AS x FROM s) GROUP BY component", "component", "logcosh exp cube slope std"))
def _(spark, d):
    """A10-A12."""
    x = F.col("score") * 8
    return tidy(scores(spark, d).groupBy("component").agg(*[F.avg(S.contrast(x, k)).alias(k) for k in ("logcosh", "exp", "cube")], F.avg(S.slope(x, "logcosh")).alias("slope"), F.stddev_pop(x).alias("std")))


@register("a14_percentile_summary", f"WITH {LONG}, p AS (SELECT label, unnest(range(0, 11)) AS k, unnest(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS value FROM s GROUP BY label) SELECT label, k::BIGINT * 10 AS percentile, round(value, 6) + 0.0 AS value FROM p")
def _(spark, d):
    p = statistics.percentile_summary(scores(spark, d), ["label"], "score")
    return tidy(p.select("label", F.posexplode("percentiles").alias("k", "value")).select("label", (F.col("k") * 10).alias("percentile"), "value"))


@register("a15_quantile_summary", sql("SELECT label, avg(score) AS mean, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.9) AS p90 FROM s GROUP BY label", "label", "mean p10 median p90"))
def _(spark, d):
    q = lambda p: F.percentile("score", F.lit(p))
    return tidy(scores(spark, d).groupBy("label").agg(F.avg("score").alias("mean"), q(0.1).alias("p10"), q(0.5).alias("median"), q(0.9).alias("p90")))


@register("a24_masked_mean", sql("SELECT label, component, sum(CASE WHEN z THEN score ELSE 0 END) / greatest(count_if(z), 1) AS mean FROM (SELECT *, row_id % 4 <> 0 AS z FROM s) GROUP BY label, component", "label component", "mean"))
def _(spark, d):
    """Rows blanked by a mask do not count."""
    v = vectors(spark, d).withColumn("vec", F.when(F.col("row_id") % 4 != 0, F.col("vec")).otherwise(F.array_repeat(F.lit(0.0), 64)))
    return tidy(masked_mean(v, "label", "vec").select("label", F.posexplode("mean").alias("component", "mean")))


@register("a26_class_contrast", sql("SELECT component, contrast, row_number() OVER (ORDER BY abs(contrast) DESC, component) AS rank FROM (SELECT component, avg(CASE WHEN label = 1 THEN score END) - avg(CASE WHEN label = 2 THEN score END) AS contrast FROM s WHERE label IN (1, 2) GROUP BY component) QUALIFY rank <= 10", "component rank", "contrast"))
def _(spark, d):
    return tidy(class_contrast(scores(spark, d), "label", 1, 2, 10))


_CORR = "CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) THEN corr({x}, {y}) END"


@register("a27_pearson", sql(f"SELECT label, {_CORR.format(x='a', y='b')} AS r, CAST(NULL AS DOUBLE) AS constant FROM (SELECT label, row_id, max(score) FILTER (component = 0) AS a, max(score) FILTER (component = 1) AS b FROM s GROUP BY label, row_id) GROUP BY label", "label", "r constant"))
def _(spark, d):
    v = vectors(spark, d).select("label", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    return tidy(v.groupBy("label").agg(statistics.safe_corr(F.col("a"), F.col("b")).alias("r"), statistics.safe_corr(F.col("a"), F.lit(1.0)).alias("constant")))


@register("a28_correlation_matrix", sql("SELECT x.component AS a, y.component AS b, corr(x.score, y.score) AS correlation FROM s x JOIN s y USING (row_id) GROUP BY ALL", "a b", "correlation"))
def _(spark, d):
    """All by all from one matrix product per batch; the join form is ``statistics.correlation_matrix``."""
    m = correlations(vectors(spark, d))
    return tidy(spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "a bigint, b bigint, correlation double"))


_RATED = "r AS (SELECT lang AS model, d.doc_id, (quality + toxic)::BIGINT AS a, least(2, n_chars // 2000)::BIGINT AS b FROM documents d JOIN (SELECT DISTINCT * FROM labels) l USING (doc_id))"


def _rated(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").distinct(), "doc_id").select(F.col("lang").alias("model"), "doc_id", (F.col("quality") + F.col("toxic")).cast("long").alias("a"), F.least(F.lit(2), F.floor(F.col("n_chars") / 2000)).cast("long").alias("b"))


@register("a29_spearman", sql("SELECT count(*)::BIGINT AS n, corr(ra, rb) AS spearman FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM r)", "n", "spearman", _RATED))
def _(spark, d):
    return tidy(agreement.spearman(_rated(spark, d), "a", "b"))


_KAPPA = "SELECT grp, n, exact, within_one, CASE WHEN clin > 0 THEN 1 - lin * n / clin END AS kappa_linear, CASE WHEN cquad > 0 THEN 1 - quad * n / cquad END AS kappa_quadratic FROM (SELECT grp, count(*)::BIGINT AS n, avg((a = b)::INT) AS exact, avg((abs(a - b) <= 1)::INT) AS within_one, sum(abs(a - b) / 2) AS lin, sum(pow(a - b, 2) / 4) AS quad FROM g GROUP BY grp) JOIN (SELECT x.grp, sum(abs(x.a - y.b) / 2) AS clin, sum(pow(x.a - y.b, 2) / 4) AS cquad FROM g x JOIN g y ON x.grp = y.grp GROUP BY x.grp) USING (grp)"


@register("a30_rating_agreement", sql(_KAPPA, "grp n", "exact within_one kappa_linear kappa_quadratic", f"{_RATED}, g AS (SELECT 'all' AS grp, a, b FROM r UNION ALL SELECT model, a, b FROM r)"))
def _(spark, d):
    """Grouping sets over a table of counts."""
    return tidy(agreement.rating_agreement(_rated(spark, d), "model", "a", "b", 3))


@register("a31_binary_kappa", sql("SELECT n, po, pe, (po - pe) / (1 - pe) AS kappa FROM (SELECT count(*)::BIGINT AS n, avg((x = y)::INT) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe FROM (SELECT (a > 0)::INT AS x, (b > 0)::INT AS y FROM r))", "n", "po pe kappa", _RATED))
def _(spark, d):
    r = _rated(spark, d).select((F.col("a") > 0).cast("int").alias("x"), (F.col("b") > 0).cast("int").alias("y"))
    return tidy(agreement.binary_kappa(r, "x", "y"))


@register("a33_confidence_histogram", sql("SELECT model, confidence, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / total AS fraction FROM (SELECT model, confidence FROM (SELECT DISTINCT model FROM r) CROSS JOIN (SELECT unnest(range(0, 6))::BIGINT AS confidence)) LEFT JOIN (SELECT model, a AS confidence, count(*) AS n FROM r GROUP BY ALL) USING (model, confidence) JOIN (SELECT model, count(*) AS total FROM r GROUP BY 1) USING (model)", "model confidence n", "fraction", _RATED))
def _(spark, d):
    return tidy(agreement.confidence_histogram(_rated(spark, d), "model", "a", 6))


_Q = ", ".join(f"quantile_cont(value, {p / 100}) AS p{str(p).replace('.', '_')}" for p in (1, 5, 25, 50, 75, 95, 99, 99.9))


@register("a34_describe", f"SELECT event_type, n, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in 'mean std min max skewness kurtosis frac_above_0 frac_above_1 p1 p5 p25 p50 p75 p95 p99 p99_9'.split())} FROM (SELECT event_type, count(value)::BIGINT AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS skewness, kurtosis_pop(value) AS kurtosis, avg((value > 0)::INT) AS frac_above_0, avg((value > 1)::INT) AS frac_above_1, {_Q} FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type)")
def _(spark, d):
    return tidy(statistics.describe(table(spark, d, "events"), "value", ["event_type"]), 4)


@register("a35_token_concentration", "SELECT count(*)::BIGINT AS distinct_tokens, round(exp(-sum(p * ln(p))), 6) AS effective_tokens, round(sum(CASE WHEN rank <= 10 THEN p ELSE 0 END), 6) AS top_share FROM (SELECT n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n DESC, user_id) AS rank FROM (SELECT user_id, count(*) AS n FROM events WHERE value >= (SELECT quantile_cont(value, 0.9) FROM events) GROUP BY user_id))")
def _(spark, d):
    return tidy(statistics.token_concentration(table(spark, d, "events"), "user_id", "value", 0.9))


@register("a36_quantile_calibration", sql("SELECT component, threshold, avg(CASE WHEN score < threshold THEN score END) AS mean_below, avg(CASE WHEN score >= threshold THEN score END) AS mean_above, avg((score < threshold)::INT) AS fraction_below FROM (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY component) AS threshold FROM s) GROUP BY ALL", "component", "threshold mean_below mean_above fraction_below"))
def _(spark, d):
    return tidy(statistics.quantile_calibration(scores(spark, d), "component", "score", 0.9))


@register("a38_coactivation", sql("SELECT CASE WHEN a >= qa AND b >= qb THEN 'both' WHEN a >= qa THEN 'only_a' WHEN b >= qb THEN 'only_b' ELSE 'neither' END AS cell, count(*)::BIGINT AS n, avg(a) AS mean_a, avg(b) AS mean_b FROM v, (SELECT quantile_cont(a, 0.8) AS qa, quantile_cont(b, 0.8) AS qb FROM v) GROUP BY 1", "cell n", "mean_a mean_b", "v AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)"))
def _(spark, d):
    v = vectors(spark, d).select(F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    return tidy(statistics.coactivation(v, "a", "b", 0.8))


@register("a40_direction_statistics", sql("SELECT label, quantile_cont(v, 0.5) AS median_var, quantile_cont(k, 0.25) AS q25_kurtosis, quantile_cont(k, 0.75) AS q75_kurtosis FROM (SELECT label, component, var_pop(score) AS v, kurtosis_pop(score) AS k FROM s GROUP BY ALL) GROUP BY label", "label", "median_var q25_kurtosis q75_kurtosis"))
def _(spark, d):
    per = scores(spark, d).groupBy("label", "component").agg(F.var_pop("score").alias("v"), statistics.population_excess(F.col("score")).alias("k"))
    return tidy(per.groupBy("label").agg(F.percentile("v", F.lit(0.5)).alias("median_var"), F.percentile("k", F.lit(0.25)).alias("q25_kurtosis"), F.percentile("k", F.lit(0.75)).alias("q75_kurtosis")))


@register("a42_similarity_summary", sql("SELECT label, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, min(v) AS min, max(v) AS max, avg((v >= 0.9)::INT) AS frac_90, avg((v >= 0.95)::INT) AS frac_95, avg((v >= 0.99)::INT) AS frac_99 FROM (SELECT label, least(1.0, 8 * abs(score)) AS v FROM s) GROUP BY label", "label", "mean median p05 q25 q75 min max frac_90 frac_95 frac_99"))
def _(spark, d):
    v = scores(spark, d).select("label", F.least(F.lit(1.0), 8 * F.abs("score")).alias("v"))
    return tidy(statistics.overlap_summary(v, ["label"], "v"))


@register("a46_standardised_logcosh", sql("SELECT component, avg(abs(score) + ln(1 + exp(-2 * abs(score))) - ln(2)) AS raw, avg(abs(z) + ln(1 + exp(-2 * abs(z))) - ln(2)) - 0.37456720748834715 AS deviation FROM (SELECT *, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS z FROM s WINDOW w AS (PARTITION BY component)) GROUP BY component", "component", "raw deviation"))
def _(spark, d):
    """Two aggregations joined on the component, no window over rows."""
    s = scores(spark, d)
    m = F.broadcast(s.groupBy("component").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd")))
    z = (F.col("score") - F.col("m")) / F.col("sd")
    return tidy(s.join(m, "component").groupBy("component").agg(F.avg(S.logcosh(F.col("score"))).alias("raw"), (F.avg(S.logcosh(z)) - S.GAUSSIAN["logcosh"]).alias("deviation")))


@register("a50_dead_features", sql("SELECT component FROM (SELECT component, max(greatest(score - 0.36, 0)) AS top FROM s GROUP BY 1) WHERE top <= 0", "component"))
def _(spark, d):
    return dead_features(scores(spark, d).withColumn("code", F.greatest(F.col("score") - 0.36, F.lit(0.0))), "component", "code")


@register("a51_perturbation_norms", sql("SELECT label, avg(size) AS absolute, avg(size / own) AS relative, avg((size > 0)::INT) AS changed, sqrt(sum(size * size)) / sqrt(sum(own * own)) AS pooled_relative FROM (SELECT label, row_id, sqrt(sum(CASE WHEN component < 4 AND row_id % 2 = 0 THEN score * score ELSE 0 END)) AS size, sqrt(sum(score * score)) AS own FROM s GROUP BY ALL) GROUP BY label", "label", "absolute relative changed pooled_relative"))
def _(spark, d):
    v = vectors(spark, d).withColumn("edited", F.transform("vec", lambda x, i: F.when((i < 4) & (F.col("row_id") % 2 == 0), 0.0).otherwise(x)))
    return tidy(perturbation_norms(v, "label", "vec", "edited"))


@register("a64_jarque_bera", sql("SELECT component, n, skewness, kurtosis, n / 6 * (skewness * skewness + kurtosis * kurtosis / 4) AS jb, exp(-(n / 6 * (skewness * skewness + kurtosis * kurtosis / 4)) / 2) AS p_value FROM (" + _STATS + ")", "component n", "skewness kurtosis jb p_value", digits=5))
def _(spark, d):
    return tidy(statistics.jarque_bera(scores(spark, d), "component", "score"), 5)


@register("a65_mean_pairwise_cosine", sql("SELECT label, n, (ss - n) / (n * (n - 1)) AS mean_cosine FROM (SELECT label, max(n)::BIGINT AS n, sum(t * t) AS ss FROM (SELECT label, component, sum(u) AS t, count(*) AS n FROM (SELECT label, component, score / sqrt(sum(score * score) OVER (PARTITION BY row_id)) AS u FROM s) GROUP BY ALL) GROUP BY label)", "label n", "mean_cosine"))
def _(spark, d):
    from ..functions import vectors as V

    v = vectors(spark, d).withColumn("u", V.l2_normalize(F.col("vec")))
    return tidy(statistics.mean_pairwise_cosine(v, ["label"], "u"))


@register("a70_distinct_counts", "SELECT count(DISTINCT source)::BIGINT AS sources, count(DISTINCT lang)::BIGINT AS langs, count(DISTINCT text)::BIGINT AS texts FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct("text").alias("texts"))


_CURVES = "SELECT event_type, user_id AS curve, (1 + (day(ts) - 1) // 7)::BIGINT AS x, avg(value) AS y FROM events GROUP BY ALL"


def _curves(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.col("user_id").alias("curve"), (1 + F.floor((F.dayofmonth("ts") - 1) / 7)).cast("long").alias("x")).agg(F.avg("value").alias("y"))


@register("a72_modal_grid", f"WITH c AS ({_CURVES}), e AS (SELECT curve, x, avg(y) AS y FROM c GROUP BY ALL), g AS (SELECT curve, string_agg(x::VARCHAR, ',' ORDER BY x) AS grid FROM e GROUP BY curve), b AS (SELECT grid FROM g GROUP BY grid ORDER BY count(*) DESC, grid LIMIT 1) SELECT x, round(avg(y), 6) AS mean FROM e JOIN g USING (curve) JOIN b USING (grid) GROUP BY x")
def _(spark, d):
    c = _curves(spark, d).groupBy("curve", "x").agg(F.avg("y").alias("y"))
    return tidy(statistics.modal_grid_curve(c, "curve", "x", "y"))


@register("a73_complete_panel", f"WITH c AS ({_CURVES}) SELECT curve FROM c GROUP BY curve HAVING count(DISTINCT x) = (SELECT count(DISTINCT x) FROM c)")
def _(spark, d):
    return statistics.complete_panel(_curves(spark, d), "curve", ["x"])


@register("a76_direction_curves", sql("SELECT label, component % 4 AS method, avg(abs(score)) AS mean_abs, quantile_cont(score, 0.5) AS median, kurtosis_pop(score) + 3 AS kurtosis FROM s GROUP BY ALL", "label method", "mean_abs median kurtosis"))
def _(spark, d):
    return tidy(scores(spark, d).groupBy("label", (F.col("component") % 4).alias("method")).agg(F.avg(F.abs("score")).alias("mean_abs"), F.percentile("score", F.lit(0.5)).alias("median"), (statistics.population_excess(F.col("score")) + 3).alias("kurtosis")))


@register("a77_empirical_cdf", sql("SELECT component, score, cume_dist() OVER (PARTITION BY component ORDER BY score) AS fraction FROM s", "component", "score fraction"))
def _(spark, d):
    return tidy(statistics.empirical_cdf(scores(spark, d), ["component"], "score"))


@register("a78_shared_histogram", "SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS fraction FROM (SELECT event_type, bin, count(*)::BIGINT AS n FROM (SELECT event_type, least(19, floor(sign(value) * ln(1 + abs(value)) / 6.5 * 20))::BIGINT AS bin FROM events WHERE sign(value) * ln(1 + abs(value)) BETWEEN 0 AND 6.5) GROUP BY ALL)")
def _(spark, d):
    return tidy(statistics.shared_histogram(table(spark, d, "events"), "event_type", "value", 0.0, 6.5, 20))


@register("a79_mean_density", "WITH v AS (SELECT event_type, user_id, value / 500 AS x FROM events), p AS (SELECT event_type, user_id, least(9, floor(x * 10))::BIGINT AS bin, count(*) AS n FROM v WHERE x BETWEEN 0 AND 1 GROUP BY ALL), q AS (SELECT event_type, bin, n * 10 / sum(n) OVER (PARTITION BY event_type, user_id) AS density FROM p), m AS (SELECT event_type, count(DISTINCT user_id) AS members FROM v GROUP BY 1) SELECT event_type, b.bin, round(coalesce(t, 0) / members, 6) AS density FROM m CROSS JOIN (SELECT unnest(range(0, 10))::BIGINT AS bin) b LEFT JOIN (SELECT event_type AS et, bin AS bb, sum(density) AS t FROM q GROUP BY ALL) ON et = event_type AND bb = b.bin")
def _(spark, d):
    v = table(spark, d, "events").select("event_type", "user_id", (F.col("value") / 500).alias("x"))
    return tidy(statistics.mean_density(v, "event_type", "user_id", "x", 10))


@register("a80_pivot_trajectories", f"WITH c AS ({_CURVES}), e AS (SELECT curve, x, avg(y) AS y FROM c GROUP BY ALL) SELECT curve, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3, round(d4, 6) AS d4, round(d5, 6) AS d5 FROM (SELECT curve, max(y) FILTER (x = 1) AS d1, max(y) FILTER (x = 2) AS d2, max(y) FILTER (x = 3) AS d3, max(y) FILTER (x = 4) AS d4, max(y) FILTER (x = 5) AS d5 FROM e GROUP BY curve) WHERE d1 IS NOT NULL AND d2 IS NOT NULL AND d3 IS NOT NULL AND d4 IS NOT NULL AND d5 IS NOT NULL")
def _(spark, d):
    c = _curves(spark, d).groupBy("curve", "x").agg(F.avg("y").alias("y"))
    return tidy(statistics.complete_pivot(c, "curve", "x", "y", [1, 2, 3, 4, 5]).toDF("curve", "d1", "d2", "d3", "d4", "d5"))


@register("a81_limits_per_iteration", sql("SELECT label, max(score) AS top, avg(CASE WHEN component <> 3 THEN score END) AS mean FROM s GROUP BY label", "label", "top mean"))
def _(spark, d):
    """NaN cells count as missing."""
    v = F.when(F.col("component") == 3, float("nan")).otherwise(F.col("score"))
    return tidy(scores(spark, d).groupBy("label").agg(F.max("score").alias("top"), F.avg(F.when(~F.isnan(v), v)).alias("mean")))


@register("a55_bootstrap_mean")
def _(spark, d):
    """Rows-only check; resampling has no SQL form that agrees draw by draw."""
    return tidy(statistics.bootstrap_mean(vectors(spark, d).select(F.col("vec")[0].alias("v")), "v", 200))


