"""Statistics of components and scalars.

Input is long: a key column (component), a value column (score). All are map-side aggregations;
multi-grain results use grouping sets; quantiles are exact and meant for per-component arrays of
moderate length, with ``approx=True`` for the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import even_bin, symlog


def mean_pow(s: Column, p: int) -> Column:
    return F.avg(F.pow(s, F.lit(float(p))))


def population_skewness(s: Column) -> Column:
    """0 where there is no variance."""
    return F.coalesce(F.skewness(s), F.lit(0.0))


def population_excess(s: Column) -> Column:
    """A4; 0 where there is no variance."""
    return F.coalesce(F.kurtosis(s), F.lit(0.0))


def component_statistics(scores: DataFrame, key: str = "component", value: str = "score") -> DataFrame:
    """Count, signs, energies by sign, moments, tail direction and kurtosis rank.

    Zeros count for neither sign. The tail follows the skewness, and where that is 0 the larger share
    of squared scores."""
    s = F.col(value)
    sq = s * s
    out = scores.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(s > 0).alias("n_positive"),
        F.count_if(s < 0).alias("n_negative"),
        F.sum(F.when(s > 0, sq).otherwise(0.0)).alias("e_pos"),
        F.sum(F.when(s < 0, sq).otherwise(0.0)).alias("e_neg"),
        F.avg(s).alias("mean"),
        F.var_pop(s).alias("variance"),
        population_skewness(s).alias("skewness"),
        population_excess(s).alias("kurtosis"),
        (F.max(sq) / F.sum(sq)).alias("top_share2"),
        (F.max(sq * sq) / F.sum(sq * sq)).alias("top_share4"),
    )
    signed = F.col("n_positive") + F.col("n_negative")
    energy = F.col("e_pos") + F.col("e_neg")
    out = out.withColumns({
        "positive_fraction": F.when(signed > 0, F.col("n_positive") / F.greatest(signed, F.lit(1))).otherwise(0.0),
        "positive_energy": F.when(energy > 0, F.col("e_pos") / F.when(energy > 0, energy).otherwise(1.0)).otherwise(0.0),
    })
    return out.withColumn("tail", tail_direction(F.col("skewness"), F.col("positive_energy")))


def tail_direction(skewness: Column, positive_energy: Column) -> Column:
    """A9, A49."""
    return F.when(skewness > 0, 1).when(skewness < 0, -1).when(positive_energy >= 0.5, 1).otherwise(-1).cast("long")


def kurtosis_ranks(stats: DataFrame, key: str = "component", by: str = "kurtosis") -> DataFrame:
    """Descending, ties by id. One row per component, so one partition does."""
    return stats.withColumn("kurtosis_rank", F.row_number().over(Window.orderBy(F.desc(by), key)).cast("long"))


def percentile_summary(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float] = tuple(k / 10 for k in range(11))) -> DataFrame:
    """Exact percentiles with linear interpolation, as an array, and the mean."""
    return df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in points])).alias("percentiles"), F.avg(value).alias("mean"))


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """A34."""
    v = F.col(value)
    points = (1, 5, 25, 50, 75, 95, 99, 99.9)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        population_skewness(v).alias("skewness"), population_excess(v).alias("kurtosis"), F.avg((v > 0).cast("double")).alias("frac_above_0"), F.avg((v > 1).cast("double")).alias("frac_above_1"),
        *[F.percentile(v, F.lit(p / 100)).alias("p" + str(p).replace(".", "_")) for p in points],
    )


def jarque_bera(df: DataFrame, key: str, value: str) -> DataFrame:
    """A64."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), population_skewness(F.col(value)).alias("skewness"), population_excess(F.col(value)).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4)
    return out.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2))


def token_concentration(df: DataFrame, token: str, value: str, q: float = 0.99, top: int = 10) -> DataFrame:
    """Over rows at or above the q-quantile: distinct tokens, effective number, share of the top."""
    edge = df.agg(F.percentile(value, F.lit(q)).alias("edge"))
    counts = df.crossJoin(F.broadcast(edge)).where(F.col(value) >= F.col("edge")).groupBy(token).agg(F.count("*").alias("n"))
    sums = counts.agg(F.count("*").alias("distinct_tokens"), F.sum("n").alias("all"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"))
    best = counts.orderBy(F.desc("n"), token).limit(top).agg(F.sum("n").alias("best"))
    return sums.crossJoin(F.broadcast(best)).select("distinct_tokens", F.exp(F.ln("all") - F.col("nlogn") / F.col("all")).alias("effective_tokens"), (F.col("best") / F.col("all")).alias("top_share"))


def quantile_calibration(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """A36."""
    edges = df.groupBy(key).agg(F.percentile(value, F.lit(q)).alias("threshold"))
    v, t = F.col(value), F.col("threshold")
    return df.join(edges, key).groupBy(key, "threshold").agg(F.avg(F.when(v < t, v)).alias("mean_below"), F.avg(F.when(v >= t, v)).alias("mean_above"), F.avg((v < t).cast("double")).alias("fraction_below"))


def coactivation(df: DataFrame, a: str, b: str, q: float) -> DataFrame:
    """Both, only a, only b, neither, by the q-quantiles of the two."""
    edges = df.agg(F.percentile(a, F.lit(q)).alias("qa"), F.percentile(b, F.lit(q)).alias("qb"))
    x, y = F.col(a) >= F.col("qa"), F.col(b) >= F.col("qb")
    group = F.when(x & y, "both").when(x, "only_a").when(y, "only_b").otherwise("neither")
    return df.crossJoin(F.broadcast(edges)).groupBy(group.alias("cell")).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))


def safe_corr(x: Column, y: Column) -> Column:
    """A27 as an aggregate: null for a constant side."""
    n, sx, sy = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)), F.sum(x), F.sum(y)
    cov = F.sum(x * y) / n - sx / n * sy / n
    vx, vy = F.sum(x * x) / n - sx / n * sx / n, F.sum(y * y) / n - sy / n * sy / n
    return F.when((F.max(x) > F.min(x)) & (F.max(y) > F.min(y)), cov / F.sqrt(F.greatest(vx * vy, F.lit(1e-300))))


def correlation_matrix(left: DataFrame, right: DataFrame, row: str = "row_id") -> DataFrame:
    """Left (row, a, x), right (row, b, y): correlation of every a with every b.

    The join is on the row, so it makes rows x |a| x |b| products; wide sides go through ``sum_pass``."""
    return left.join(right, row).groupBy("a", "b").agg(safe_corr(F.col("x"), F.col("y")).alias("correlation"))


def empirical_cdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A77."""
    return df.select(*keys, value, F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)).alias("fraction"))


def shared_histogram(df: DataFrame, key: str, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Fractions over even bins of the symmetric logarithm."""
    binned = df.select(key, even_bin(symlog(F.col(value)), lo, hi, bins).alias("bin")).where("bin is not null")
    counts = binned.groupBy(key, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def mean_density(df: DataFrame, group: str, member: str, value: str, bins: int = 50) -> DataFrame:
    """A histogram on [0, 1] per member, averaged over the members of a group; empty bins count."""
    per = df.select(group, member, even_bin(F.col(value), 0.0, 1.0, bins).alias("bin")).where("bin is not null").groupBy(group, member, "bin").agg(F.count("*").alias("n"))
    per = per.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy(group, member)))
    members = df.groupBy(group).agg(F.count_distinct(member).alias("members"))
    sums = per.groupBy(group, "bin").agg(F.sum("density").alias("total"))
    grid = members.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("bin", F.col("bin").cast("long"))
    return grid.join(sums, [group, "bin"], "left").select(group, "bin", (F.coalesce("total", F.lit(0.0)) / F.col("members")).alias("density"))


def overlap_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, quartiles, mean, extremes, shares above .90, .95, .99."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.75)).alias("q75"), F.min(v).alias("min"), F.max(v).alias("max"), *[F.avg((v >= t / 100).cast("double")).alias(f"frac_{t}") for t in (90, 95, 99)])


def mean_pairwise_cosine(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Mean over pairs of unit rows by (|sum|^2 - n) / (n (n - 1)); no pairs are formed."""
    unit = df.select(*keys, F.posexplode(vec).alias("k", "v"))
    sums = unit.groupBy(*keys, "k").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    return out.select(*keys, "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("n")) / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1))).alias("mean_cosine"))


def modal_grid_curve(df: DataFrame, curve: str, x: str, y: str) -> DataFrame:
    """Mean of the curves that lie on the most frequent grid of x."""
    curves = df.groupBy(curve).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(x)), lambda v: v.cast("string"))).alias("grid"))
    best = curves.groupBy("grid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grid").limit(1)
    return df.join(curves.join(F.broadcast(best), "grid").select(curve), curve).groupBy(x).agg(F.avg(y).alias("mean"))


def complete_panel(df: DataFrame, member: str, cells: Sequence[str]) -> DataFrame:
    """Members that stand in every cell (relational division)."""
    n = df.select(*cells).distinct().agg(F.count("*").alias("cells"))
    have = df.select(member, *cells).distinct().groupBy(member).agg(F.count("*").alias("have"))
    return have.crossJoin(F.broadcast(n)).where("have = cells").select(member)


def complete_pivot(df: DataFrame, member: str, column: str, value: str, columns: Sequence[int]) -> DataFrame:
    """Members as rows, the given cells as columns; members with a missing cell go."""
    return df.groupBy(member).pivot(column, list(columns)).agg(F.first(value)).dropna()


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Mean and its 2.5 % and 97.5 % bootstrap quantiles. Each row draws a Poisson(1) weight for
    each replicate from a hash, so the resamples need no index and no shuffle of rows."""
    rows = df.select(F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("id"))
    reps = rows.select("v", "id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    u = F.pmod(F.xxhash64(F.lit(seed), "id", "r"), F.lit(1 << 30)) / float(1 << 30)
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    w = sum((F.when(u >= c, 1).otherwise(0) for c in cdf), F.lit(0))
    means = reps.withColumn("w", w).groupBy("r").agg((F.sum(F.col("w") * F.col("v")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    q = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(q)


def top_tail_means(df: DataFrame, keys: Sequence[str], by: str, values: Sequence[str], q: float = 0.99) -> DataFrame:
    """Means over the rows above the q-quantile of ``by``."""
    edges = df.groupBy(*keys).agg(F.percentile(by, F.lit(q)).alias("edge"))
    return df.join(edges, list(keys)).where(F.col(by) > F.col("edge")).groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def grouped_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Moments, raw power means and the log-cosh mean for each (checkpoint, component), in one pass."""
    from ..functions.scalars import logcosh

    v = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v * v).alias("raw2"), F.avg(v * v * v * v).alias("raw4"), population_skewness(v).alias("skewness"), population_excess(v).alias("kurtosis"), F.avg(logcosh(v)).alias("logcosh"))


def excess_over_null(df: DataFrame, method: str, value: str, null: str) -> DataFrame:
    """Each method's summary beside that of the random null, and the excess of the means."""
    per = overlap_summary(df, [method], value)
    base = F.broadcast(per.where(F.col(method) == null).select(F.col("mean").alias("null_mean")))  # one row
    return per.crossJoin(base).withColumn("excess", F.col("mean") - F.col("null_mean"))


def symmetric_grid(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Pair values as a symmetric table with 1 on the diagonal."""
    runs = pairs.select(F.col(a).alias("r")).unionByName(pairs.select(F.col(b).alias("r"))).distinct()
    mean = pairs.groupBy(a, b).agg(F.avg(value).alias("v"))
    return mean.select(F.col(a).alias("row"), F.col(b).alias("col"), "v").unionByName(mean.select(F.col(b).alias("row"), F.col(a).alias("col"), "v")).unionByName(runs.select(F.col("r").alias("row"), F.col("r").alias("col"), F.lit(1.0).alias("v")))


def fallback_check(df: DataFrame, stored: str, recomputed: str, atol: float = 1e-7) -> DataFrame:
    """The stored metric where there is one, and whether it agrees with the recomputed one."""
    return df.withColumn("metric", F.coalesce(stored, recomputed)).withColumn("agrees", F.col(stored).isNull() | (F.abs(F.col(stored) - F.col(recomputed)) <= atol))
