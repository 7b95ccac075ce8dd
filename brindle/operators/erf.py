"""Effective receptive fields and auto-interpretability scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import edge_bin, geometric_midpoint
from .windows import cumulative_radius, first_recovery

#: Edges of the receptive-field bins.
EDGES = (1, 2, 3, 4, 8, 16, 32)


def suffix_recovery(scores: DataFrame, keys: Sequence[str], component: str, target: str, k: int, sign: int) -> DataFrame:
    """Rank by magnitude and sign of the target component at each suffix; recovered if within k."""
    from .windows import competition_rank

    ranked = scores.withColumn("rank", competition_rank(F.abs("score"), *keys))
    own = ranked.where(F.col(component) == F.col(target))
    good = (F.signum("score") == sign).alias("sign_ok")
    return own.select(*keys, "rank", good).withColumn("recovered", (F.col("rank") <= k) & F.col("sign_ok"))


def recovery_estimates(trials: DataFrame, keys: Sequence[str], length: str, ok: Column) -> DataFrame:
    """W13 with the estimate: the geometric middle of the bounds, exact if they are adjacent."""
    hit = first_recovery(trials, keys, length, ok)
    return hit.withColumn("estimate", geometric_midpoint(F.greatest("lower", F.lit(1)), F.col("upper"))).withColumn("exact", F.col("upper") - F.col("lower") == 1)


def component_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A57, A59."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.percentile(v, F.lit(0.5)).alias("median"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("recovered"), F.count("*").alias("tried"))


def gradient_statistics(df: DataFrame, keys: Sequence[str], distance: str, p: str) -> DataFrame:
    """Exp of the mean log distance, the mean distance and the radii of 50, 90 and 95 % of the mass."""
    d, w = F.col(distance), F.col(p)
    means = df.groupBy(*keys).agg(F.exp(F.sum(w * F.ln(d))).alias("geometric"), F.sum(w * d).alias("arithmetic"))
    return means.join(cumulative_radius(df, keys, distance, p, (0.5, 0.9, 0.95)), list(keys))


def field_histogram(df: DataFrame, value: str, edges: Sequence[float] = EDGES) -> DataFrame:
    """Counts per bin; absent bins are filled in."""
    counts = df.groupBy(edge_bin(F.col(value), edges).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, len(edges) + 1).withColumnRenamed("id", "bin")
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def expected_label(df: DataFrame, keys: Sequence[str], label: str, logprob: str) -> DataFrame:
    """Softmax over the candidates' log-probabilities, times the labels."""
    from pyspark.sql import Window

    top = F.max(logprob).over(Window.partitionBy(*keys))
    e = df.withColumn("__e", F.exp(F.col(logprob) - top))
    return e.groupBy(*keys).agg((F.sum(F.col("__e") * F.col(label)) / F.sum("__e")).alias("expected"))


def condition_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Completed, defined and undefined rows, and the mean of the defined; NaN is undefined."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("completed"), F.count_if(v.isNotNull() & ~F.isnan(v)).alias("defined"), F.count_if(v.isNull() | F.isnan(v)).alias("undefined"), F.avg(F.when(~F.isnan(v), v)).alias("mean"))
