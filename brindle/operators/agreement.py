"""Agreement of two raters on the same keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import safe_corr
from .windows import running_total


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand on one side only, with the side; empty if the sets agree."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def rating_agreement(pairs: DataFrame, model: str, a: str, b: str, levels: int) -> DataFrame:
    """For all rows and for each model: exact and within-one shares, weighted kappas
    (linear, quadratic), in one pass over a table of (model, a, b) counts.

    Kappa is null where chance agreement is perfect."""
    cells = pairs.groupBy(model, a, b).agg(F.count("*").alias("n"))
    grouped = cells.groupingSets([[a, b], [model, a, b]], model, a, b).agg(F.sum("n").alias("n"), F.grouping(model).alias("is_all"))
    grouped = grouped.withColumn("grp", F.when(F.col("is_all") == 1, "all").otherwise(F.col(model).cast("string"))).drop(model)
    diff = F.abs(F.col(a) - F.col(b)).cast("double")
    top = float(levels - 1)
    observed = grouped.groupBy("grp").agg(F.sum("n").alias("total"), F.sum(F.when(diff == 0, F.col("n")).otherwise(0)).alias("exact"), F.sum(F.when(diff <= 1, F.col("n")).otherwise(0)).alias("near"), F.sum(F.col("n") * diff / top).alias("lin"), F.sum(F.col("n") * diff * diff / (top * top)).alias("quad"))
    left = grouped.groupBy("grp", a).agg(F.sum("n").alias("na"))
    right = grouped.groupBy("grp", b).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "grp").groupBy("grp").agg(F.sum(F.col("na") * F.col("nb") * diff / top).alias("clin"), F.sum(F.col("na") * F.col("nb") * diff * diff / (top * top)).alias("cquad"))
    kappa = lambda o, c: F.when(F.col(c) > 0, 1 - F.col(o) * F.col("total") / F.when(F.col(c) > 0, F.col(c)).otherwise(1.0))
    return observed.join(chance, "grp").select("grp", F.col("total").alias("n"), (F.col("exact") / F.col("total")).alias("exact"), (F.col("near") / F.col("total")).alias("within_one"), kappa("lin", "clin").alias("kappa_linear"), kappa("quad", "cquad").alias("kappa_quadratic"))


def binary_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """A31."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = pairs.agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select("n", "po", pe.alias("pe"), F.when(pe < 1, (F.col("po") - pe) / F.when(pe < 1, 1 - pe).otherwise(1.0)).alias("kappa"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """A29. Average ranks come from counts per distinct value, so that no task sorts all rows."""
    def ranks(c: str) -> DataFrame:
        counts = running_total(df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")), ["v"], F.col("n"))
        return counts.select(F.col("v").alias(c), (F.col("running") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    joined = df.select(x, y).join(ranks(x), x).join(ranks(y), y)
    return joined.agg(F.count("*").alias("n"), safe_corr(F.col(f"rank_{x}"), F.col(f"rank_{y}")).alias("spearman"))


def confidence_histogram(df: DataFrame, model: str, confidence: str, levels: int) -> DataFrame:
    """Counts and shares of 0..levels-1 for each model, absent levels filled in."""
    counts = df.groupBy(F.col(model).alias("model"), F.col(confidence).cast("long").alias("confidence")).agg(F.count("*").alias("n"))
    grid = df.select(F.col(model).alias("model")).distinct().withColumn("confidence", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(levels - 1).cast("long"))))
    totals = df.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("total"))
    return grid.join(counts, ["model", "confidence"], "left").join(totals, "model").select("model", "confidence", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"))
