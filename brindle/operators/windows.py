"""Ranks, running sums and windows.

Windows are partitioned by row, document or component. A running sum over a whole table is made
in two steps (range partitions, then their totals), so that no task holds the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def competition_rank(by: Column, *partition: str) -> Column:
    """1-based, ties share a rank."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(by.desc())).cast("long")


def ranks_of_retained(scores: DataFrame, retained: DataFrame, row: str = "row_id", component: str = "component", value: str = "score") -> DataFrame:
    """Ranks only in the rows that are retained; then only the retained pairs."""
    rows = scores.join(retained.select(row).distinct(), row, "left_semi").withColumn("rank", competition_rank(F.abs(value), row))
    return rows.join(retained.select(row, component), [row, component], "left_semi")


def top_per_key(df: DataFrame, k: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first k rows of each key. Spark keeps k rows per task and key before it
    shuffles (window group limit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rn") <= k)


def running_total(df: DataFrame, order: Sequence[str], value: Column, out: str = "running") -> DataFrame:
    """Inclusive running sum of ``value`` over the whole table in the order of the columns."""
    spark = df.sparkSession
    parts = stored(df.withColumn("__v", value).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__p", F.spark_partition_id()), "running")
    totals = parts.groupBy("__p").agg(F.sum("__v").alias("__s"))  # a row per partition
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("__p", before.alias("__before"))
    inside = F.sum("__v").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(totals), "__p").withColumn(out, inside + F.col("__before")).drop("__v", "__p", "__before")


def prefix_budget(docs: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """Documents in order until the budget is used up, with the number ``take`` that each gives;
    the last is cut to fit. ``short`` says that the corpus does not fill the budget."""
    run = running_total(docs, [order], F.col(size).cast("long"))
    before = F.col("running") - F.col(size)
    total = docs.agg((F.coalesce(F.sum(size), F.lit(0)) < budget).alias("short"))
    return run.where(before < budget).withColumn("take", F.least(F.col(size).cast("long"), budget - before)).crossJoin(F.broadcast(total))


def flat_index(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Position in the concatenation of all rows, from 0."""
    return running_total(df, order, F.lit(1).cast("long"), "flat").withColumn("flat", F.col("flat") - 1)


def flat_positions(tokens: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """W9 for positions that are counted from 0 in each document: only the documents' counts are summed
    up; tokens meet their document's offset."""
    counts = tokens.groupBy(doc).agg(F.count("*").alias("__n"))
    offsets = running_total(counts, [doc], F.col("__n")).select(doc, (F.col("running") - F.col("__n")).alias("__offset"))
    return tokens.join(offsets, doc).withColumn("flat", F.col("__offset") + F.col(pos)).drop("__offset")


def context_window(tokens: DataFrame, before: int, after: int, doc: str = "doc_id", pos: str = "pos", text: str = "token") -> DataFrame:
    """The texts around each token, joined, with the token's span in them (characters)."""
    w = Window.partitionBy(doc).orderBy(pos)
    around = F.collect_list(text).over(w.rowsBetween(-before, after))
    left = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(-before, -1)), F.lit(0)) if before else F.lit(0)
    return tokens.withColumn("context", F.concat_ws("", around)).withColumn("target_start", left.cast("long")).withColumn("target_end", (F.col("target_start") + F.length(text)).cast("long"))


def role_counters(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The how-manieth turn of its role each turn is."""
    return turns.withColumn("nth", F.count("*").over(Window.partitionBy(conv, role).orderBy(turn)).cast("long"))


def cumulative_radius(df: DataFrame, keys: Sequence[str], distance: str, p: str, shares: Sequence[float]) -> DataFrame:
    """Least distance within which the shares of the mass lie."""
    mass = df.withColumn("cum", F.sum(p).over(Window.partitionBy(*keys).orderBy(distance).rowsBetween(Window.unboundedPreceding, 0)))
    return mass.groupBy(*keys).agg(*[F.min(F.when(F.col("cum") >= q - 1e-12, F.col(distance))).alias(f"radius{round(q * 100)}") for q in shares])


def first_recovery(df: DataFrame, keys: Sequence[str], length: str, ok: Column) -> DataFrame:
    """The first length at which ``ok`` holds, and the last tried length below it."""
    w = Window.partitionBy(*keys).orderBy(length)
    steps = df.select(*keys, length, ok.alias("ok"), F.lag(length).over(w).alias("below"))
    return steps.groupBy(*keys).agg(F.min(F.when(F.col("ok"), F.struct(length, "below"))).alias("hit")).select(*keys, F.col(f"hit.{length}").alias("upper"), F.coalesce("hit.below", F.lit(0)).alias("lower"))


def running_sign(df: DataFrame, key: str, step: str, dot: str) -> DataFrame:
    """The sign carried forward over steps: the product of the signs of adjacent dot products."""
    s = F.when(F.coalesce(F.col(dot), F.lit(1.0)) < 0, 1).otherwise(0)
    flips = F.sum(s).over(Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("sign", F.when(flips % 2 == 1, -1).otherwise(1).cast("long"))


def adjacent_overlap(df: DataFrame, key: str, step: str, items: str) -> DataFrame:
    """Share of items kept from the step before, and shared with the last step."""
    w = Window.partitionBy(key).orderBy(step)
    last = F.last(items).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    prev = F.lag(items).over(w)
    k = F.greatest(F.size(items), F.lit(1))
    return df.withColumn("to_previous", F.when(prev.isNotNull(), F.size(F.array_intersect(items, prev)) / k)).withColumn("to_final", F.size(F.array_intersect(items, last)) / k)


def unique_document_top(df: DataFrame, doc: str, value: str, n: int) -> DataFrame:
    """The best row of each document, then the n best documents."""
    best = top_per_key(df, 1, [doc], [F.desc(value)]).drop("rn")
    return best.orderBy(F.desc(value), doc).limit(n)


def last_position(df: DataFrame, doc: str, pos: str) -> DataFrame:
    """The row of the last position of each document."""
    return df.withColumn("__last", F.max(pos).over(Window.partitionBy(doc))).where(F.col(pos) == F.col("__last")).drop("__last")


def peak_normalised(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Magnitudes over the key's largest, with the position of the peak."""
    w = Window.partitionBy(key)
    top = F.max(F.abs(value)).over(w)
    peak = F.min(F.when(F.abs(F.col(value)) == F.col("__top"), F.col(pos))).over(w)
    return df.withColumn("__top", top).withColumn("peak", peak).withColumn("share", F.when(F.col("__top") > 0, F.abs(value) / F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0)).otherwise(0.0)).drop("__top")


def standardised(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """By mean and sample standard deviation of the key's rows."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd).otherwise(1.0)))


def first_seen(df: DataFrame, item: str, pos: str) -> DataFrame:
    """Distinct items in the order of their first position."""
    return df.groupBy(item).agg(F.min(pos).alias("first_pos"))
