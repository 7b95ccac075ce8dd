"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token budget (shares by weight, capped at ``cap`` times its size, the excess
shared anew among the rest). Whole epochs of a source come first. What is left of its budget is
filled by weighted sampling without replacement: a document's key is an exponential variate
divided by its quality weight, documents are taken in the order of their keys, and the one that
crosses the budget gives as many words as are wanting.

The running sums are distributed: keys are cut into ``buckets`` ranges whose sums are added up
first, so that no task sees more than one range of one source. Draws follow from a hash of the id,
so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, store

#: Fixed values of the mix: weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Quality weights lie between this and 1; also evens out the ranges of keys.
LEAST_QUALITY = 0.25


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less by five times the share of markup symbols, at least LEAST_QUALITY."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(LEAST_QUALITY), 1.0 - 5.0 * symbols / F.greatest(n, F.lit(1))))


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: source, source_size. Adds the source's number ``sidx`` and its target.

    A source is capped exactly if its cap over its weight lies below the level at which the others
    use up the budget; so sorting by that ratio and taking the first level that fits does at once
    what sharing the excess again and again converges to."""
    everything = Window.partitionBy()
    sizes = sizes.withColumn("sidx", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sidx") % len(weights) + 1).cast("int")).cast("long")
    sizes = sizes.withColumn("weight", weight).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    by_ratio = everything.orderBy("ratio", "sidx")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    level = (total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    sizes = sizes.withColumns({"level": level, "place": F.row_number().over(by_ratio)})
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"]
    sizes = sizes.withColumn("at", F.coalesce(fits, F.lit(float("inf"))))
    return sizes.select("source", "source_size", "sidx", F.round(F.least(cap * F.col("source_size"), F.col("at") * F.col("weight")), 6).alias("target"))


def draws(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size and the sampling key of each row, kept compact."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return docs.select(
        "doc_id", "source", n_words(text).alias("size"), ((bits + 0.5) / float(2**48)).alias("u"), quality_weight(text).alias("quality")
    ).select("doc_id", "source", "size", (-F.ln("u") / F.col("quality")).alias("key"))


def mix_sources(docs: DataFrame, *, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and copies (whole takings)
    with part (words of a further, cut taking).

    Null text has no words; a null source is a source of its own, the last. Rows with equal keys
    (repeated ids) are ordered by id and size, rows that repeat wholly are interchangeable. A source
    without words has target 0. An empty table gives an empty result; other columns are not read.
    """
    rows = store(draws(docs, seed), "draws")
    plan = store(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights), "targets")
    left, right = rows.alias("r"), plan.alias("p")
    rows = left.join(right, F.col("r.source").eqNullSafe(F.col("p.source"))).select("doc_id", "size", "key", "source_size", "target", "sidx")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    # Monotone in the key; a range holds at most 1 / LEAST_QUALITY times its even part of the rows.
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") * LEAST_QUALITY)) * buckets), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumns({"epochs": epochs, "rest": budget - epochs * F.col("source_size"), "bucket": bucket})
    ranges = rows.groupBy("sidx", "bucket").agg(F.sum("size").alias("words"))
    start = F.sum("words").over(Window.partitionBy("sidx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    ranges = store(ranges.select("sidx", "bucket", start.alias("start")), "ranges")
    rows = rows.join(ranges, ["sidx", "bucket"])
    inside = F.sum("size").over(Window.partitionBy("sidx", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    extra = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start") - inside)).cast("long")
    rows = rows.withColumn("extra", extra)
    whole = F.col("epochs") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    part = F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"), whole.cast("long").alias("copies"), part.cast("long").alias("part"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken whole, and cut to its first
    ``part`` words where the budget ends within it; rows that are not taken go. All columns stay.

    Documents without words take no part. Rows that repeat an id are told apart by their size; where that is
    the same too, their takings are added up and dealt out: the copies as evenly as they go, and each cut
    taking to one of the rows, so that the mix has the planned words."""
    plan = mix_sources(docs, **options).groupBy("doc_id", "size").agg(F.sum("taken").alias("__taken"), F.sum("copies").alias("__copies"), F.collect_list(F.when(F.col("part") > 0, F.col("part"))).alias("__parts"), F.count("*").alias("__same"))
    plan = plan.where("__taken > 0").select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), "__copies", F.array_sort("__parts").alias("__parts"), "__same")
    own = docs.withColumn("__words", n_words(F.coalesce(F.col("text"), F.lit(""))))
    out = own.join(plan, own["doc_id"].eqNullSafe(plan["__id"]) & (own["__words"] == plan["__size"]))
    # rows that repeat are numbered; the window holds what repeats alone
    again = Window.partitionBy("__id", "__size").orderBy(F.xxhash64("text"))
    single = out.where("__same = 1").withColumn("__nth", F.lit(0).cast("long"))
    out = single.unionByName(out.where("__same > 1").withColumn("__nth", (F.row_number().over(again) - 1).cast("long")))
    mine = (F.floor(F.col("__copies") / F.col("__same")) + (F.col("__nth") < F.col("__copies") % F.col("__same")).cast("long")).cast("int")
    takes = F.concat(F.array_repeat(F.lit(0).cast("long"), mine), F.filter("__parts", lambda _, k: F.pmod(k.cast("long"), F.col("__same")) == F.col("__same") - 1 - F.col("__nth")))
    out = out.withColumn("__take", F.explode(takes))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("__take") > 0, F.concat_ws("", F.slice(words, F.lit(1), F.greatest(F.col("__take"), F.lit(1)).cast("int")))).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.when(F.col("__take") > 0, F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else out[c] for c in docs.columns])
