"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, comp: the smallest node that each node reaches.

    Every step is a map-side aggregation and an equi-join, written to the shared folder; nothing is
    gathered per node. Self-links and repeated links do no harm; no links give no rows."""
    edges = store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    state = None
    while True:
        told = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == state or told[0] == 0:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp"))).distinct()
        state = told
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = store(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct(), "large-star")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        edges = store(small.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "small-star")
