"""The tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide form: row_id, label, vec."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


def long_scores(wide: DataFrame, vec: str = "vec") -> DataFrame:
    """Long form: the other columns, component (from 0) and score."""
    others = [c for c in wide.columns if c != vec]
    return wide.select(*others, F.posexplode(vec).alias("component", "score")).withColumn("component", F.col("component").cast("long"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_scores(vectors(spark, sf_dir))
