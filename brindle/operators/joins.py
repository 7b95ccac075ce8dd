"""Join-shaped computations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import close


def by_row(left: DataFrame, right: DataFrame, row: str = "row_id") -> DataFrame:
    """What the position pairs, the key pairs."""
    return left.join(right, row)


def gather(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows with the given keys."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def unmatched(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner; a replay is right if there are none."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def held_out_documents(candidates: DataFrame, used: DataFrame, text: str = "text") -> DataFrame:
    """Candidates whose text is in none of the used documents, one for each distinct text (the
    least id). Only digests are joined."""
    digest = F.sha2(F.col(text), 256)
    c = candidates.withColumn("digest", digest)
    first = c.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return first.join(used.select(digest.alias("digest")).distinct(), "digest", "left_anti")


def fill_blank(rows: DataFrame, results: DataFrame, keys: Sequence[str], label: str, value: str, want: float, new: str) -> DataFrame:
    """Sets blank labels where the joined value equals ``want``."""
    out = rows.join(results, list(keys), "left")
    blank = F.coalesce(F.col(label), F.lit("")) == ""
    return out.withColumn(label, F.when(blank & (F.col(value) == want), F.lit(new)).otherwise(F.col(label)))


def keys_in_all(df: DataFrame, keys: Sequence[str], over: str) -> DataFrame:
    """Keys that stand with every value of ``over``."""
    n = df.agg(F.count_distinct(over).alias("all"))
    return df.groupBy(*keys).agg(F.count_distinct(over).alias("have")).crossJoin(F.broadcast(n)).where("have = all").select(*keys)


def pairs_on(df: DataFrame, attribute: str, key: str) -> DataFrame:
    """Pairs of rows with the same attribute, each once (lower key first)."""
    a, b = df.alias("a"), df.alias("b")
    return a.join(b, (F.col(f"a.{attribute}") == F.col(f"b.{attribute}")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))).select(F.col(f"a.{attribute}").alias(attribute), F.col(f"a.{key}").alias("base"), F.col(f"b.{key}").alias("source"))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str] = (), near: Sequence[str] = (), rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Field by field: rows on both sides, mismatches, largest error. A row that stands
    on one side only is a mismatch of every field."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in (*exact, *near)], F.lit(True).alias("in_l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in (*exact, *near)], F.lit(True).alias("in_r"))
    both = a.join(b, list(keys), "full_outer")
    there = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    fields = [F.struct(F.lit(c).alias("field"), (there & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias("ok"), F.lit(0.0).alias("error")) for c in exact]
    fields += [F.struct(F.lit(c).alias("field"), F.coalesce(there & close(F.col(f"l_{c}"), F.col(f"r_{c}"), rtol, atol), F.lit(False)).alias("ok"), F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")), F.lit(0.0)).alias("error")) for c in near]
    return both.select(F.explode(F.array(*fields)).alias("f")).select("f.*").groupBy("field").agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("mismatches"), F.max("error").alias("max_error"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """V2, V7, V8: rows that stand on one side only, with the side; multiplicities count."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def finite_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers of non-finite values for each column."""
    bad = lambda c: F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf"))
    return df.agg(*[F.count_if(bad(c)).alias(c) for c in columns])


def all_or_no_nulls(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Means of groups that are all filled or all null; others raise an error."""
    out = df.groupBy(*keys).agg(F.count(value).alias("have"), F.count("*").alias("n"), F.avg(value).alias("mean"))
    ok = (F.col("have") == 0) | (F.col("have") == F.col("n"))
    return out.withColumn("mean", F.when(ok, F.col("mean")).otherwise(F.raise_error(F.lit("some values are null")).cast("double"))).drop("have")
