"""Audits and replays."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preflight(left: Mapping, right: Mapping, fields: Sequence[str]) -> list[str]:
    """V1: fields in which two provenance records differ or that are absent."""
    return [f for f in fields if f not in left or f not in right or left[f] != right[f]]


def run_checks(checks: Mapping[str, Callable[[], object]]) -> list[dict]:
    """Runs each check; a raised error or a false value is a failure. All are run."""
    out = []
    for name, check in checks.items():
        began = time.time()
        try:
            got = check()
            status, note = ("passed", "") if got in (None, True) else ("failed", str(got))
        except Exception as e:  # a check may fail in any way
            status, note = "failed", f"{type(e).__name__}: {e}"
        out.append({"name": name, "status": status, "note": note, "seconds": time.time() - began})
    return out


def stored_mean_check(rows: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, atol: float = 1e-7) -> DataFrame:
    """Stored means against recomputed ones."""
    again = rows.groupBy(*keys).agg(F.avg(value).alias("recomputed"))
    return stored.join(again, list(keys), "full_outer").withColumn("ok", F.coalesce(F.abs(F.col(value) - F.col("recomputed")) <= atol, F.lit(False)))


def same_setting(records: Sequence[DataFrame], keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each key, whether all records agree in all fields; keys missing somewhere do not agree."""
    tagged = [r.select(*keys, *fields).withColumn("__src", F.lit(k)) for k, r in enumerate(records)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    agree = F.lit(True)
    out = rows.groupBy(*keys).agg(F.count_distinct("__src").alias("have"), *[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f"n_{f}") for f in fields])
    for f in fields:
        agree = agree & (F.col(f"n_{f}") == 1)
    return out.select(*keys, (agree & (F.col("have") == len(records))).alias("agree"))


def nested_audit(df: DataFrame, sizes: Sequence[int], rank: str = "rank") -> DataFrame:
    """Counts and distinct ranks of each nested sample; each must hold exactly the ranks up to its size."""
    each = df.select(F.explode("samples").alias("size"), rank).where(F.col("size").isin(list(sizes)))
    return each.groupBy("size").agg(F.count("*").alias("n"), F.count_distinct(rank).alias("n_distinct"), F.max(rank).alias("top")).withColumn("ok", (F.col("n") == F.col("size")) & (F.col("n_distinct") == F.col("n")) & (F.col("top") == F.col("size")))


def merge_methods(parts: Sequence[DataFrame], method: str, tokens: str) -> DataFrame:
    """Union of result tables with disjoint methods and equal token counts; others raise an error."""
    rows = parts[0].withColumn("__src", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("__src", F.lit(k)))
    told = rows.agg(F.count_distinct(tokens).alias("t"))
    shared = rows.groupBy(method).agg(F.count_distinct("__src").alias("s")).agg(F.coalesce(F.max("s"), F.lit(0)).alias("s"))
    ok = rows.crossJoin(F.broadcast(told)).crossJoin(F.broadcast(shared))
    return ok.withColumn(method, F.when((F.col("t") <= 1) & (F.col("s") <= 1), F.col(method)).otherwise(F.raise_error(F.lit("methods overlap or token counts differ")).cast("string"))).drop("t", "s", "__src")


def field_bounds(df: DataFrame, value: str, content: str) -> DataFrame:
    """Estimates must lie between 1 and the number of content tokens."""
    return df.agg(F.count("*").alias("n"), F.count_if((F.col(value) < 1) | (F.col(value) > F.col(content))).alias("outside"), F.avg(value).alias("mean"))
