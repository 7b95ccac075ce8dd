"""Deterministic sampling by hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_order


def sample_rows(df: DataFrame, n: int, key: str, seed: int | str = 0) -> DataFrame:
    """N rows without replacement: those with the least hash. Order and limit make a top-n per
    task first, so no task holds the table."""
    return df.withColumn("__h", hash_order(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def nested_samples(df: DataFrame, sizes: Sequence[int], key: str, seed: int | str = 0) -> DataFrame:
    """Growing samples that are prefixes of one another: the largest one, each row with the sizes of
    all samples that hold it."""
    top = sample_rows(df, max(sizes), key, seed).withColumn("__h", hash_order(seed, F.col(key)))
    rank = F.row_number().over(Window.orderBy("__h", key))
    return top.withColumn("rank", rank.cast("long")).withColumn("samples", F.filter(F.array(*[F.lit(s).cast("long") for s in sorted(sizes)]), lambda s: s >= F.col("rank"))).drop("__h")


def sample_per_key(df: DataFrame, n: int, keys: Sequence[str], key: str, seed: int | str = 0) -> DataFrame:
    """N rows of each group."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(seed, F.col(key)), key))
    return df.withColumn("rn", rn.cast("long")).where(F.col("rn") <= n)


def accept_until(df: DataFrame, ok: Column, n: int, key: str, seed: int | str = 0) -> DataFrame:
    """Candidates in hash order, accepted where ``ok``, until there are n."""
    return sample_rows(df.where(ok), n, key, seed)


def record_split(top: DataFrame, random: DataFrame, keys: Sequence[str], rank: str, each: int = 5) -> DataFrame:
    """Explanation rows are every fourth of the top list, held-out rows those two further on, random
    rows every third from the second; the first ``each`` of each kind. ``rank`` counts from 1."""
    r = F.col(rank)
    kind = F.when(F.pmod(r - 1, F.lit(4)) == 0, "explanation").when(F.pmod(r - 1, F.lit(4)) == 2, "held_out")
    a = top.withColumn("kind", kind).where("kind is not null")
    b = random.where(F.pmod(r - 1, F.lit(3)) == 1).withColumn("kind", F.lit("random"))
    both = a.unionByName(b)
    rn = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(rank))
    return both.withColumn("nth", rn.cast("long")).where(F.col("nth") <= each)


def random_fragments(docs: DataFrame, ids: str, length: int, key: str, seed: int | str = 0) -> DataFrame:
    """One window of ``length`` tokens per document that is long enough, its start drawn by hash."""
    room = F.size(ids) - length
    draw = F.conv(F.substring(hash_order(seed, F.col(key)), 1, 12), 16, 10).cast("long")
    start = F.pmod(draw, (F.greatest(room, F.lit(0)) + 1).cast("long"))
    return docs.where(F.size(ids) >= length).withColumn("start", start).withColumn("fragment", F.slice(ids, (F.col("start") + 1).cast("int"), length))


def band_samples(df: DataFrame, value: str, bands: Sequence[tuple[float, float]], n: int, key: str, seed: int | str = 0) -> DataFrame:
    """Half-open bands of a value: rows in each, and a sample of n in descending order."""
    v = F.col(value)
    band = F.coalesce(*[F.when((v >= lo) & (v < hi), F.lit(k)) for k, (lo, hi) in enumerate(bands)]).cast("long")
    rows = df.withColumn("band", band).where("band is not null")
    counts = rows.groupBy("band").agg(F.count("*").alias("n_band"))
    return sample_per_key(rows, n, ["band"], key, seed).join(F.broadcast(counts), "band").drop("rn")
