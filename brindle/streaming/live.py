"""Running statistics, top-k and event windows over streams (A3, L2).

State is bounded: moments hold five numbers a key, top-k holds k rows a key, and event windows are
dropped behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """A3 over a stream (complete or update mode): count, mean, variance, skewness, excess kurtosis."""
    v = F.col(value)
    return stream.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.coalesce(F.skewness(v), F.lit(0.0)).alias("skewness"), F.coalesce(F.kurtosis(v), F.lit(0.0)).alias("kurtosis"))


def streaming_topk(stream: DataFrame, key: str, row: str, value: str, k: int) -> DataFrame:
    """L2 over a stream (update mode): after each batch, the k rows with the largest magnitudes so far of
    every key that the batch touched."""
    schema = f"{key} bigint, {row} bigint, {value} double, rank bigint"

    def step(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, vals = state.get if state.exists else ([], [])
        held = list(zip(ids, vals, strict=True))
        for pdf in batches:
            held += list(zip(pdf[row].tolist(), pdf[value].tolist(), strict=True))
            held = sorted(set(held), key=lambda x: (-abs(x[1]), x[0]))[:k]
        state.update(([i for i, _ in held], [v for _, v in held]))
        yield pd.DataFrame({key: [keys[0]] * len(held), row: [i for i, _ in held], value: [v for _, v in held], "rank": range(1, len(held) + 1)})

    return stream.select(F.col(key).cast("long"), F.col(row).cast("long"), F.col(value).cast("double")).groupBy(key).applyInPandasWithState(step, schema, "ids array<bigint>, vals array<double>", "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, key: str, value: str, *, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding event windows behind a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, ts: str, user: str, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


def deduplicated(stream: DataFrame, ts: str, key: str, *, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table in memory; for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
