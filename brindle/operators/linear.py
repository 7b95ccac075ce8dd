"""Passes over wide vector rows: matrix products and summed partials.

A pass is one ``mapInArrow`` over the vector column. Products keep the other columns; sums send one
partial per task, added up in a fixed order, so results do not depend on scheduling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matrix_of(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a float64 matrix; rows of different widths are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    n = len(column)
    if n == 0:
        return np.zeros((0, width or 0))
    if len(flat) % n or (width is not None and len(flat) != n * width):
        raise ValueError("vectors differ in width")
    offsets = column.offsets.to_numpy()
    if not (np.diff(offsets) == len(flat) // n).all():
        raise ValueError("vectors differ in width")
    return flat.reshape(n, -1)


def normalised(x: np.ndarray, pre_center: np.ndarray | None, l2: bool, eps: float = 1e-12) -> np.ndarray:
    """The fixed order of preparation: subtract the pre-center, then scale rows to length 1."""
    if not np.isfinite(x).all():
        raise ValueError("vectors hold a non-finite element")
    if pre_center is not None:
        x = x - pre_center
    if l2:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps)
    return x


def apply_linear(df: DataFrame, matrix: np.ndarray, *, vec: str = "vec", out: str = "scores", offset: np.ndarray | None = None, shift: np.ndarray | None = None, pre_center: np.ndarray | None = None, l2: bool = False) -> DataFrame:
    """Adds ``out`` = (prepare(vec) - offset) @ matrix.T + shift; other columns stay. The matrix
    is sent once to each executor; its size is K x d, whatever the number of rows."""
    sent = df.sparkSession.sparkContext.broadcast((np.asarray(matrix, float), offset, shift, pre_center))
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept]).add(out, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, off, add, pre = sent.value
        for batch in batches:
            x = normalised(matrix_of(batch.column(batch.schema.get_field_index(vec)), m.shape[1]), pre, l2)
            y = (x if off is None else x - off) @ m.T
            if add is not None:
                y = y + add
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * m.shape[0])
            col = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(y).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], col], names=[*kept, out])

    return df.mapInArrow(run, schema)


def sum_pass(df: DataFrame, partial: Callable[[np.ndarray], Sequence[np.ndarray]], *, vec: str = "vec", fan_in: int = 64) -> list[np.ndarray]:
    """Adds up ``partial(matrix)``, a fixed number of arrays of fixed shapes, over all rows.

    Partials of up to ``fan_in`` tasks are added on an executor before the driver sees them, in the
    order of the tasks; the driver holds (tasks / fan_in) of them at most."""
    tagged = df.select(F.spark_partition_id().alias("pid"), F.col(vec).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        pid = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            pid = batch.column(0)[0].as_py()
            got = [np.asarray(a, float) for a in partial(matrix_of(batch.column(1)))]
            total = got if total is None else [t + g for t, g in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int64()), pa.array([[t.tobytes() for t in total]], pa.list_(pa.binary())), pa.array([[list(t.shape) for t in total]], pa.list_(pa.list_(pa.int64())))], names=["pid", "parts", "shapes"])

    schema = "pid bigint, parts array<binary>, shapes array<array<bigint>>"
    rows = tagged.mapInArrow(run, schema)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        sums = None
        for parts in table["parts"].to_pylist():
            got = [np.frombuffer(p) for p in parts]
            sums = got if sums is None else [s + g for s, g in zip(sums, got, strict=True)]
        return pa.table({"pid": pa.array(table["pid"][:1].to_pylist(), pa.int64()), "parts": pa.array([[s.tobytes() for s in sums]], pa.list_(pa.binary())), "shapes": pa.array(table["shapes"][:1].to_pylist(), pa.list_(pa.list_(pa.int64())))})

    if df.rdd.getNumPartitions() > fan_in:
        rows = rows.withColumn("g", F.floor(F.col("pid") / fan_in)).groupBy("g").applyInArrow(add, schema)
    out: list[np.ndarray] = []
    for r in sorted(rows.collect(), key=lambda r: r["pid"]):
        got = [np.frombuffer(bytes(p)).reshape([int(k) for k in s]) for p, s in zip(r["parts"], r["shapes"], strict=True)]
        out = got if not out else [a + b for a, b in zip(out, got, strict=True)]
    return out
