"""Encoders and reconstruction.

Wide rows go through matrix passes; curves over many budgets are made batch by batch, each task
sending one partial row for each budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import matrix_of


@dataclass
class Dictionary:
    """Encoder [K, d], decoder [K, d], their biases. kind: linear, relu, topk or threshold."""

    encoder: np.ndarray
    decoder: np.ndarray
    encoder_bias: np.ndarray | float = 0.0
    decoder_bias: np.ndarray | float = 0.0
    kind: str = "linear"
    k: int | None = None
    threshold: np.ndarray | float = 0.0
    subtract_bias: bool = False
    scale_norms: bool = False

    def encode(self, x: np.ndarray) -> np.ndarray:
        """P16, P19-P25."""
        z = (x - self.decoder_bias if self.subtract_bias else x) @ self.encoder.T + self.encoder_bias
        if self.kind == "relu":
            z = np.maximum(z, 0)
        elif self.kind == "threshold":
            z = np.where(z > self.threshold, z, 0.0)
        elif self.kind == "topk":
            z = keep_rows(np.maximum(z, 0), np.abs(z) * (z > 0), self.k or z.shape[1])
        return z * np.linalg.norm(self.decoder, axis=1) if self.scale_norms else z

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """P17."""
        if self.scale_norms:
            codes = codes / np.maximum(np.linalg.norm(self.decoder, axis=1), 1e-12)
        return codes @ self.decoder + self.decoder_bias


def oriented(reading: np.ndarray, writing: np.ndarray, tails: np.ndarray, center: np.ndarray | None = None) -> Dictionary:
    """Components turned towards their tails, negative scores cut off, scaled by the norms of
    the decoder rows, which then have length 1."""
    norms = np.linalg.norm(writing, axis=0)
    c = np.zeros(reading.shape[1]) if center is None else center
    return Dictionary(reading * (tails * norms)[:, None], (writing * (tails / np.maximum(norms, 1e-12))).T, -(reading @ c) * tails * norms, c, "relu")


def split_sign_dictionary(reading: np.ndarray, writing: np.ndarray, center: np.ndarray | None = None) -> Dictionary:
    """Each direction as two non-negative features; the decoding is exact."""
    norms = np.maximum(np.linalg.norm(writing, axis=0), 1e-12)
    enc, dec = reading * norms[:, None], (writing / norms).T
    c = np.zeros(reading.shape[1]) if center is None else center
    both = np.concatenate([enc, -enc])
    return Dictionary(both, np.concatenate([dec, -dec]), -(both @ c), c, "relu")


def untrained(width: int, features: int, k: int, seed: int) -> Dictionary:
    """Tied random unit rows with the sparsity of a trained dictionary."""
    w = np.random.default_rng(seed).standard_normal((features, width))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return Dictionary(w, w, kind="topk", k=k)


def keep_rows(codes: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The k entries of each row with the largest weight, ties to the lower index."""
    if k >= codes.shape[1]:
        return codes
    order = np.argsort(-weight, axis=1, kind="stable")[:, :k]
    out = np.zeros_like(codes)
    np.put_along_axis(out, order, np.take_along_axis(codes, order, axis=1), axis=1)
    return out


def apply_dictionary(df: DataFrame, d: Dictionary, *, vec: str = "vec", out: str = "codes", decode: bool = False, ablate: int | None = None) -> DataFrame:
    """Adds codes, or with ``decode`` their reconstruction. With ``ablate`` the strongest codes of each row
    are cut out and what the dictionary cannot express is kept (P28)."""
    sent = df.sparkSession.sparkContext.broadcast(d)
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept]).add(out, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = sent.value
        for batch in batches:
            x = matrix_of(batch.column(batch.schema.get_field_index(vec)), d.encoder.shape[1])
            y = d.encode(x)
            if ablate is not None:
                y = x + d.decode(y - keep_rows(y, np.abs(y), ablate)) - d.decode(y)
            elif decode:
                y = d.decode(y)
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(y).ravel()))], names=[*kept, out])

    return df.mapInArrow(run, schema)


def reconstruction_curve(df: DataFrame, d: Dictionary, budgets: Sequence[int], *, vec: str = "vec", method: str = "method") -> DataFrame:
    """For each budget the mean squared error over the squared norm, the mean cosine and the
    codes in use. Codes are picked by magnitude times the length of their decoder row; the full width is
    always the last budget."""
    ks = sorted({k for k in budgets if k < d.encoder.shape[0]} | {d.encoder.shape[0]})
    sent = df.sparkSession.sparkContext.broadcast(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = sent.value
        sums = np.zeros((len(ks), 4))
        norms = np.linalg.norm(d.decoder, axis=1)
        for batch in batches:
            x = matrix_of(batch.column(0), d.encoder.shape[1])
            if len(x) == 0:
                continue
            codes = d.encode(x)
            size = np.maximum((x * x).sum(axis=1), 1e-12)
            for j, k in enumerate(ks):
                kept = keep_rows(codes, np.abs(codes) * norms, k)
                y = d.decode(kept)
                cos = (x * y).sum(axis=1) / np.maximum(np.sqrt(size) * np.linalg.norm(y, axis=1), 1e-12)
                sums[j] += [len(x), (((x - y) ** 2).sum(axis=1) / size).sum(), cos.sum(), (kept != 0).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), *[pa.array(sums[:, c]) for c in range(4)]], names=["k", "n", "e", "c", "u"])

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "k bigint, n double, e double, c double, u double").where("n > 0")
    s = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in "necu"])
    return s.select(F.lit(method).alias("method"), "k", (F.col("u") / F.col("n")).alias("effective_k"), (F.col("e") / F.col("n")).alias("nmse"), (F.col("c") / F.col("n")).alias("cosine"))


def cross_dataset_mean(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unweighted mean over datasets."""
    return rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def collapse_saturated(points: list[tuple[float, float]], within: float = 0.03) -> list[tuple[float, float]]:
    """Neighbouring points whose effective budgets differ by less than ``within`` become one."""
    out: list[list[tuple[float, float]]] = []
    for p in sorted(points):
        if out and p[0] <= out[-1][0][0] * (1 + within):
            out[-1].append(p)
        else:
            out.append([p])
    return [(sum(x for x, _ in g) / len(g), sum(y for _, y in g) / len(g)) for g in out]


def masked_mean(tokens: DataFrame, doc: str, vec: str) -> DataFrame:
    """Mean of each document's token vectors, all-zero ones left out; without any, zeros."""
    long = tokens.withColumn("__on", F.exists(vec, lambda x: x != 0)).select(doc, "__on", F.posexplode(vec).alias("k", "v"))
    sums = long.groupBy(doc, "k").agg(F.sum(F.when(F.col("__on"), F.col("v")).otherwise(0.0)).alias("s"), F.count_if("__on").alias("n"))
    return sums.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("s") / F.greatest("n", F.lit(1))).alias("m")))), lambda x: x["m"]).alias("mean"))


def class_contrast(scores: DataFrame, label: str, target, source, k: int, component: str = "component", value: str = "score") -> DataFrame:
    """Components by the difference of their class means, largest magnitudes first."""
    from pyspark.sql import Window

    diff = scores.where(F.col(label).isin(target, source)).groupBy(component).agg((F.avg(F.when(F.col(label) == target, F.col(value))) - F.avg(F.when(F.col(label) == source, F.col(value)))).alias("contrast"))
    return diff.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("contrast")), component)).cast("long")).where(F.col("rank") <= k)


def dead_features(codes: DataFrame, feature: str, value: str) -> DataFrame:
    """Features that are never above 0."""
    return codes.groupBy(feature).agg(F.max(value).alias("top")).where("top <= 0").select(feature)


def perturbation_norms(rows: DataFrame, doc: str, vec: str, changed: str) -> DataFrame:
    """Absolute and relative size of a change per token, and for the pooled document."""
    from ..functions import vectors as V

    d = rows.select(doc, V.norm(V.subtract(F.col(changed), F.col(vec))).alias("size"), V.norm(F.col(vec)).alias("own"))
    return d.groupBy(doc).agg(F.avg("size").alias("absolute"), F.avg(F.col("size") / F.greatest("own", F.lit(1e-12))).alias("relative"), F.avg((F.col("size") > 0).cast("double")).alias("changed"), (F.sqrt(F.sum(F.col("size") * F.col("size"))) / F.greatest(F.sqrt(F.sum(F.col("own") * F.col("own"))), F.lit(1e-12))).alias("pooled_relative"))
