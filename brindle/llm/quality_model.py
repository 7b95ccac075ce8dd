"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Tokens are runs of letters (lower case; runs of capitals alone become one token of their own
besides), runs of digits (as one token) and single other characters. Features are hashed token
unigrams, bigrams and, for a token that follows itself, a repeat mark; a document is the vector
of their square-rooted counts, scaled to length 1, plus a constant.

The model is fitted on a bounded sample of labelled rows: the ``max_train`` rows with the least
hash of their id (a documented parameter). Their sparse vectors are made on the executors; one
task makes the updates and sends back the weights, 2**BITS floats whatever the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
MASK = (1 << BITS) - 1
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
CAPITALS, DIGITS, REPEAT, START = 1, 2, 3, 5
MAX_TRAIN, EPOCHS, THRESHOLD = 6000, 3, 0.7
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Tokens that one worker remembers.
CACHE = 100_000

_codes: dict[str, tuple[int, int]] = {}


def _code(token: str) -> tuple[int, int]:
    """A token's hash, and the hash of a mark that goes with it (0: none)."""
    import xxhash

    if token.isdigit():
        got = (DIGITS, 0)
    else:
        got = (xxhash.xxh32_intdigest(token.lower().encode()) | 8, CAPITALS if len(token) > 2 and token.isupper() else 0)
    if len(_codes) >= CACHE:
        _codes.clear()
    _codes[token] = got
    return got


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's vector; index 0 is the constant. Null counts as empty."""
    tokens = TOKEN.findall(text or "")
    known = _codes
    pairs = [known.get(t) or _code(t) for t in tokens]
    if not pairs:
        return np.zeros(1, np.int64), np.ones(1)
    both = np.array(pairs, dtype=np.uint64)
    uni, marks = both[:, 0], both[:, 1]
    before = np.empty_like(uni)
    before[0], before[1:] = START, uni[:-1]
    bi = before * np.uint64(0x9E3779B97F4A7C15) + uni * np.uint64(0xC2B2AE3D27D4EB4F)
    repeats = int(np.count_nonzero(before == uni))
    mixed = np.concatenate([uni * np.uint64(0x9E3779B97F4A7C15), bi, marks[marks > 0] * np.uint64(0xD6E8FEB86659FD93), np.full(repeats, REPEAT * 0x2545F4914F6CDD1D & (2**64 - 1), np.uint64)])
    idx, counts = np.unique(mixed >> np.uint64(64 - BITS), return_counts=True)
    values = np.sqrt(counts)
    values /= np.sqrt((values**2).sum())
    idx = idx.astype(np.int64)
    values = values[idx > 0]
    idx = idx[idx > 0]
    return np.concatenate([[0], idx]), np.concatenate([[1.0], values])


class Ftrl:
    """FTRL-proximal for the logistic loss over sparse vectors."""

    def __init__(self) -> None:
        self.z = np.zeros(MASK + 1)
        self.n = np.zeros(MASK + 1)

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, idx: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        g = (1 / (1 + np.exp(-float(np.clip(w @ x, -35, 35)))) - y) * x
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[idx] = n + g * g

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(MASK + 1)).astype(np.float32)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [vector(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], names=["rank", "y", "idx", "val"])


def _train(table: pa.Table) -> pa.Table:
    table = table.sort_by("rank")
    rows = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32), y.as_py()) for i, v, y in zip(table["idx"], table["val"], table["y"], strict=True)]
    model = Ftrl()
    for _ in range(EPOCHS):
        for idx, x, y in rows:
            model.update(idx, x, y)
    return pa.table({"weights": pa.array([model.all_weights().tobytes()], pa.binary())})


def train(docs: DataFrame, marks: DataFrame, *, label: str = "quality", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights fitted to the labels of rows whose fold is not 2. No rows with labels: all 0.

    The sample is picked by id, before any text is read; an id that is labelled twice counts twice."""
    order = F.md5(F.concat(F.lit("train:"), F.col("doc_id").cast("string")))
    picked = marks.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    picked = picked.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"), order.alias("rank")).orderBy("rank", "__id", "y").limit(max_train)
    own = docs.select(F.col("doc_id").alias("__doc"), "text")
    sample = own.join(F.broadcast(picked), F.col("__doc") == F.col("__id"))  # max_train rows at most
    vectors = sample.select("rank", "y", "text").mapInArrow(_vectors, "rank string, y int, idx binary, val binary")
    got = vectors.groupBy().applyInArrow(_train, "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros(MASK + 1, np.float32)


def scorer(weights: np.ndarray, spark) -> Column:
    """A function of a text column: the probability of label 1."""
    sent = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value
        for s in texts:
            out = np.empty(len(s))
            for k, t in enumerate(s):
                idx, x = vector(t)
                out[k] = w[idx] @ x
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def score_documents(docs: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text scores as the empty text. Repeated rows repeat. Without labels every score is 0.5. An
    empty table gives an empty result; only doc_id and text are read, and only text is scored."""
    score = scorer(train(docs, marks, **options), docs.sparkSession)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns stay."""
    score = scorer(train(docs, marks, **options), docs.sparkSession)
    return docs.withColumn("__score", score("text")).where(F.col("__score") >= THRESHOLD).drop("__score")
