"""Exact deduplication over a cuckoo-filter index of live digests.

Each document is known by the SHA-256 of its text. An index holds the digests of the documents
that stay so far: a cuckoo filter (16-bit fingerprints, two candidate buckets of four) answers
most lookups; a hit is checked against the entry stored in that slot of the bucket: the full digest, which
is what equality of texts means here, beside the payload. There is no other map. When a later
copy with a larger id arrives, the older live entry is deleted and the new one inserted. If an
insertion cannot find a place, the filter is built anew at twice the size from the stored keys.

Every task first indexes its own rows, so that at most one entry for each digest and task is
shuffled however many copies there are; then the entries of each digest range are indexed
together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, store


class CuckooIndex:
    """Digest -> payload. ``slots`` hold fingerprints, ``content`` the digest and payload behind each."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 1024):
        self.n = 1
        while self.n * self.SLOTS * 0.9 < capacity:
            self.n *= 2
        self._clear()

    def _clear(self) -> None:
        self.slots = [[0] * self.SLOTS for _ in range(self.n)]
        self.content: list[list[tuple[bytes, tuple] | None]] = [[None] * self.SLOTS for _ in range(self.n)]
        self.held = 0

    def _mark(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        """Bucket and slot of a digest; fingerprints that fit are checked against the stored digests."""
        mark, a, b = self._mark(digest)
        for bucket in (a, b):
            if mark in self.slots[bucket]:
                for k in range(self.SLOTS):
                    if self.slots[bucket][k] == mark and self.content[bucket][k][0] == digest:
                        return bucket, k
        return None

    def get(self, digest: bytes) -> tuple | None:
        at = self._find(digest)
        return self.content[at[0]][at[1]][1] if at else None

    def delete(self, digest: bytes) -> bool:
        at = self._find(digest)
        if at is None:
            return False
        self.slots[at[0]][at[1]], self.content[at[0]][at[1]] = 0, None
        self.held -= 1
        return True

    def insert(self, digest: bytes, payload: tuple) -> None:
        """Adds a digest that is not in the index."""
        left = self._place(digest, payload)
        self.held += 1
        if left is not None:
            self._grow(left)

    def _place(self, digest: bytes, payload: tuple) -> tuple[bytes, tuple] | None:
        """Stores an entry; others may be moved. None, or the entry that found no place in the end."""
        mark, a, b = self._mark(digest)
        entry = (digest, payload)
        for bucket in (a, b):
            for k in range(self.SLOTS):
                if self.slots[bucket][k] == 0:
                    self.slots[bucket][k], self.content[bucket][k] = mark, entry
                    return None
        bucket = a
        for kick in range(self.KICKS):
            k = kick % self.SLOTS
            mark, self.slots[bucket][k] = self.slots[bucket][k], mark
            entry, self.content[bucket][k] = self.content[bucket][k], entry
            bucket = self._other(bucket, mark)
            if 0 in self.slots[bucket]:
                k = self.slots[bucket].index(0)
                self.slots[bucket][k], self.content[bucket][k] = mark, entry
                return None
        return entry

    def _grow(self, left: tuple[bytes, tuple]) -> None:
        """Built anew at twice the size, and again if need be, from the stored entries and ``left``."""
        entries = [*self.items(), left]
        while True:
            self.n *= 2
            self._clear()
            if all(self._place(*e) is None for e in entries):
                self.held = len(entries)
                return

    def __len__(self) -> int:
        return self.held

    def items(self):
        return [e for bucket in self.content for e in bucket if e is not None]


def _later(a: tuple, b: tuple) -> bool:
    """Whether id a supersedes id b; a row without id never does."""
    return a[0] is not None and (b[0] is None or a[0] > b[0])


def _add(index: CuckooIndex, digest: bytes, entry: tuple) -> None:
    """entry: doc_id, copies."""
    live = index.get(digest)
    if live is None:
        index.insert(digest, entry)
        return
    both = live[1] + entry[1]
    index.delete(digest)
    index.insert(digest, (entry[0] if _later(entry, live) else live[0], both))


ENTRY = "digest binary, keep_id bigint, copies bigint"
#: Digests that a map task holds before it passes its entries on; bounds its memory.
MAP_ENTRIES = 200_000


def _flush(index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.items())
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([p[0] for _, p in rows], pa.int64()), pa.array([p[1] for _, p in rows], pa.int64())], names=["digest", "keep_id", "copies"])


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for d, i, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            _add(index, d, (i, c))
            if len(index) >= MAP_ENTRIES:
                yield _flush(index)
                index = CuckooIndex()
    if len(index):
        yield _flush(index)


def _index_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by digest, so all entries below the one at hand are final: they leave the
    index, whose size stays bounded."""
    index = CuckooIndex()
    for batch in batches:
        last = None
        for d, i, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            _add(index, d, (i, c))
            last = d
        if len(index) >= MAP_ENTRIES and last is not None:
            held = index.get(last)
            index.delete(last)
            if len(index):
                yield _flush(index)
            index = CuckooIndex()
            index.insert(last, held)
    if len(index):
        yield _flush(index)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and SHA-256 of the text as it is (null: empty)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))


def survivors(digest_rows: DataFrame) -> DataFrame:
    """One row per digest: the largest doc_id (keep_id) and the number of copies."""
    rows = digest_rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    n = int(digest_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(_index_batches, ENTRY).repartition(n, "digest").sortWithinPartitions("digest").mapInArrow(_index_sorted, ENTRY)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the largest doc_id stays; null ids come last, and
    keep_id is null if a group has no other. Of rows that repeat both id and text exactly one is
    kept. An empty table gives an empty result; other columns are not read.
    """
    rows = store(digests(docs), "digests")
    kept = survivors(rows)
    # Repeated rows have no order; they are counted and dealt out again, the first as kept.
    each = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("same"))
    out = each.join(kept, "digest").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "same")))
    return out.select("doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies, all columns kept; what stays is as in ``dedup_documents``.

    Only ids and digests are shuffled, unless the rows to go are too many to broadcast."""
    rows = store(digests(docs), "digests")
    groups = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("same"))
    marked = store(groups.join(survivors(rows), "digest").select("doc_id", "digest", "same", (~F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("goes")), "copies")
    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    own = docs.withColumns({"__digest": key, "__id": F.col("doc_id").cast("long")})
    on = lambda right: own["__id"].eqNullSafe(right["__i"]) & (own["__digest"] == right["__d"])
    gone = small(marked.where("goes or same > 1").select(F.col("doc_id").alias("__i"), F.col("digest").alias("__d")), 300_000)
    single = own.join(gone, on(gone), "left_anti").drop("__digest", "__id")
    twice = marked.where("not goes and same > 1").select(F.col("doc_id").alias("__i"), F.col("digest").alias("__d"))
    if twice.isEmpty():
        return single
    again = small(twice, 300_000)
    first = own.join(again, on(again), "left_semi").groupBy("__digest", "__id").agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return single.unionByName(first)
