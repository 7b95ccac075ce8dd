"""Personal data by bootstrapped contextual extraction.

Base spans (e-mail, IP address, payment card, phone) come from fixed patterns and are the seeds.
The words around seeds induce lexical patterns. A graph of patterns and instances, counted over
all documents, is scored in rounds: a pattern is as good for a kind as the share of its instances
that belong to the kind, an instance as good as its patterns together make it. Patterns with
enough support and confidence then mark further identifier-like tokens that no fixed pattern finds.

All base patterns are matched in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, store

KINDS = ("email", "ip", "card", "phone")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIM = "\"'()[]{}<>,;.!?"
#: A pattern counts from so many distinct instances of a kind and at this share of all its instances.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.8, 3
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign outwards: the run before it, not reaching into the last match, and the domain behind."""
    out, cursor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            cursor = m.end()
            at = text.find("@", cursor)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    if not _ANY.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _norm(word: str) -> str:
    return re.sub(r"[0-9]+", "0", word.strip(_TRIM).lower())


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode(), digest_size=8).digest(), "big", signed=True)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(kind or -1, start, end, instance, patterns) of the base spans and of the identifier-like
    tokens beside them. Patterns: the two words before; the words before and behind."""
    if not _ANY.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    spans = sorted((a, b) for _, a, b in base)
    reach, top = [], 0
    for _, b in spans:
        top = max(top, b)
        reach.append(top)
    found = list(base)
    for a, b in words:
        raw = text[a:b]
        body = raw.strip(_TRIM)
        if not _ANY.search(body):  # identifiers, as far as this operator goes, have a digit or an at sign
            continue
        lo = a + raw.index(body)
        k = bisect_left(spans, (lo + len(body), -1)) - 1
        if k >= 0 and reach[k] > lo:  # lies in a base span
            continue
        found.append((-1, lo, lo + len(body)))
    word = lambda k: _norm(text[words[k][0] : words[k][1]]) if 0 <= k < len(words) else ""
    out = []
    for kind, a, b in found:
        left, right = bisect_right(ends, a) - 1, bisect_left(starts, b)
        patterns = [_hash("L2", word(left - 1), word(left))] if left >= 1 else []
        patterns += [_hash("LR", word(left), word(right))] if left >= 0 and right < len(words) else []
        out.append((kind, a, b, _hash("I", text[a:b].lower()), patterns))
    return out


SCANNED = "doc_id bigint, h bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, found array<struct<kind:int,start:int,end:int,instance:bigint,patterns:array<bigint>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        base, found = [], []
        for t in batch.column("text"):
            text = t.as_py()
            spans = base_spans(text)
            for k in range(4):
                counts[k].append(sum(s[0] == k for s in spans))
            base.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans))
            found.append([dict(zip(("kind", "start", "end", "instance", "patterns"), m, strict=True)) for m in mentions(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(found, found_type)], names=["doc_id", "h", *[f"n_{k}" for k in KINDS], "base", "found"])


def score_graph(edges: DataFrame) -> DataFrame:
    """edges: pattern, instance, kind (-1: unknown), n. Returns pattern, kind, confidence of the
    patterns that can be relied on, after the last round.

    Counts are summed per pattern and instance before anything is joined; each round is two map-side
    aggregations and two equi-joins."""
    edges = store(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")), "edges")
    seeds = edges.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    known, good = store(seeds, "instances"), None
    for _ in range(ROUNDS):
        held = edges.select("pattern", "instance", "n").join(known, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count_if(F.col("score") >= 0.5).alias("support"))
        good = held.where(F.col("support") >= SUPPORT).join(totals, "pattern").select("pattern", "kind", F.round(F.col("mass") / F.col("total"), 9).alias("confidence")).where(F.col("confidence") >= CONFIDENCE)
        good = store(good, "patterns")
        doubt = edges.where("kind < 0").select("pattern", "instance").join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        known = store(seeds.unionByName(doubt), "instances")
    return good


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (base and added ones as kind:start:end, by kind, then start), n_added.

    Null text counts as empty. Repeated rows repeat. A token that patterns of several kinds mark gets
    the kind of the highest confidence, then the first. An empty table gives an empty result; other
    columns are not read."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = store(rows.mapInArrow(_scan, SCANNED), "scanned")
    each = rows.where(F.size("found") > 0).select("doc_id", "h", F.explode("found").alias("m")).select("doc_id", "h", "m.*").withColumn("pattern", F.explode("patterns"))
    good = score_graph(each.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")))
    marked = each.where("kind < 0").select("doc_id", "h", "start", "end", "pattern").join(small(good), "pattern")
    best = marked.groupBy("doc_id", "h", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (1 - F.col("b.k")).cast("int"))
    added = best.groupBy("doc_id", "h").agg(F.collect_list(F.struct((-F.col("b.k")).cast("int").alias("k"), F.col("start").cast("int").alias("s"), F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("t"))).alias("added"))
    r, a = rows.alias("r"), added.alias("a")
    out = r.join(a, F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.h") == F.col("a.h")), "left")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    own = F.transform(F.filter(F.split("base", ","), lambda t: t != ""), lambda t: F.struct((F.array_position(kinds, F.split(t, ":")[0]) - 1).cast("int").alias("k"), F.split(t, ":")[1].cast("int").alias("s"), t.alias("t")))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat_ws(",", F.transform(F.array_sort(F.concat(own, "added")), lambda x: x["t"])))
    return out.select("r.doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).alias("n_added"))
