"""N-gram Jaccard join by partitioning the universe of shingles.

A document is the set of its 5-word shingles, as 64-bit hashes. Two documents with Jaccard
similarity of 0.8 or more differ in at most H = floor((|r| + |s|) / 9) shingles. Sizes are cut
into bands; a band's shingles are hashed into m segments, and at most H of them can differ between
two linked documents.

* Segment subsets: under a fixed order of segment contents, two documents that agree on all but H
  of m segments share one of the first H + 1 of each. So each document is indexed under its H + 1
  cheapest segments only. The cost of a segment is the estimated number of documents that hold it
  (that of its rarest shingle), then its size; empty segments come last.
* One-deletion neighbourhoods: where H is 1, the set is one segment, indexed as it is and with
  each single shingle left out. ``allocate`` picks for each band the cheaper of the two forms.

Documents that share a signature are candidates. Copies (equal sets) are folded into one. Each document
is first verified against one leader, the most popular document that it shares a signature with. Where
documents that share a signature are still apart, they are compared in blocks, all against all, so no
link that could join two components is lost and no pair is ever a row of its own.
Verification compares whole sets.

The shuffle carries packed signatures, 16 bytes each, in one row per batch and part.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_parts, released, small, store
from .components import components
from .shingles import mix, overlap, shingle_set

#: 100 * intersection >= 80 * union.
PERCENT = 80
#: Shingles that a batch holds LOCAL_HOT times are counted over all batches; those with HOT_MIN or
#: more are priced. The table is a hint for costs; it holds the HOT_MAX most frequent (16 MB).
LOCAL_HOT, HOT_MIN, HOT_MAX = 3, 50, 1_000_000
#: Shingles counted at once, and signatures packed at once, by a task; bounds its memory.
COUNT_AT_ONCE, PACK_AT_ONCE = 1_500_000, 400_000
#: Shingles in a block of what is verified all against all.
BLOCK_SHINGLES = 400_000
#: Segments of a band over its upper limit.
SEGMENTS = 0.35
#: A signature expected in more documents than this is dealt to several parts.
SALT_ROWS = 500_000

_U = np.uint64


def band(n: int) -> tuple[int, int, int]:
    """Number and limits [lo, hi) of the size band of n >= 4: 4-7, 8-31, 32-127, ..."""
    if n < 8:
        return 0, 4, 8
    k = (n.bit_length() - 4) // 2
    return k + 1, 8 * 4**k, 32 * 4**k


def allocate(lo: int, hi: int) -> tuple[str, int]:
    """("delete", 1) or ("subset", m) for a band. The cost of a form is the number of rows that a
    document of middling size sends, each weighted by the chance candidates it brings, which fall
    with the number of shingles behind a row."""
    n = (lo + hi) // 2
    most = (hi - 1 + hi - 1) // 9
    segments = max(most + 1, math.ceil(SEGMENTS * hi))
    price = lambda rows, held: rows * (1 + 16 * 0.25**held)
    subset = price((2 * n) // 9 + 1, max(1.0, n / segments))
    delete = price(n + 1, n - 1) if most <= 1 else math.inf
    return ("delete", 1) if delete < subset else ("subset", segments)


_bands: dict[int, tuple[str, int]] = {}


def schemes(n: int) -> list[tuple[int, str, int, int]]:
    """(band, form, segments, H) under which a set of n shingles is indexed: its own band's and,
    if larger partners lie in the next, that band's."""
    if n < 4:
        return []  # such sets link only if equal
    top = n * 100 // PERCENT
    k, lo, hi = band(n)
    out = [(k, lo, hi, (n + min(top, hi - 1)) // 9)]
    if top >= hi:
        out.append((*band(hi), (n + top) // 9))
    for b, lo, hi, _ in out:
        if b not in _bands:
            _bands[b] = allocate(lo, hi)
    return [(b, *_bands[b], h) for b, _, _, h in out]


def signatures(s: np.ndarray, hot: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set, and for each the documents expected to share it."""
    sigs, costs = [], []
    own = mix(s + _U(0x632BE59BD9B4E019))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        df = np.where(hot[at] == s, freq[at], 1)
    else:
        df = np.ones(len(s), np.int64)
    for b, form, m, h in schemes(len(s)):
        salt = _U((b + 1) * 0xD1B54A32D192ED03 & 2**64 - 1)
        if form == "delete":
            total = own.sum(dtype=np.uint64)
            sigs.append(mix(np.concatenate([[total], total - own]) + salt))
            costs.append(np.full(len(s) + 1, df.min()))
            continue
        seg = (s >> _U(17)) % _U(m)
        order = np.argsort(seg, kind="stable")
        seg = seg[order]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        sums = np.add.reduceat(own[order], first)
        cost = np.minimum.reduceat(df[order], first)
        held = np.diff(np.concatenate([first, [len(seg)]]))
        ids = seg[first]
        if len(ids) <= h:  # the empty segments are needed too
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), ids)
            ids = np.concatenate([ids, empty])
            sums = np.concatenate([sums, np.zeros(len(empty), np.uint64)])
            cost = np.concatenate([cost, np.full(len(empty), 2**40)])
            held = np.concatenate([held, np.zeros(len(empty), np.int64)])
        sig = mix(sums + mix(ids + salt))
        pick = np.lexsort((sig, -np.minimum(held, 4), np.log2(cost).astype(np.int64)))[: h + 1]
        sigs.append(sig[pick])
        costs.append(cost[pick])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(costs)


def hot_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all documents and how often they were met; bounded by HOT_MAX."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        s, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n >= LOCAL_HOT
        return pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["s", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for t in batch.column(0):
                held.append(shingle_set(t.as_py()))
                n += len(held[-1])
                if n >= COUNT_AT_ONCE:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    sums = docs.select("text").mapInArrow(released(count), "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_MIN)
    got = sums.orderBy(F.desc("n"), "s").limit(HOT_MAX).toArrow()
    s, n = got["s"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


PACKED = "part int, kind string, a binary, b binary, c binary"
FOUND = "kind string, x bigint, a bigint, b bigint, n bigint"


def _packed(parts: int, ids: list, sizes: list[int], marks: list[bytes], sigs: list[np.ndarray], owners: list[np.ndarray], salts: list[np.ndarray]) -> pa.RecordBatch:
    rows = []
    sig = np.concatenate([np.zeros(0, np.uint64), *sigs])
    own = np.concatenate([np.zeros(0, np.int64), *owners])
    salt = np.concatenate([np.zeros(0, np.int64), *salts])
    part = ((sig ^ (salt.astype(np.uint64) * _U(0x9E3779B97F4A7C15))) % _U(parts)).astype(np.int64) * 2 + (salt > 0)
    order = np.argsort(part, kind="stable")
    part, sig, own = part[order], sig[order], own[order]
    for lo, hi in _runs(part):
        rows.append((int(part[lo]) // 2, "salted" if part[lo] % 2 else "sigs", sig[lo:hi].tobytes(), own[lo:hi].tobytes(), b""))
    known = [k for k, i in enumerate(ids) if i is not None]
    for kind, at in (("docs", known), ("nameless", [k for k, i in enumerate(ids) if i is None])):
        if at:
            rows.append(((ids[at[0]] or 0) % parts, kind, np.array([ids[k] or 0 for k in at], np.int64).tobytes(), np.array([sizes[k] for k in at], np.int64).tobytes(), b"".join(marks[k] for k in at)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3, 4)]], names=["part", "kind", "a", "b", "c"])


def _packer(hot, parts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, freq = hot.value
        held: tuple[list, ...] = ([], [], [], [], [], [])
        seen: set[bytes] = set()
        n = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, sizes, marks, sigs, owners, salts = held
                s = shingle_set(t.as_py())
                mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                ids.append(i)
                sizes.append(len(s))
                marks.append(mark)
                if i is not None and mark not in seen:  # copies met just before: their set is indexed
                    seen.add(mark)
                    sig, cost = signatures(s, tokens, freq)
                    sigs.append(sig)
                    owners.append(np.full(len(sig), i, np.int64))
                    salts.append(np.where(cost > SALT_ROWS, 1 + (i % (cost // SALT_ROWS + 1)), 0))
                    n += len(sig)
                if n >= PACK_AT_ONCE or len(ids) >= 20_000:
                    yield _packed(parts, *held)
                    held, n = ([], [], [], [], [], []), 0
                    seen.clear()
        if held[0]:
            yield _packed(parts, *held)

    return pack


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Limits of the runs of equal keys."""
    if len(keys) == 0:
        return []
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def _lists(sig: np.ndarray, own: np.ndarray, salted: bool) -> tuple[np.ndarray, ...]:
    """Lists of two documents or more that share a signature, each distinct list once: list id, its
    least document, a further member, its length. Salted lists are known by their signature."""
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])]) if len(sig) else np.zeros(0, bool)
    sig, own = sig[fresh], own[fresh]
    if len(sig) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    held = np.diff(np.concatenate([first, [len(sig)]]))
    if salted:
        keep = np.ones(len(first), bool)
        name = sig[first]
    else:
        name = np.add.reduceat(mix(own.view(np.uint64)), first) ^ held.astype(np.uint64)
        keep = np.zeros(len(first), bool)
        many = np.flatnonzero(held > 1)
        keep[many[np.unique(name[many], return_index=True)[1]]] = True
    rows = np.repeat(keep, held)
    least, names, sizes = np.repeat(own[first], held)[rows], np.repeat(name, held)[rows], np.repeat(held, held)[rows]
    member = own[rows]
    other = np.ones(len(member), bool) if salted else member != least
    return names[other].view(np.int64), least[other], member[other], sizes[other]


def _match(table: pa.Table) -> pa.Table:
    kinds = np.array(table["kind"].to_pylist())
    a, b, c = (table[k].to_pylist() for k in ("a", "b", "c"))
    out: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for kind, name in (("sigs", "list"), ("salted", "salted")):
        at = np.flatnonzero(kinds == kind)
        if len(at):
            out.append((name, *_lists(np.frombuffer(b"".join(a[k] for k in at), np.uint64), np.frombuffer(b"".join(b[k] for k in at), np.int64), name == "salted")))
    for kind in ("docs", "nameless"):
        at = np.flatnonzero(kinds == kind)
        if len(at):
            marks = np.frombuffer(b"".join(c[k] for k in at), np.int64)
            out.append((kind, marks[::2], np.frombuffer(b"".join(a[k] for k in at), np.int64), marks[1::2], np.frombuffer(b"".join(b[k] for k in at), np.int64)))
    cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(1, 5)]
    return pa.table({"kind": pa.array([o[0] for o in out for _ in range(len(o[1]))], pa.string())} | {n: pa.array(v, pa.int64()) for n, v in zip("xabn", cols, strict=True)})


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs a, b those that link. Only texts that stand in a pair are shuffled."""
    ids = store(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "candidates")
    named = small(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t")).join(named, "id", "left_semi")
    texts = store(texts, "candidate-texts")
    right, left = texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[str, np.ndarray] = OrderedDict()

        def get(t: str) -> np.ndarray:
            s = recent.pop(t, None)
            s = shingle_set(t) if s is None else s
            recent[t] = s
            if len(recent) > 8:
                recent.popitem(last=False)
            return s

        for batch in batches:
            ok = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = get(ta.as_py()), get(tb.as_py())
                common = overlap(x, y) if 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)) else 0
                ok.append(common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return store(both.mapInArrow(released(check), "a bigint, b bigint"), "links")


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """x, m, pop, n, comp of the lists that span several components so far."""
    at = members.join(comps.withColumnRenamed("node", "m"), "m", "left").withColumn("comp", F.coalesce("comp", "m"))
    at = store(at, "labelled")
    open_lists = at.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("x")
    return store(at.join(small(store(open_lists, "open-lists")), "x"), "open-members")


def _to_leaders(at: DataFrame) -> DataFrame:
    """For each document at most one pair: with the most popular leader, in a list it is in, of another
    component. A component's leader in a list is its member that stands in most lists."""
    leaders = at.groupBy("x", "comp").agg(F.max(F.struct("pop", (-F.col("m")).alias("k"), F.col("n").alias("n"))).alias("l"))
    leaders = store(leaders, "leaders")
    best = leaders.groupBy("x").agg(F.max(F.struct("l", "comp")).alias("t"))
    other = leaders.join(best, "x").where("comp != t.comp").groupBy("x").agg(F.max(F.struct("l", "comp")).alias("t"))
    two = store(best.unionByName(other).select("x", F.col("t.comp").alias("lc"), F.col("t.l").alias("l")), "two-leaders")
    own = at.select("x", "m", "n", "comp").join(small(two), "x").where(f"comp != lc and 100 * least(n, l.n) >= {PERCENT} * greatest(n, l.n)")
    pairs = own.select("m", F.struct(F.col("l.pop").alias("pop"), F.col("l.k").alias("k")).alias("l"), F.least("m", -F.col("l.k")).alias("a"), F.greatest("m", -F.col("l.k")).alias("b"))
    best = pairs.groupBy("m").agg(F.max_by(F.struct("a", "b"), "l").alias("p"))
    return store(best.select("p.a", "p.b").distinct(), "leader-pairs")


def linking(sets: list[np.ndarray], comps: list[int], sides: list[int], cross: bool) -> list[tuple[int, int]]:
    """Links (as places in ``sets``) that join different components, found by counting common shingles
    over an inverted index. The largest component is never compared with itself. With ``cross`` only
    pairs of different sides count. Links that join what is joined already are left out."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    names, comp = np.unique(np.array(comps), return_inverse=True)
    side = np.array(sides)
    main = np.bincount(comp).argmax() if len(comp) else 0
    root = list(range(len(names)))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for k in np.flatnonzero(comp != main).tolist():
        s = sets[k]
        lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        total = int((hi - lo).sum())
        if total == 0:
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(sets))
        ok = 100 * common >= PERCENT * (sizes + len(s) - common)
        ok &= (comp != comp[k]) & (common > 0)
        if cross:
            ok &= side != side[k]
        for j in np.flatnonzero(ok).tolist():
            x, y = find(int(comp[k])), find(int(comp[j]))
            if x != y:
                root[x] = y
                out.append((k, j))
    return out


def _exhaust(at: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the components that open lists span. Lists with the same leader are put together,
    and such a group is cut into blocks of BLOCK_SHINGLES; every two blocks meet in one task, which
    counts common shingles and returns only links that join components."""
    leaders = store(at.groupBy("x").agg(F.max(F.struct("pop", (-F.col("m")).alias("k"))).alias("l")), "leaders")
    group = at.join(small(leaders), "x").select((-F.col("l.k")).alias("leader"), "m", "comp", "n").distinct()
    total = group.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.count_distinct("comp").alias("comps")).where("comps > 1")
    group = group.join(total, "leader").withColumn("own", F.pmod(F.xxhash64("m"), "blocks"))
    group = group.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = store(group.select("leader", "m", "comp", "own", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q")), "blocks")
    ids = store(group.select(F.col("m").alias("id")).distinct(), "block-members")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t")).join(small(ids), "id", "left_semi")
    rows = group.join(texts.withColumnRenamed("id", "m"), "m")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("m")
        m = table["m"].to_pylist()
        sets = [shingle_set(t.as_py()) for t in table["t"]]
        found = linking(sets, table["comp"].to_pylist(), table["own"].to_pylist(), table["p"][0].as_py() != table["q"][0].as_py())
        return pa.table({"a": pa.array([min(m[x], m[y]) for x, y in found], pa.int64()), "b": pa.array([max(m[x], m[y]) for x, y in found], pa.int64())})

    return store(rows.groupBy("leader", "p", "q").applyInArrow(compare, "a bigint, b bigint"), "block-links")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null text counts as empty; without words the set is empty and the document is its own
    component. Rows with equal ids are one node. A null id cannot be named by others: its row has a
    null component and links nothing. An empty table gives an empty result; other columns are not
    read."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hot = spark.sparkContext.broadcast(hot_shingles(rows))
    parts = max(8, 2 * input_parts(rows))
    packed = rows.mapInArrow(released(_packer(hot, parts)), PACKED)
    found = store(packed.groupBy("part").applyInArrow(_match, FOUND), "found")

    named = found.where("kind = 'docs'").select(F.col("a").alias("doc_id"), F.col("x").alias("d1"), F.col("b").alias("d2"), "n")
    # only sets that stand more than once are joined, by an equi-join that can be split where it is skewed
    reps = store(named.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("same")).where("same > 1").drop("same"), "copied-sets")
    named = store(named.join(small(reps), ["d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "named")
    copies = store(named.where("rep != doc_id").select("doc_id", "rep").distinct(), "copies")
    moved = small(copies)

    lists = found.where("kind in ('list', 'salted')")
    salted = lists.where("kind = 'salted'")
    bridges = salted.groupBy("x").agg(F.min("a").alias("least")).join(salted.select("x", F.col("a").alias("b")).distinct(), "x").select("x", F.col("least").alias("a"), "b", F.lit(3).cast("long").alias("n"))
    lists = lists.select("x", "a", "b", "n").unionByName(bridges).where("a != b")
    to_rep = lambda df, c: df.join(moved.select(F.col("doc_id").alias(c), F.col("rep").alias("__rep")), c, "left").withColumn(c, F.coalesce("__rep", c)).drop("__rep")
    lists = store(to_rep(to_rep(lists, "a"), "b").where("a != b").distinct(), "lists")

    members = lists.select("x", F.col("a").alias("m")).unionByName(lists.select("x", F.col("b").alias("m"))).distinct()
    sizes = named.where("doc_id = rep").groupBy(F.col("doc_id").alias("m")).agg(F.max("n").alias("n"))
    popular = members.groupBy("m").agg(F.count("*").alias("pop"))
    members = store(members.join(popular.join(sizes, "m"), "m"), "members")
    links = spark.createDataFrame([], "a bigint, b bigint")
    comps = spark.createDataFrame([], "node bigint, comp bigint")
    at = _open(members, comps)
    if not at.isEmpty():
        links = verify(_to_leaders(at), rows)
        comps = store(components(links), "components")
        at = _open(members, comps)
        if not at.isEmpty():
            comps = components(links.unionByName(_exhaust(at, rows)))
    # Rows that share an id are one node whatever their sets.
    out = named.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    nameless = found.where("kind = 'nameless'").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(nameless)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns stay."""
    gone = store(classes(docs).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(small(gone), docs["doc_id"] == F.col("__gone"), "left_anti")
