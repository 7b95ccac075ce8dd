"""Near-duplicate passages by compact windows.

A text is its sequence of 5-word shingles, as 64-bit hashes. Under one hash function every stretch of it
has a least shingle; the Cartesian tree over the hashes groups all stretches with the same least shingle
into one compact window (l, c, r): any stretch within [l, r] that holds c. Only windows of LEAST shingles or
more are kept. Two passages of similarity s share the least shingle under one of FUNCTIONS functions with
probability 1 - (1 - s) ^ FUNCTIONS, which is 0.99 at 0.8; equal ones always do.

1. Equal texts are folded into the one with the smallest id.
2. Windows are matched by signature (function and least shingle). Signatures that one text alone has end here.
3. For each shared signature the shingles around its places are sent, REACH to either side, which is as far as a
   passage of LEAST shingles through that place goes. Around equal places the intervals join: windows
   of a signature that have a passage of 50 words and a Jaccard similarity of 0.8 through it are linked.
   A window without enough shingles that others have as well is set aside; of the others, each is compared
   with every window that it is not already joined with, until none is open.
4. The verified stretches of a document that overlap are one region; links join regions into classes.

A signature of more than BLOCK documents is cut into blocks, and every two blocks meet in a task. Where many
windows of one packing task share a signature, they are dealt over all tasks, and only their number goes to
the signature's own. Nothing is left out by either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import input_parts, n_words, released, small, store
from .components import components
from .ngram_join import _runs as runs
from .shingles import mix, sequence, word_hashes

SIZE, WORDS = 5, 50
LEAST = WORDS - SIZE + 1
FUNCTIONS = 3
PERCENT = 80
#: Shingles to either side of a shared one.
REACH = LEAST - 1
#: Common shingles of two sides of LEAST shingles at a similarity of 0.8; longer sides have more.
LEAST_HITS = -(-8 * LEAST // 9)
#: Documents of one signature that a task takes on either side of a comparison; bounds its memory.
BLOCK = 8192
#: Windows packed at once by a task; bounds its memory.
PACK_AT_ONCE = 300_000
#: Documents of one signature among those, beyond which they are dealt over all tasks.
LOCAL_HOT = 32
#: Children of a node in the trees that join the members of a component; keeps hubs from forming.
FANOUT = 64
_U = np.uint64
_SEEDS = [_U(0x9E3779B97F4A7C15 * (2 * j + 1) & 2**64 - 1) for j in range(FUNCTIONS)]


def least_places(h: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The places that hold the least value of some stretch of ``least``, by sliding minima."""
    low, width = h, 1
    while width < least:
        step = min(width, least - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    # of the stretches around a place the greatest minimum
    edge = np.zeros(least - 1, h.dtype)
    high, width = np.concatenate([edge, low, edge]), 1
    while width < least:
        step = min(width, least - width)
        high = np.maximum(high[:-step], high[step:])
        width += step
    return np.flatnonzero(high == h)


def compact_windows(h: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(l, c, r), both ends included, of the tree's nodes that span ``least`` or more; c is the first place
    of the least value, all of whose places part the node at once. Smaller nodes are left out before the
    tree is built: what bounds a node of ``least`` or more is itself the least value of a longer stretch. The
    rest goes over a stack once."""
    if len(h) < least:
        return []
    out: list[tuple[int, int, int]] = []
    path: list[list[int]] = []  # value, left end, first place, last place, from the root
    at = least_places(h, least)
    for x, v in zip(at.tolist(), h[at].tolist(), strict=True):
        while path and path[-1][0] > v:
            _, l, c, _ = path.pop()
            out.append((l, c, x - 1))
        if path and path[-1][0] == v:
            path[-1][3] = x
        else:
            path.append([v, path[-1][3] + 1 if path else 0, x, x])
    return out + [(l, c, len(h) - 1) for _, l, c, _ in path]


def hashed(seq: np.ndarray, j: int) -> np.ndarray:
    """Signatures of all shingles under function j; the two low bits are its number."""
    return mix(seq ^ _SEEDS[j]) & ~_U(3) | _U(j)


def window_signatures(seq: np.ndarray) -> np.ndarray:
    """The distinct signatures of a text's windows."""
    sigs = []
    for j in range(FUNCTIONS):
        h = hashed(seq, j)
        sigs.append(np.unique(h[[c for _, c, _ in compact_windows(h)]]))
    return np.concatenate(sigs)


PACKED = "part int, kind int, sigs binary, ids binary"
PLAIN, HOT, COUNT = 0, 1, 2


def _packed(parts: int, sigs: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    """Signatures with their documents by part. Of a signature with more than LOCAL_HOT of them one goes
    to the signature's part, with the number of the others, which are dealt over all parts."""
    sig, own = np.concatenate(sigs), np.concatenate(owners)
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])
    sig, own = sig[fresh], own[fresh]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    held = np.diff(np.concatenate([np.flatnonzero(first), [len(sig)]]))
    hot = np.repeat(held > LOCAL_HOT, held) & ~first
    home = lambda s: ((s >> _U(2)) % _U(parts)).astype(np.int64)
    many = held > LOCAL_HOT
    count_sig, count = sig[first][many], held[many] - 1
    part = np.concatenate([home(sig[~hot]), (mix(sig[hot] ^ own[hot].view(np.uint64)) % _U(parts)).astype(np.int64), home(count_sig)])
    kind = np.concatenate([np.full((~hot).sum(), PLAIN), np.full(hot.sum(), HOT), np.full(len(count), COUNT)])
    sig, own = np.concatenate([sig[~hot], sig[hot], count_sig]), np.concatenate([own[~hot], own[hot], count])
    order = np.argsort(part * 4 + kind, kind="stable")
    part, kind, sig, own = part[order], kind[order], sig[order], own[order]
    at = runs(part * 4 + kind)
    return pa.RecordBatch.from_arrays([pa.array([int(x[a]) for a, _ in at], pa.int32()) for x in (part, kind)] + [pa.array([x[a:b].tobytes() for a, b in at], pa.binary()) for x in (sig, own.astype(np.int64))], names=["part", "kind", "sigs", "ids"])


def _packer(parts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        n = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seq = sequence(word_hashes(t.as_py()), SIZE)
                if len(seq) < LEAST:
                    continue
                sig = window_signatures(seq)
                for into, x in zip(held, (sig, np.full(len(sig), i, np.int64)), strict=True):
                    into.append(x)
                n += len(sig)
                if n >= PACK_AT_ONCE:
                    yield _packed(parts, *held)
                    held, n = ([], []), 0
        if held[0]:
            yield _packed(parts, *held)

    return pack


GROUPS = "sig bigint, id bigint, m bigint"


def _groups(table: pa.Table) -> pa.Table:
    """(signature, document, documents of the signature) where there are two or more. Of dealt signatures
    also a row (signature, null, documents), and of the documents dealt elsewhere (signature, document, null)."""
    kinds = np.array(table["kind"].to_pylist())
    a, b = table["sigs"].to_pylist(), table["ids"].to_pylist()

    def read(kind: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(kinds == kind)
        return np.frombuffer(b"".join(a[k] for k in at), np.uint64), np.frombuffer(b"".join(b[k] for k in at), np.int64)

    sig, own = read(PLAIN)
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])]) if len(sig) else np.zeros(0, bool)
    sig, own = sig[fresh], own[fresh]
    name, first, m = np.unique(sig, return_index=True, return_counts=True)
    dealt, n = read(COUNT)
    total = m.copy()
    np.add.at(total, np.searchsorted(name, dealt), n)
    keep = np.repeat(total > 1, m)
    dealt = np.unique(dealt)
    hot, elsewhere = read(HOT)
    return pa.table({
        "sig": pa.array(np.concatenate([sig[keep], dealt, hot]).view(np.int64)),
        "id": pa.concat_arrays([pa.array(own[keep]), pa.nulls(len(dealt), pa.int64()), pa.array(elsewhere)]),
        "m": pa.concat_arrays([pa.array(np.repeat(total, m)[keep].astype(np.int64)), pa.array(total[np.searchsorted(name, dealt)].astype(np.int64)), pa.nulls(len(hot), pa.int64())]),
    })


def thinned(places: np.ndarray) -> np.ndarray:
    """Places such that every stretch of LEAST shingles with a place in it has one of these: the first, the
    last, and between them as few as that allows."""
    if len(places) < 3:
        return places
    kept = [0]
    while kept[-1] < len(places) - 1:
        at = kept[-1]
        kept.append(max(at + 1, int(np.searchsorted(places, places[at] + LEAST, "right")) - 1))
    return places[kept]


SURROUNDINGS = "key bigint, doc bigint, off int, shingles binary, places binary"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each wanted signature of a text the shingles around its places (the low halves of their hashes);
    of places close to each other
    a few are enough, and places with the same surroundings in one text share a row. Of a signature in b blocks a document goes
    to the b pairs with its own."""
    for batch in batches:
        keys, docs, offs, around, places = [], [], [], [], []

        def row(key: int, doc: int, off: int, held: bytes, at: list[int]) -> None:
            keys.append(key), docs.append(doc), offs.append(off), around.append(held), places.append(np.array(at, np.int32).tobytes())

        for i, t, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            seq = sequence(word_hashes(t.as_py()), SIZE)
            if len(seq) < LEAST:
                continue
            values = lists.values
            sig, blocks = np.array(values.field(0)).view(np.uint64), np.array(values.field(1))
            order = np.argsort(sig)
            sig, blocks = sig[order], blocks[order]
            low = seq.astype(np.uint32)
            by: dict[tuple[int, int, bytes], list[int]] = {}
            for j in range(FUNCTIONS):
                h = hashed(seq, j)
                at = np.minimum(np.searchsorted(sig, h), len(sig) - 1)
                met = np.flatnonzero(sig[at] == h)
                met = met[np.argsort(at[met], kind="stable")]
                for lo, hi in runs(at[met]):
                    for c in thinned(met[lo:hi]).tolist():
                        by.setdefault((int(at[c]), min(REACH, c), low[max(0, c - REACH) : c + REACH + 1].tobytes()), []).append(c)
            for (k, off, held), at in by.items():
                if blocks[k] == 1:
                    row(int(sig[k].view(np.int64)), i, off, held, at)
                    continue
                own = hash(i) % int(blocks[k])
                for other in range(int(blocks[k])):
                    pair = np.array([min(own, other) * int(blocks[k]) + max(own, other)], np.uint64)
                    row(int((mix(pair + _U(1)) ^ sig[k]).view(np.int64)[0]), i, off, held, at)
            if len(keys) >= 20_000:
                yield _arrow(SURROUNDINGS, keys, docs, offs, around, places)
                keys, docs, offs, around, places = [], [], [], [], []
        yield _arrow(SURROUNDINGS, keys, docs, offs, around, places)


def _arrow(schema: str, *columns) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def numbered(around: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the shingles of each row, equal ones of a group alike, in columns; what holds nothing has
    the number after the last. And a row's number of columns for each shingle that it has: number, row, columns,
    sorted by number and row."""
    row, col = np.nonzero(around)
    key = group[row].astype(np.uint64) << _U(32) | around[row, col]
    order = np.argsort(key, kind="stable")
    key, row, col = key[order], row[order], col[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    number = np.cumsum(fresh) - 1
    ids = np.full(around.shape, fresh.sum(), np.int32)
    ids[row, col] = number
    first = np.flatnonzero(fresh | np.concatenate([[True], row[1:] != row[:-1]])[: len(key)])
    return ids, number[first], row[first], np.diff(np.concatenate([first, [len(key)]]))


def supported(key: np.ndarray, row: np.ndarray, held: np.ndarray, comp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row, its columns whose shingle also stands in a row of another component and document; keys are sorted."""
    if len(key) == 0:
        return np.zeros(len(comp))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ok = np.ones(len(first), bool)
    for name in (comp, doc):
        of = name[row]
        ok &= np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first)
    return np.bincount(row, np.repeat(ok, np.diff(np.concatenate([first, [len(key)]]))) * held, len(comp))


_MOST = (2 * REACH + 1) // 9
#: Misses to the left and to the right that a stretch may take in.
_LEFT, _RIGHT = (np.array(z) for z in zip(*[(x, y) for x in range(_MOST + 1) for y in range(_MOST + 1 - x)], strict=True))
_NEEDED = (9 * (_LEFT + _RIGHT)).astype(np.int16)
_NEVER = -1000
#: Rows whose stretches are sought at once; bounds memory.
STRETCH_AT_ONCE = 2048


def _misses(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and k up to _MOST: the columns before the miss after k others, and whether a hit stands
    right before it. What lies beyond the last column counts as missed."""
    n, width = side.shape
    row, col = np.nonzero(~side)
    many = np.bincount(row, minlength=n)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    few = rank <= _MOST
    row, col, rank = row[few], col[few], rank[few]
    at = (width + np.maximum(np.arange(_MOST + 1) - many[:, None], 0)).astype(np.int16)
    at[row, rank] = col
    return at, np.diff(at, axis=1, prepend=np.int16(-1)) > 1


def stretch(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a mask the longest stretch through the middle that begins and ends with a hit and
    has hits in eight ninths or more, as two sides of a similarity of 0.8: first and last column. A stretch
    is told by the misses it takes in on either side, of which there can be only few."""
    if len(hit) > STRETCH_AT_ONCE:
        parts = [stretch(hit[k : k + STRETCH_AT_ONCE]) for k in range(0, len(hit), STRETCH_AT_ONCE)]
        return np.concatenate([lo for lo, _ in parts]), np.concatenate([hi for _, hi in parts])
    (left, starts), (right, stops) = _misses(hit[:, REACH::-1]), _misses(hit[:, REACH:])
    left, right = left.astype(np.int64), right.astype(np.int64)
    n = np.take(np.where(starts, left, _NEVER).astype(np.int16), _LEFT, axis=1) + np.take(np.where(stops, right, _NEVER).astype(np.int16), _RIGHT, axis=1) - np.int16(1)
    n *= n >= _NEEDED
    best = n.argmax(axis=1)
    rows = np.arange(len(hit))
    found = n[rows, best] > 0
    lo = np.where(found, REACH - left[rows, _LEFT[best]] + 1, REACH)
    hi = np.where(found, REACH + right[rows, _RIGHT[best]] - 1, REACH)
    return lo, hi


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    common = len(x & y)
    return common / (len(x) + len(y) - common) if common else 0.0


def linked(around: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Components of the rows of each group and the links found: (row, lo, hi, row, lo, hi, similarity), in
    columns. A row is done when it was compared with all rows that it was not joined with by then. Rows of
    the largest component of a group wait: two of them are joined, and the others are compared with them.
    Groups are numbered from 0, in the order of the rows. Small groups are done side by side, a row of each at
    a time; what is open when few groups are left is done group by group."""
    comp = np.arange(len(doc))
    begin = np.searchsorted(group, np.arange(int(group.max(initial=0)) + 2))
    links: list[tuple] = []

    def settle(near: np.ndarray, of: np.ndarray, hit: np.ndarray) -> None:
        """Compares rows with one row each, given which of their shingles it has."""
        lo, hi = stretch(hit)
        far = hi - lo + 1 >= LEAST
        near, of, hit = near[far], of[far], hit[far]
        for k in range(0, len(near), 1024):
            part, with_ = near[k : k + 1024], of[k : k + 1024]
            for x, y, got in zip(part.tolist(), with_.tolist(), verified(around[part], around[with_], hit[k : k + 1024]), strict=True):
                if got:
                    links.append((x, got[0], got[1], y, got[2], got[3], got[4]))
                    if comp[x] != comp[y]:
                        own = comp[begin[group[x]] : begin[group[x] + 1]]
                        own[own == comp[x]] = comp[y]

    ids, *entries = numbered(around, group)
    #: Columns of each shingle in the row that others are compared with.
    theirs = np.zeros(ids.max(initial=0) + 1, np.int32)

    def screened(rest: np.ndarray, key: np.ndarray, row: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that others may link to, by group, those that wait last, those with the most common shingles
        first; which of them wait."""
        support = supported(key, row, held, comp, doc)
        order = rest[support[rest] >= LEAST_HITS]
        # the largest component of each group, the first of equal ones
        name, at, n = np.unique(comp[order], return_inverse=True, return_counts=True)
        ranked = np.lexsort((name, -n, group[name]))
        largest = np.zeros(len(name), bool)
        largest[ranked[np.concatenate([[True], group[name[ranked]][1:] != group[name[ranked]][:-1]])] if len(name) else ranked] = True
        waits = largest[at] & (n[at] > 1)
        ranks = np.lexsort((order, -support[order], waits, group[order]))
        return order[ranks], waits[ranks]

    def common(row: np.ndarray, held: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Rows with enough columns that the other row has as well, and as many there; else no link is possible.
        Texts that repeat a few words have many on one side alone."""
        return (np.bincount(row, held * (other > 0), len(doc)) >= LEAST_HITS) & (np.bincount(row, other, len(doc)) >= LEAST_HITS)

    def among(rest: np.ndarray, key: np.ndarray, row: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(doc), bool)
        inside[rest] = True
        inside = inside[row]
        return key[inside], row[inside], held[inside]

    rest = np.arange(len(doc))
    key, row, held = entries
    while len(rest) > 1:
        order, _ = screened(rest, key, row, held)
        if len(order) < 2:
            return comp, links
        key, row, held = among(order, key, row, held)
        first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        leaders = order[first]
        if len(leaders) < 16:
            rest = order
            break
        of, lead = np.full(len(doc), -1), np.zeros(len(doc), bool)
        of[order] = np.repeat(leaders, np.diff(np.concatenate([np.flatnonzero(first), [len(order)]])))
        lead[leaders] = True
        open_ = (of >= 0) & (comp != comp[of]) & (doc != doc[of])
        led = lead[row]
        theirs[key[led]] = held[led]
        near = np.flatnonzero(common(row, held, theirs[key]) & open_)
        settle(near, of[near], theirs[ids[near]] > 0)
        theirs[key[led]] = 0
        rest = order[~first]
        key, row, held = among(rest, key, row, held)
    for g in np.unique(group[rest]).tolist():
        left = rest[group[rest] == g]
        key, row, held = among(left, *entries)
        while len(left) > 1:
            order, waits = screened(left, key, row, held)
            if len(order) < 2:
                break
            key, row, held = among(order, key, row, held)
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            names, ends = key[begins], np.concatenate([begins[1:], [len(key)]])
            done = np.ones(len(doc), bool)
            done[order] = False
            for y in order[~waits][: max(64, len(order) // 8)].tolist():
                done[y] = True
                own = ids[y][around[y] != 0]
                np.add.at(theirs, own, 1)
                at = np.searchsorted(names, np.unique(own))
                lo, n = begins[at], ends[at] - begins[at]
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                near = np.flatnonzero(common(row[at], held[at], theirs[key[at]]) & ~done & (comp != comp[y]) & (doc != doc[y]))
                if len(near):
                    settle(near, np.full(len(near), y), theirs[ids[near]] > 0)
                theirs[own] = 0
            left = order[~done[order]]
            key, row, held = among(left, key, row, held)
    return comp, links


def verified(a: np.ndarray, b: np.ndarray, one: np.ndarray | None = None) -> list[tuple[int, int, int, int, float] | None]:
    """For pairs of rows of surroundings (0: nothing) a passage of LEAST shingles or more through the middle of
    both, the longest found: where shingles are equal place by place, or, as words may have been put in, left
    out or moved, where they stand anywhere on the other side, first in all of it, then in its stretch.
    ``one``: which shingles of ``a`` stand anywhere in ``b``, where that is known."""
    out: list[tuple[int, int, int, int, float] | None] = [None] * len(a)
    if one is None:
        one = ((a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None]).any(axis=2)
    same = (a == b) & (a != 0)
    # equal shingles through the middle without a break, and next to none elsewhere
    left = np.argmin(np.concatenate([same[:, REACH::-1], np.zeros((len(a), 1), bool)], axis=1), axis=1)
    right = np.argmin(np.concatenate([same[:, REACH:], np.zeros((len(a), 1), bool)], axis=1), axis=1)
    run = np.maximum(left + right - 1, 0)
    plain = (run >= LEAST) & (one.sum(axis=1) - run < 2 * SIZE)
    for k in np.flatnonzero(plain).tolist():
        l, h = REACH - int(left[k]) + 1, REACH + int(right[k]) - 1
        out[k] = (l, h, l, h, 1.0)
    rest = np.flatnonzero(~plain)
    if len(rest):
        for k, got in zip(rest.tolist(), _searched(a[rest], b[rest], same[rest], one[rest]), strict=True):
            out[k] = got
    return out


def _searched(a: np.ndarray, b: np.ndarray, same: np.ndarray, one: np.ndarray) -> list[tuple[int, int, int, int, float] | None]:
    out: list[tuple[int, int, int, int, float] | None] = [None] * len(a)

    def take(rows: np.ndarray, la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> None:
        for k in np.flatnonzero((ha - la + 1 >= LEAST) & (hb - lb + 1 >= LEAST)).tolist():
            x, l, h, m, n = int(rows[k]), int(la[k]), int(ha[k]), int(lb[k]), int(hb[k])
            if out[x] is None or h - l > out[x][1] - out[x][0]:
                s = similarity(a[x, l : h + 1], b[x, m : n + 1])
                if 100 * s >= PERCENT:
                    out[x] = (l, h, m, n, s)

    lo, hi = stretch(same)
    take(np.arange(len(a)), lo, hi, lo, hi)
    more = np.flatnonzero(one.sum(axis=1) - (hi - lo + 1) >= 2 * SIZE)
    if len(more) == 0:
        return out
    columns = np.arange(2 * REACH + 1)
    both = (a[more][:, :, None] == b[more][:, None, :]) & (a[more] != 0)[:, :, None]
    one, two = one[more], both.any(axis=1)
    (la, ha), (lb, hb) = stretch(one), stretch(two)
    # within these the second search can find only shorter ones
    far = np.flatnonzero((ha - la + 1 >= LEAST) & (hb - lb + 1 >= LEAST))
    if len(far) == 0:
        return out
    more, la, ha, lb, hb = more[far], la[far], ha[far], lb[far], hb[far]
    take(more, la, ha, lb, hb)
    inside = lambda l, h: (columns >= l[:, None]) & (columns <= h[:, None])
    one, two = (both[far] & inside(lb, hb)[:, None, :]).any(axis=2), (both[far] & inside(la, ha)[:, :, None]).any(axis=1)
    take(more, *stretch(one), *stretch(two))
    return out


NODES = "node bigint, doc bigint, lo bigint, hi bigint, up bigint, sim double, plo bigint, phi bigint, mdoc bigint, mlo bigint, mhi bigint"


def _node(doc: int, place: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"%d:%d" % (doc, place)) - 2**63


def _compared(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    """The nodes of whole groups: a node is a stretch of a document, verified against another (plo to phi
    there is mlo to mhi in mdoc), with its parent in a tree over its component. Equal surroundings are
    compared once, for the first that has them."""
    distinct: dict[tuple[int, int, bytes], list[int]] = {}
    for k, (key, _, off, held, _) in enumerate(rows):
        distinct.setdefault((key, off, held), []).append(k)
    first = [held[0] for held in distinct.values()]
    around = np.zeros((len(first), 2 * REACH + 1), np.uint32)
    held = np.frombuffer(b"".join(held for _, _, held in distinct), np.uint32)
    n, off = np.array([len(held) // 4 for _, _, held in distinct]), np.array([off for _, off, _ in distinct])
    at = np.repeat(np.arange(len(n)) * around.shape[1] + REACH - off - np.cumsum(n) + n, n) + np.arange(len(held))
    around.ravel()[at] = np.where(held == 0, 1, held)
    _, group = np.unique(np.array([key for key, _, _ in distinct]), return_inverse=True)
    several = [len({rows[k][1] for k in held}) > 1 for held in distinct.values()]
    # a row of several documents is no document's own
    _, doc = np.unique(np.array([rows[i][1] for i in first], np.int64), return_inverse=True)
    doc = np.where(several, len(first) + np.arange(len(first)), doc)
    comp, links = linked(around, group, doc)
    best: dict[int, tuple] = {}
    reach: dict[int, tuple[int, int]] = {}
    for k, many in enumerate(several):
        cols = np.flatnonzero(around[k])
        if many and len(cols) >= LEAST:
            lo, hi = int(cols[0]), int(cols[-1])
            best[k], reach[k] = (1.0, hi - lo, k, lo, hi, lo, hi), (lo, hi)
    for x, lx, hx, y, ly, hy, s in links:
        for a, la, ha, b, lb, hb in ((x, lx, hx, y, ly, hy), (y, ly, hy, x, lx, hx)):
            best[a] = max(best.get(a, (0.0,)), (s, ha - la, b, la, ha, lb, hb))
            lo, hi = reach.get(a, (la, ha))
            reach[a] = min(lo, la), max(hi, ha)
    members = list(distinct.values())
    base = lambda i: [x - REACH for x in memoryview(rows[i][4]).cast("i")]
    out: list[tuple] = []
    trees: dict[int, list[int]] = {}
    for k in sorted(reach):
        tree = trees.setdefault(int(comp[k]), [])
        s, _, other, la, ha, lb, hb = best[k]
        lo, hi = reach[k]
        for i in members[k]:
            own = rows[i][1]
            that = next((j for j in members[other] if rows[j][1] != own), None)
            if that is None:  # the other row is of this document alone
                continue
            there, at = base(that)[0], base(i)
            cut = [c for c in range(len(at)) if c == 0 or at[c] + lo > at[c - 1] + hi + 1]
            for c, e in zip(cut, [*(c - 1 for c in cut[1:]), len(at) - 1], strict=True):
                node, from_ = _node(own, at[c] + REACH), at[c]
                up = tree[(len(tree) - 1) // FANOUT] if tree else node
                tree.append(node)
                out.append((node, own, from_ + lo, at[e] + hi, up, s, from_ + la, from_ + ha, rows[that][1], there + lb, there + hb))
    return _arrow(NODES, *(zip(*out, strict=True) if out else [[]] * 11))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; groups are taken together as they are complete."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
        if len(held) >= BLOCK:
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield _compared(held[:cut])
                held = held[cut:]
    if held:
        yield _compared(held)


def copies(rows: DataFrame) -> DataFrame:
    """id, h (hash of the text) and the smallest id of the rows with equal texts, for the other ids."""
    told = store(rows.select("id", F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("digest")), "text-digests")
    groups = told.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("digest", "rep")
    return store(told.join(small(store(groups, "copied-texts")), "digest").where("id != rep").select("id", "h", "rep").distinct(), "text-copies")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each stretch of a document that repeats passages of other documents: doc_id, start_word,
    end_word (excluded), class_id (the smallest doc_id with a stretch that links reach), class_size (stretches
    of that class), and the best verified link: part_start to part_end of this document is match_start to
    match_end of match_doc_id with this similarity. Passages have 50 words or more and a Jaccard similarity
    of 0.8 or more over 5-word shingles; a longer passage is covered by such ones.

    Null text counts as empty; shorter texts and rows without id have no passages; rows with the same id
    are not compared with each other, nor is a text with itself. Repeated rows count once. No passages or
    an empty table give no rows; other columns are not read."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    twins = copies(rows)
    gone = small(twins.select("id", "h"), 2_000_000)
    rows_ = rows.withColumn("h", F.xxhash64("text")).join(gone, ["id", "h"], "left_anti").select("id", "text")
    parts = max(8, 2 * input_parts(rows))
    packed = rows_.mapInArrow(released(_packer(parts)), PACKED)
    groups = store(packed.groupBy("part").applyInArrow(_groups, GROUPS), "signatures")
    totals = small(groups.where("id IS NULL").select("sig", "m"))
    dealt = groups.where("m IS NULL").select("sig", "id").join(totals, "sig")
    shared = groups.where("id IS NOT NULL AND m IS NOT NULL").select("sig", "id", "m").unionByName(dealt.select("sig", "id", "m"))
    lists = shared.groupBy("id").agg(F.collect_list(F.struct("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))).alias("sigs"))
    lists = store(lists, "signature-lists")
    around = rows_.join(lists, "id").select("id", "text", "sigs").mapInArrow(released(_surroundings), SURROUNDINGS)
    nodes = around.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(released(_compare), NODES)
    return _regions(store(nodes.unionByName(_whole(rows, twins)), "nodes"), twins)


def _whole(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """A node over the whole text for each text with copies and 50 words or more."""
    reps = twins.groupBy(F.col("rep").alias("id")).agg(F.min("id").alias("mdoc"))
    reps = rows.join(small(store(reps, "copied-ids")), "id").select(F.col("id").alias("doc"), "mdoc", (n_words(F.col("text")) - SIZE).alias("hi")).where(F.col("hi") >= LEAST - 1)
    node, none = F.xxhash64("doc", F.lit("whole")), F.lit(0).cast("long")
    return reps.select(node.alias("node"), "doc", none.alias("lo"), "hi", node.alias("up"), F.lit(1.0).alias("sim"), none.alias("plo"), F.col("hi").alias("phi"), "mdoc", none.alias("mlo"), F.col("hi").alias("mhi"))


def _regions(nodes: DataFrame, twins: DataFrame) -> DataFrame:
    """Overlapping nodes of a document put together, classes, and the rows of equal texts."""
    best = F.max(F.struct("sim", (F.col("phi") - F.col("plo")).alias("n"), (-F.col("plo")).alias("k"), "plo", "phi", "mdoc", "mlo", "mhi")).alias("best")
    each = nodes.groupBy("node", "doc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), best)
    own = Window.partitionBy("doc").orderBy("lo", "hi", "node")
    before = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("fresh", F.coalesce(F.col("lo") > before + 1, F.lit(True)))
    each = each.withColumn("region", F.last(F.when(F.col("fresh"), F.col("node")), True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    each = store(each.drop("fresh"), "node-regions")
    at = each.select("node", "region").distinct()
    side = lambda c, name: at.select(F.col("node").alias(c), F.col("region").alias(name))
    edges = nodes.where("node != up").select("node", "up").distinct().join(side("node", "a"), "node").join(side("up", "b"), "up").select("a", "b")
    comps = components(edges)
    spans = each.groupBy("region", "doc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("best").alias("best"))
    spans = spans.join(comps.withColumnRenamed("node", "region"), "region", "left").withColumn("comp", F.coalesce("comp", "region"))
    # the rows of equal texts: a text with copies has one region, the whole
    again = spans.join(twins.select(F.col("rep").alias("doc"), F.col("id").alias("twin")).distinct(), "doc")
    again = again.where("lo = 0 AND best.sim = 1 AND best.phi = hi").select("region", F.col("twin").alias("doc"), "lo", "hi", "comp", F.struct(F.lit(1.0).alias("sim"), F.col("best.n").alias("n"), F.col("best.k").alias("k"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("doc").alias("mdoc"), F.col("lo").alias("mlo"), F.col("hi").alias("mhi")).alias("best"))
    every = store(spans.select("region", "doc", "lo", "hi", "comp", "best").unionByName(again), "regions")
    classes = store(every.groupBy("comp").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size")), "region-classes")
    word = lambda c: (F.col(c) + SIZE).alias
    return every.join(small(classes), "comp").select(F.col("doc").alias("doc_id"), F.col("lo").alias("start_word"), word("hi")("end_word"), "class_id", "class_size", F.col("best.plo").alias("part_start"), word("best.phi")("part_end"), F.col("best.mdoc").alias("match_doc_id"), F.col("best.mlo").alias("match_start"), word("best.mhi")("match_end"), F.round("best.sim", 6).alias("similarity"))
