"""Passages of two whole texts by direct search: the brute force that op9 is held against."""

from __future__ import annotations

import numpy as np

from brindle.llm.shingles import overlap
from brindle.llm.substring_dedup import LEAST, PERCENT


def _hit_runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def stretches(hit: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The longest stretch from hit to hit in which eight ninths are hits (a similarity of 0.8 for two
    stretches of the same length), then the longest on either side of it, and so on."""
    out, todo = [], [_hit_runs(hit)]
    while todo:
        runs_ = todo.pop()
        if not runs_ or runs_[-1][1] - runs_[0][0] < least:
            continue
        # at starts: hits less 8 times the misses before; a stretch is good if the sum does not fall
        before, after, total, last = [], [], 0, runs_[0][0]
        for lo, hi in runs_:
            total -= 8 * (lo - last)
            before.append(total)
            total += hi - lo
            after.append(total)
            last = hi
        best_after = after[:]
        for k in range(len(after) - 2, -1, -1):
            best_after[k] = max(best_after[k], best_after[k + 1])
        best, at, l = 0, (0, 0), 0
        low = None
        for k in range(len(runs_)):
            if low is not None and before[k] >= low:
                continue  # a start further left is at least as good
            low = before[k]
            l = max(l, k)
            while l + 1 < len(runs_) and best_after[l + 1] >= low:
                l += 1
            if runs_[l][1] - runs_[k][0] > best:
                best, at = runs_[l][1] - runs_[k][0], (k, l)
        if best < least:
            continue
        out.append((runs_[at[0]][0], runs_[at[1]][1]))
        todo += [runs_[: at[0]], runs_[at[1] + 1 :]]
    return sorted(out)


def _densest(hit: np.ndarray) -> tuple[int, int]:
    """The stretch that scores best with +1 for a hit and -8 for a miss."""
    start = total = best = lo = hi = last = 0
    for a, b in _hit_runs(hit):
        total -= 8 * (a - last)
        if total <= 0:
            start, total = a, 0
        total += b - a
        if total > best:
            best, lo, hi = total, start, b
        last = b
    return lo, hi


Text = tuple[np.ndarray, np.ndarray, np.ndarray]


def indexed(x: np.ndarray) -> Text:
    """A shingle sequence, its places in the order of the shingles, and the shingles in that order."""
    order = np.argsort(x, kind="stable")
    return x, order, x[order]


def passages(x: Text, y: Text) -> list[tuple[int, int, int, int, float]]:
    """Verified passages of two texts: starts and ends (in shingles, ends excluded). Both texts are
    searched, as eight ninths of the shorter side are hits, and so that every occurrence of a passage is
    found in either."""
    out = set(_search(x, y))
    for s, e, lo, hi, v in _search(y, x):
        if not any(l <= lo and hi <= h and t <= s and e <= f for l, h, t, f, _ in out):
            out.add((lo, hi, s, e, v))
    return sorted(out)


def _search(x: Text, y: Text) -> list[tuple[int, int, int, int, float]]:
    out = []
    for lo, hi in stretches(overlap_mask(x[0], y[2])):
        out += _within(x[0], *y, lo, hi)
    return out


def _within(p: np.ndarray, q: np.ndarray, order: np.ndarray, ranked: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int, int, float]]:
    """Passages in a stretch of p. If it is none as a whole, its densest part is tried, then the parts
    before and after the greatest break in its order in q."""
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        got = _aligned(p, q, order, ranked, lo, hi)
        if got is None:  # what makes the other side longer may lie near an end
            hit = overlap_mask(p[lo:hi], ranked)
            a, b = _densest(hit)
            if b - a >= LEAST and (a, b) != (0, hi - lo):
                got = _aligned(p, q, order, ranked, lo + a, lo + b)
        if got is not None:
            out.append(got)
            if (got[0], got[1]) != (lo, hi):
                todo += [(lo, got[0]), (got[1], hi)]
            continue
        hits = lo + np.flatnonzero(hit)
        if len(hits) and (hits[0], hits[-1] + 1) != (lo, hi):
            todo.append((int(hits[0]), int(hits[-1]) + 1))
            continue
        jump = np.abs(np.diff(order[np.searchsorted(ranked, p[hits])] - hits))
        if jump.any():
            k = int(jump.argmax())
            todo += [(int(hits[0]), int(hits[k]) + 1), (int(hits[k + 1]), int(hits[-1]) + 1)]
    return out


def _aligned(p: np.ndarray, q: np.ndarray, order: np.ndarray, ranked: np.ndarray, lo: int, hi: int) -> tuple[int, int, int, int, float] | None:
    """The stretch of q between the ends of p[lo:hi] whose length fits best, if the two are similar."""
    starts = order[np.searchsorted(ranked, p[lo], "left") : np.searchsorted(ranked, p[lo], "right")]
    ends = order[np.searchsorted(ranked, p[hi - 1], "left") : np.searchsorted(ranked, p[hi - 1], "right")]
    want = starts + (hi - 1 - lo)
    at = np.searchsorted(ends, want)
    best = min(((abs(int(e) - int(w)), int(s), int(e)) for s, w, k in zip(starts, want, at, strict=True) for e in ends[max(0, k - 1) : k + 1] if e >= s), default=None)
    if best is None:
        return None
    _, s, e = best
    one, two = np.unique(p[lo:hi]), np.unique(q[s : e + 1])
    common = overlap(one, two)
    union = len(one) + len(two) - common
    if 100 * common >= PERCENT * union and e + 1 - s >= LEAST:
        return lo, hi, s, e + 1, common / union
    return None


def overlap_mask(p: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ranked, p), len(ranked) - 1)
    return ranked[at] == p
