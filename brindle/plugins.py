"""The boundary to models: anything that turns token rows into vectors (section 2.12).

``ToySource`` is the one implementation that is shipped: it needs no model, yet is causal and
depends on context, so captures, suffix sweeps and contexts can be run and tested.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a worker holds for its output.
HELD = 1 << 20
#: Numbers that a ``ToySource`` remembers in a worker.
REMEMBERED = 1 << 22

_MULT = 2549297995355413924 << 64 | 4865540595714422341


def _pcg64_states(seeds: np.ndarray) -> list[tuple[int, int]]:
    """State and increment of ``np.random.PCG64(seed)`` for each seed, as SeedSequence spreads it."""
    u, low = np.uint32, 2**32 - 1
    const, pool = 0x43B0D7E5, []

    def hashed(x: np.ndarray, mult: int) -> np.ndarray:
        nonlocal const
        x = x ^ u(const)
        const = const * mult & low
        x = x * u(const)
        return x ^ x >> u(16)

    for word in ((seeds & np.uint64(low)).astype(u), (seeds >> np.uint64(32)).astype(u), np.zeros(len(seeds), u), np.zeros(len(seeds), u)):
        pool.append(hashed(word, 0x931E8875))
    for src in range(4):
        for dst in range(4):
            if src != dst:
                x = pool[dst] * u(0xCA01F9DD) - hashed(pool[src], 0x931E8875) * u(0x4973F715)
                pool[dst] = x ^ x >> u(16)
    const = 0x8B51F9DD
    words = [hashed(pool[k % 4], 0x58F38DED).astype(np.uint64) for k in range(8)]
    out = []
    for a, b, c, d in zip(*((words[k] | words[k + 1] << np.uint64(32)).tolist() for k in (0, 2, 4, 6)), strict=True):
        inc = ((c << 64 | d) << 1 | 1) & 2**128 - 1
        out.append((((inc + (a << 64 | b)) * _MULT + inc) & 2**128 - 1, inc))
    return out


class ActivationSource(Protocol):
    """One document in, one vector for each token and layer out. A source may also have
    ``resume(tokens, layers, state)``, which goes on where a state ended (None: at the beginning) and returns
    the vectors and the next state; long documents then pass in pieces."""

    width: int
    sites: tuple[str, ...]

    def run(self, tokens: Sequence[str], layers: Sequence[int]) -> dict[int, np.ndarray]: ...


class ToySource:
    """A token's own vector is a unit vector drawn from its MD5; the state is the exponential average
    over the positions so far, more slowly decaying in later layers."""

    sites = ("residual",)

    def __init__(self, width: int = 16, decay: float = 0.5):
        self.width, self.decay = width, decay

    def token_vector(self, token: str) -> np.ndarray:
        return self.token_vectors([token])[0]

    def token_vectors(self, tokens: Sequence[str]) -> np.ndarray:
        """The draws of ``default_rng(seed)`` for each token, over one generator."""
        seeds = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big") for t in tokens], np.uint64)
        bits = np.random.PCG64(0)
        rng, out = np.random.Generator(bits), np.empty((len(tokens), self.width))
        for row, (state, inc) in zip(out, _pcg64_states(seeds), strict=True):
            bits.state = {"bit_generator": "PCG64", "state": {"state": state, "inc": inc}, "has_uint32": 0, "uinteger": 0}
            rng.standard_normal(out=row)
            row /= math.sqrt(row.dot(row))
        return out

    def _vectors(self, tokens: Sequence[str]) -> np.ndarray:
        """The tokens' own vectors; as many as REMEMBERED allows are kept."""
        if not hasattr(self, "_known"):
            self._known = {}, np.empty((REMEMBERED // self.width, self.width))
        known, table = self._known
        fresh = [t for t in dict.fromkeys(tokens) if t not in known]
        if len(known) + len(fresh) > len(table):
            known.clear()
            fresh = list(dict.fromkeys(tokens))
            if len(fresh) > len(table):
                return self.token_vectors(tokens)
        if fresh:
            table[len(known) : len(known) + len(fresh)] = self.token_vectors(fresh)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        return table[np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))]

    def __reduce__(self):
        return type(self), (self.width, self.decay)

    def resume(self, tokens: Sequence[str], layers: Sequence[int], state: np.ndarray | None) -> tuple[dict[int, np.ndarray], np.ndarray]:
        keep = np.array([self.decay ** (1 / (layer + 1)) for layer in layers]).reshape(-1, 1)
        at = np.zeros((len(layers), self.width)) if state is None else state
        out = (1 - keep) * self._vectors(tokens)[:, None, :]
        for row in out:
            row += keep * at
            at = row
        return {layer: out[:, k] for k, layer in enumerate(layers)}, at.copy()

    def run(self, tokens: Sequence[str], layers: Sequence[int]) -> dict[int, np.ndarray]:
        return self.resume(tokens, layers, None)[0]


def check_site(source: ActivationSource, site: str) -> None:
    """X2."""
    if site not in source.sites:
        raise ValueError(f"the source has no site {site!r}; it has {', '.join(source.sites)}")


def capture(tokens: DataFrame, source: ActivationSource, layers: Sequence[int], *, doc: str = "doc_id", pos: str = "pos", token: str = "token", context: int | None = 2048, ordered: bool = False) -> DataFrame:
    """Doc, pos, token, layer, vec for each token. A document's tokens are sorted in one partition and cut
    to ``context`` tokens (None: whole documents); all layers come from one run. ``ordered`` says that
    they lie so already. Tokens pass through: a worker holds a piece of a document if the source can
    resume, else one document with its vectors."""
    rows = tokens.where(F.col(pos).isNotNull() if context is None else F.col(pos) < context).select(F.col(doc).cast("long").alias(doc), F.col(pos).cast("long").alias(pos), token)
    if not ordered:
        rows = rows.repartition(doc).sortWithinPartitions(doc, pos, token)
    sent = tokens.sparkSession.sparkContext.broadcast((source, tuple(layers)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, layers = sent.value
        if not layers:
            return
        most = max(1, HELD // max(1, len(layers) * source.width))
        for pieces in _gathered(_captured(batches, source, layers, most), most):
            n = [len(at) for _, at, _, _ in pieces for _ in layers]
            vec = np.concatenate([np.asarray(got[layer], np.float64) for _, _, _, got in pieces for layer in layers])
            columns = [
                pa.concat_arrays([pa.array([d], pa.int64()).take(pa.array(np.zeros(len(at), np.int64))) for d, at, _, _ in pieces for _ in layers]),
                pa.concat_arrays([at for _, at, _, _ in pieces for _ in layers]),
                pa.concat_arrays([ts for _, _, ts, _ in pieces for _ in layers]).cast(pa.string()),
                pa.array(np.repeat(np.tile(np.array(layers, np.int32), len(pieces)), n)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * np.int32(vec.shape[1])), pa.array(vec.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[doc, pos, token, "layer", "vec"])

    return rows.mapInArrow(run, f"{doc} bigint, {pos} bigint, {token} string, layer int, vec array<double>")


#: Of a document: its id, positions, tokens and the vectors of each layer.
Piece = tuple[int | None, pa.Array, pa.Array, dict[int, np.ndarray]]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, pa.Array, pa.Array, bool]]:
    """The runs of rows of one document in each batch, and whether a run begins another document than the last."""
    last: tuple = ()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        cuts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
        for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            yield ids[lo], batch.column(1)[lo:hi], batch.column(2)[lo:hi], last != (ids[lo],)
            last = (ids[lo],)


def _captured(batches: Iterator[pa.RecordBatch], source: ActivationSource, layers: Sequence[int], most: int) -> Iterator[Piece]:
    """Pieces of at most ``most`` tokens with their vectors."""
    if hasattr(source, "resume"):
        state = None
        for d, at, ts, fresh in _documents(batches):
            state = None if fresh else state
            for k in range(0, len(at), most):
                got, state = source.resume(ts[k : k + most].to_pylist(), layers, state)
                yield d, at[k : k + most], ts[k : k + most], got
        return
    held: list[tuple] = []

    def whole() -> Iterator[Piece]:
        if held:
            at, ts = pa.concat_arrays([x[1] for x in held]), pa.concat_arrays([x[2] for x in held])
            got = source.run(ts.to_pylist(), layers)
            for k in range(0, len(at), most):
                yield held[0][0], at[k : k + most], ts[k : k + most], {layer: got[layer][k : k + most] for layer in layers}

    for d, at, ts, fresh in _documents(batches):
        if fresh:
            yield from whole()
            held = []
        held.append((d, at, ts))
    yield from whole()


def _gathered(pieces: Iterator[Piece], most: int) -> Iterator[list[Piece]]:
    """Pieces together, up to twice ``most`` tokens."""
    held: list[Piece] = []
    n = 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held
