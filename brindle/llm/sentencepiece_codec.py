"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by backtracking.

``BacktrackingEncoder`` finds, for each position of a chunk, the vocabulary pieces that start
there (one Aho-Corasick pass), takes the longest, and accepts it behind the piece before it only
if the two are compatible: merging their joined characters anew must give the same two pieces.
Where no piece fits, the position is struck off a bitfield and the walk steps back. The library
is used only to read the vocabulary file.

Defined results: null text counts as empty; an empty text has no ids and decodes to "".
Characters outside the vocabulary become their UTF-8 byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "▁"
#: Chunks that one worker remembers, in two generations: when the young one is full it becomes the
#: old one, from which chunks that are met again come back.
CACHE = 400_000
PAIR_CACHE = 200_000


class BacktrackingEncoder:
    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: list[str] = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {v: k for k, v in self.byte_id.items()}
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no full byte fallback")
        for probe in ("a  b ", "ﬁ½\t\n", "é"):
            if sp.normalize(probe) != META + probe.replace(" ", META):
                raise ValueError("only vocabularies without text normalisation are supported")
        # A piece that the merges never reach cannot stand in an encoding.
        reached = {p for p in self.id if len(p) == 1 or self.merge(p) == [p]}
        self.tree = ahocorasick.Automaton()
        for p in reached:
            self.tree.add_word(p, (p, len(p) - 1))
        self.tree.make_automaton()
        #: The longest reached proper prefix of each reached piece.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), None) for p in reached}
        self.chunk = self._chunks(list(self.id))
        self.capacity = CACHE
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[bytes, int, str | None]] = {}
        self.old: dict[str, tuple[bytes, int, str | None]] = {}

    @staticmethod
    def _chunks(pieces: list[str]) -> re.Pattern:
        """Cuts text where no piece can span: before a space mark that does not follow another
        and, if the vocabulary allows it, behind a letter that no letter follows."""
        if any(META in p.lstrip(META) for p in pieces):
            return re.compile(r"(?s).+")
        if any(re.search(r"[^\W\d_](?=[\W\d_])", p) for p in pieces):
            return re.compile(rf"{META}+[^{META}]*|[^{META}]+")
        return re.compile(rf"{META}*(?:[^{META}\w]|[\d_])*[^\W\d_]+|{META}+(?:[^{META}\w]|[\d_])*|(?:[^{META}\w]|[\d_])+")

    def merge(self, text: str) -> list[str]:
        """Merges adjacent symbols, best score first, then leftmost, until none can be merged."""
        out = list(text)
        score = self.score
        while len(out) > 1:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = score.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= PAIR_CACHE:
                self.fits.clear()
            got = self.fits[key] = self.merge(a + b) == [a, b]
        return got

    def split(self, text: str) -> list[str]:
        """The pieces of one chunk; characters without a piece stand alone."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, (p, back) in self.tree.iter(text):
            longest[end - back] = p  # of one start, longer pieces come later
        live = bytearray(b"\x01") * (n + 1)
        out: list[str] = []
        fits, shorter, compatible = self.fits, self.shorter, self.compatible
        at, take, last = 0, longest[0] or text[0], ""
        while at < n:
            end = at + len(take)
            if live[end] and (not last or (fits[last, take] if (last, take) in fits else compatible(last, take))):
                out.append(take)
                at, last = end, take
                if at < n:
                    take = longest[at] or text[at]
                continue
            less = shorter.get(take)
            if less is not None:
                take = less
                continue
            live[at] = 0
            if not out:
                raise ValueError(f"no encoding of {text!r}")
            take = out.pop()
            at -= len(take)
            last = out[-1] if out else ""
        return out

    def ids(self, piece: str) -> list[int]:
        own = self.id.get(piece)
        return [own] if own is not None else [self.byte_id[b] for b in piece.encode()]

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(META + text.replace(" ", META)) if text else []

    def lookup(self, chunk: str) -> tuple[bytes, int, str | None]:
        """A chunk's ids as text, their count, and what they decode to (None: the chunk itself, as its
        pieces put together again)."""
        if len(self.known) >= self.capacity // 2:
            self.old, self.known = self.known, {}
        got = self.old.get(chunk)
        if got is None:
            pieces = self.split(chunk)
            try:
                ids = [self.id[p] for p in pieces]
                surface = None
            except KeyError:
                ids = [i for p in pieces for i in self.ids(p)]
                surface = self.surface(ids)
            got = (",".join(map(str, ids)).encode(), len(ids), surface)
        if len(chunk) <= 64:
            self.known[chunk] = got
        return got

    def surface(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[i].replace(META, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        known = self.known
        out: list[int] = []
        for c in self.chunks(text):
            got = known.get(c) or self.lookup(c)
            out += map(int, got[0].split(b","))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the one space mark that encoding puts in front is taken off."""
        text = self.surface(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(META) else text

    def both(self, text: str) -> tuple[bytes, int, str]:
        """The ids as comma-joined text, their count, and the decoded text, chunk by chunk: bytes
        of one character never cross a chunk, so decoding chunks one by one is decoding the whole."""
        known, lookup = self.known, self.lookup
        chunks = self.chunks(text)
        got = [known.get(c) or lookup(c) for c in chunks]
        if not got:
            return b"", 0, ""
        text = "".join([c if g[2] is None else g[2] for c, g in zip(chunks, got, strict=True)]).replace(META, " ")
        first = got[0][0].split(b",", 1)[0]
        return b",".join([g[0] for g in got]), sum([g[1] for g in got]), text[1:] if self.pieces[int(first)].startswith(META) else text


_encoders: dict[int, BacktrackingEncoder] = {}


def encoder(model: bytes) -> BacktrackingEncoder:
    """One encoder for each worker and vocabulary."""
    key = hash(model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = BacktrackingEncoder(model)
    return _encoders[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """One row per document: the ``keep`` columns, n_tokens, the digests of ids and decoded text,
    and with ``with_ids`` the ids. ``cache`` chunks are remembered by a worker. The vocabulary file is read on the driver and sent along (it
    has a fixed size). Null text counts as empty; rows are independent of each other, so repeated
    rows repeat; an empty table gives an empty result; other columns are not touched.
    """
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(model.value)
        enc.capacity = cache
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            counts, id_digests, text_digests, parts, offsets = [], [], [], [], [0]
            for t in texts:
                joined, n, back = enc.both(t.as_py())
                counts.append(n)
                id_digests.append(hashlib.sha256(joined).hexdigest())
                text_digests.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    parts.append(np.array(joined.split(b",") if joined else [], dtype="S").astype(np.int32))
                    offsets.append(offsets[-1] + n)
            cols = [batch.column(k) for k in range(len(keep))]
            cols += [pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, schema)
