"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of
a word is the sum over all its segmentations into pieces, by a forward pass; a text is the
product over its words (runs of letters, lower case), so each distinct word is scored once and
remembered. Piece probabilities are fitted by expectation-maximisation (forward-backward) on word
counts from a bounded sample of the rows outside the held-out fold (``max_train`` rows of each language by
the hash of their id, a documented parameter).

The model is (pieces in use) x (languages) floats, bounded by the vocabulary.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality_model import fold

WORDS = re.compile(r"[^\W\d_]+")
#: Rows of each language to learn from, rounds of fitting, words that a worker remembers.
MAX_TRAIN, ROUNDS, CACHE = 800, 3, 800_000
#: Bytes of what it remembers about them; bounds it where languages are many.
CACHE_BYTES = 32_000_000
#: Sums over longer words are taken in logarithms, as they could leave the range of doubles.
PLAIN = 40
FLOOR = 1e-7


def letter_runs(text: str) -> list[str]:
    """The maximal runs of letters (Unicode category L), lower case."""
    words = WORDS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    # superscripts, fractions and the like count as word characters, yet are no letters
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def public_pieces(model: bytes) -> list[str]:
    """The vocabulary's pieces of letters, lower case, without space marks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = {sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p.isalpha())


def spots(n: int, longest: int) -> list[tuple[int, int]]:
    """The stretches of a word of n letters that can be pieces, by their ends."""
    return [(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]


def by_length(words: list[str], index: dict[str, int]) -> Iterator[tuple[list[int], list[tuple[int, int]], np.ndarray]]:
    """Words of one length together: their places, the stretches that are a piece or a letter in any of
    them, and the piece in each stretch. Behind the pieces stand an unknown letter and nothing (a longer
    stretch that is no piece)."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    get, letter = index.get, len(index)
    longest = max(map(len, index), default=1)
    for n, at in by.items():
        where = spots(n, longest)
        step = max(1, min(4096, 4_000_000 // len(where)))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            ids = np.array([[get(w[i:j], letter + (j - i > 1)) for i, j in where] for w in [words[k] for k in part]], np.int32)
            used = np.flatnonzero((ids <= letter).any(axis=0))
            yield part, [where[k] for k in used.tolist()], ids[:, used]


def expected(groups: list, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of word counts under p, by forward and backward sums over all segmentations."""
    probs = np.concatenate([p, [FLOOR, 0.0]])
    out = np.zeros(len(probs))
    for part, where, ids in groups:
        n = where[-1][1]
        q = probs[ids]
        if n > PLAIN:
            with np.errstate(divide="ignore"):
                q = np.log(q)
            fore = [np.zeros(len(part))] + [np.full(len(part), -np.inf) for _ in range(n)]
            back = [np.full(len(part), -np.inf) for _ in range(n)] + [np.zeros(len(part))]
            for k, (i, j) in enumerate(where):
                fore[j] = np.logaddexp(fore[j], fore[i] + q[:, k])
            for k in range(len(where) - 1, -1, -1):
                i, j = where[k]
                back[i] = np.logaddexp(back[i], back[j] + q[:, k])
            for k, (i, j) in enumerate(where):
                out += np.bincount(ids[:, k], weights=counts[part] * np.exp(fore[i] + q[:, k] + back[j] - fore[n]), minlength=len(out))
            continue
        fore = [np.ones(len(part))] + [np.zeros(len(part)) for _ in range(n)]
        for k, (i, j) in enumerate(where):
            fore[j] += fore[i] * q[:, k]
        back = [np.zeros(len(part)) for _ in range(n)] + [np.ones(len(part))]
        for k in range(len(where) - 1, -1, -1):
            i, j = where[k]
            back[i] += back[j] * q[:, k]
        share = counts[part] / fore[n]
        for k, (i, j) in enumerate(where):
            out += np.bincount(ids[:, k], weights=share * fore[i] * q[:, k] * back[j], minlength=len(out))
    return out[:-2] + 0.01


def fit(counts: dict[str, Counter], pieces: list[str]) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces in use and their probabilities [pieces, languages]."""
    langs = sorted(counts)
    longest = max(map(len, pieces), default=1)
    seen: set[str] = set()
    for c in counts.values():
        for w in c:
            seen.update(w[i : i + k] for i in range(len(w)) for k in range(1, longest + 1))
    used = [p for p in pieces if p in seen]
    index = {p: k for k, p in enumerate(used)}
    cols = []
    for lang in langs:
        p = np.full(len(used), 1 / max(1, len(used)))
        words = list(counts[lang])
        groups = list(by_length(words, index))
        n = np.array([counts[lang][w] for w in words], float)
        for _ in range(ROUNDS):
            e = expected(groups, n, p)
            p = e / e.sum()
        cols.append(np.maximum(p, FLOOR))
    return langs, used, np.stack(cols, axis=1) if cols else np.zeros((len(used), 0))


class Scorer:
    """Log-probabilities of words, remembered; new words are scored together, by length."""

    def __init__(self, langs: list[str], used: list[str], p: np.ndarray):
        self.langs = langs
        self.index = {piece: k for k, piece in enumerate(used)}
        n = len(langs)
        # Behind the pieces: an unknown letter, and nothing (a longer stretch that is no piece).
        self.p = np.concatenate([p.reshape(len(used), n), np.full((1, n), FLOOR), np.zeros((1, n))])
        self.known: dict[str, int] = {}
        self.cache = max(1000, min(CACHE, CACHE_BYTES // (8 * max(1, n))))
        self.table = np.zeros((self.cache, n))

    def forward(self, words: list[str]) -> np.ndarray:
        """Of each word, in each language, the log of the summed probability of all its segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        for part, where, ids in by_length(words, self.index):
            n = where[-1][1]
            if n > PLAIN:
                with np.errstate(divide="ignore"):
                    log = np.log(self.p)
                fore = [np.zeros((len(part), len(self.langs)))] + [np.full((len(part), len(self.langs)), -np.inf) for _ in range(n)]
                for k, (i, j) in enumerate(where):
                    fore[j] = np.logaddexp(fore[j], fore[i] + log[ids[:, k]])
                out[part] = fore[n]
                continue
            fore = [np.ones((len(part), len(self.langs)))] + [np.zeros((len(part), len(self.langs))) for _ in range(n)]
            for k, (i, j) in enumerate(where):
                fore[j] += fore[i] * self.p[ids[:, k]]
            out[part] = np.log(fore[n])
        return out

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = list(words)
        if new:
            at = len(self.known)
            self.table[at : at + len(new)] = self.forward(new)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share of the posterior under equal priors; ("und", 0.0) without letters."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        totals = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), bool)
        held: list[tuple[int, list[str]]] = []
        n = 0

        def score() -> None:
            self._learn({w for _, words in held for w in words})
            known = self.known
            for k, words in held:
                totals[k] += self.table[[known[w] for w in words]].sum(axis=0)
            held.clear()

        for k, text in enumerate(texts):
            words = letter_runs(text or "")
            seen[k] = bool(words)
            for lo in range(0, len(words), self.cache // 4):
                held.append((k, words[lo : lo + self.cache // 4]))
                n += len(held[-1][1])
                if n >= self.cache // 2:
                    score()
                    n = 0
        score()
        best = totals.argmax(axis=1)
        share = 1 / np.exp(np.minimum(totals - totals.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [(self.langs[b], float(s)) if ok else ("und", 0.0) for b, s, ok in zip(best, share, seen, strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            counts.update((lang, w) for w in letter_runs(text.as_py() or ""))
    rows = sorted(counts.items())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, model_path: str, *, max_train: int = MAX_TRAIN) -> bytes:
    """A pickled model. Rows with null lang or text teach nothing."""
    with open(model_path, "rb") as f:
        pieces = public_pieces(f.read())
    order = F.md5(F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    # a limit within a window is taken in each task before the shuffle
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "__id"))
    picked = usable.select(F.col("doc_id").alias("__id"), "lang", order.alias("rank")).withColumn("nth", nth).where(F.col("nth") <= max_train).select("__id").distinct()
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("__id")))  # max_train rows of a language at most
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def learn(table: pa.Table) -> pa.Table:
        by: dict[str, Counter] = {}
        for lang, word, n in sorted(zip(*(table[c].to_pylist() for c in ("lang", "word", "n")), strict=True)):
            by.setdefault(lang, Counter())[word] = n
        return pa.table({"model": pa.array([pickle.dumps(fit(by, pieces))], pa.binary())})

    got = counts.groupBy().applyInArrow(learn, "model binary").collect()
    return bytes(got[0][0]) if got else pickle.dumps(([], [], np.zeros((0, 0))))


_scorers: dict[int, Scorer] = {}


def identify(docs: DataFrame, model_path: str, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null text or text without letters: ``und`` with score 0. Repeated rows repeat. If nothing can be
    learned every row is ``und``. An empty table gives an empty result; other columns than doc_id, text
    and, in learning, lang are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, model_path, **options))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*pickle.loads(sent.value))
        scorer = _scorers[key]
        for batch in batches:
            got = scorer.texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
