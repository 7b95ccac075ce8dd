"""Codec against the library; classifier and language identification on held-out rows; the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import make, prose

from brindle.llm import language_id, quality_model, sentencepiece_codec
from brindle.llm.queries import piece_model


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.BacktrackingEncoder(open(piece_model(), "rb").read())


def test_codec_is_the_librarys(codec, library):
    rng = random.Random(5)
    alphabet = list("abcdefgtheoinrs ETA.,!\n\t0123▁éüßñ漢字😀 _-('") + [chr(0)]
    for k in range(8000):
        n = rng.randint(0, 40)
        if k % 3 == 0:
            t = "".join(rng.choice(alphabet) for _ in range(n))
        elif k % 3 == 1:
            t = "".join(rng.choice(codec.pieces[259:]) for _ in range(n // 5)).replace("▁", rng.choice([" ", "▁", ""]))
        else:
            t = "".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 126), rng.randint(0x10000, 0x1FFFF)])) for _ in range(n))
        ids = library.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids), repr(t)
        assert codec.both(t) == (",".join(map(str, ids)).encode(), len(ids), library.decode(ids))


def test_codec_on_long_chunks(codec, library):
    rng = random.Random(6)
    for t in ("a" * 5000, "".join(rng.choice("abcdehinorst") for _ in range(20000)), " " * 3000, "▁" * 100):
        assert codec.encode(t) == library.encode(t)


def test_codec_without_chunks(codec, library):
    import re

    rng = random.Random(7)
    whole = sentencepiece_codec.BacktrackingEncoder(open(piece_model(), "rb").read())
    whole.chunk = re.compile(r"(?s).+")
    for _ in range(300):
        t = prose(rng, 12) + rng.choice([".", "!!", "\n"])
        assert whole.encode(t) == library.encode(t)


def test_codec_query(odd, empty, library):
    got = sentencepiece_codec.encode_documents(odd, piece_model(), keep=("doc_id", "text"), with_ids=True).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(empty, piece_model()).count() == 0


def junk(rng, k):
    w = prose(rng, rng.randint(20, 150)).split()
    return [" | ".join(w), " ".join(x + rng.choice(["$$$", "###"]) for x in w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 40 + [w[1]] * 40)][k % 4]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(13)
    rows = [(i, junk(rng, i) if i % 5 == 0 else prose(rng, rng.randint(20, 150), rng.choice(["en", "fr", "de"])), "en", "a") for i in range(900)]
    marks = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, *_ in rows if i % 3], "doc_id bigint, quality int, toxic int")
    return rows, make(spark, rows).cache(), marks.cache()


def test_classifier_on_held_out_rows(labelled, odd, empty):
    rows, docs, marks = labelled
    got = {r["doc_id"]: r for r in quality_model.score_documents(docs, marks).collect()}
    for i, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    held = [i for i, *_ in rows if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 5 != 0) for i in held]) > 0.95
    assert np.mean([got[i]["predicted"] for i in held if i % 5]) > 0.98
    some = quality_model.score_documents(odd, marks).collect()
    assert len(some) == odd.count() and all(0 <= r["score"] <= 1 for r in some)
    assert quality_model.score_documents(empty, marks).count() == 0
    assert {r["score"] for r in quality_model.score_documents(odd, marks.limit(0)).collect()} == {0.5}
    kept = quality_model.keep_good(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["predicted"]}


def test_ftrl_against_dense_steps():
    rng = np.random.default_rng(1)
    m = quality_model.Ftrl()
    z, n = np.zeros(6), np.zeros(6)
    for _ in range(50):
        idx, x, y = rng.permutation(6)[:3], rng.random(3), int(rng.integers(0, 2))
        m.update(idx, x, y)
        w = np.array([0.0 if abs(a) <= quality_model.L1 else -(a - math.copysign(quality_model.L1, a)) / ((quality_model.BETA + math.sqrt(b)) / quality_model.ALPHA + quality_model.L2) for a, b in zip(z, n)])
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(idx, x))))
        for i, v in zip(idx, x):
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_model.ALPHA * w[i]
            n[i] += g * g
    assert np.allclose(m.z[:6], z) and np.allclose(m.n[:6], n)


def test_forward_sums_all_segmentations():
    used = ["a", "b", "ab", "ba", "aba"]
    p = np.array([[0.2, 0.1], [0.3, 0.2], [0.1, 0.3], [0.2, 0.2], [0.2, 0.2]])
    s = language_id.Scorer(["x", "y"], used, p)

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            if word[:n] in used:
                out += p[used.index(word[:n]), k] * total(word[n:], k)
            elif n == 1:
                out += language_id.FLOOR * total(word[1:], k)
        return out

    words = ["a", "ab", "aba", "abab", "bbab", "zab", "aza"]
    got = s.forward(words)
    assert np.allclose(got, [[math.log(total(w, k)) for k in (0, 1)] for w in words])


def test_long_words_and_pieces():
    """Words of more than 40 letters and pieces of more than 8: all segmentations, forward and in the fit."""
    pieces = ["a", "b", "ab", "abababababab", "bababababa"]
    p = np.array([0.3, 0.2, 0.2, 0.2, 0.1])
    word = "ab" * 30 + "zb"
    ways = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for n in range(1, min(j, 12) + 1):
            piece = word[j - n : j]
            ways[j] += ways[j - n] * (p[pieces.index(piece)] if piece in pieces else language_id.FLOOR if n == 1 else 0)
    got = language_id.Scorer(["x"], pieces, p[:, None]).forward([word, "ab", "ab" * 40_000])
    assert got[0][0] == pytest.approx(math.log(ways[-1])) and np.isfinite(got).all()
    index = {x: k for k, x in enumerate(pieces)}
    for w in ("ab" * 10, "ab" * 30):  # expected letters add up to the word, in doubles and in logarithms
        e = language_id.expected(list(language_id.by_length([w], index)), np.array([2.0]), p) - 0.01
        assert sum(n * len(x) for n, x in zip(e, pieces, strict=True)) == pytest.approx(2 * len(w))


def test_letters_only(spark):
    assert language_id.letter_runs("x² ½ Ⅷ Straße_7b") == ["x", "straße", "b"]
    rows = [(k, "the and of " * 5, "en", "a") for k in range(20)] + [(50, "² ½ Ⅷ 7", "en", "a"), (51, "the", None, "a")]
    rows += [(60 + k, "rare words of a tongue", "xx", "a") for k in range(3)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(make(spark, rows), piece_model(), max_train=5).collect()}
    assert got[50] == "und" and got[51] == "en" and got[61] == "xx"


def test_language_on_held_out_rows(spark, odd, empty):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(15, 80), lang) + ".", lang if i % 7 else None, "a") for i in range(600) for lang in [rng.choice(["en", "fr", "de"])]]
    truth = {}
    rng = random.Random(14)
    for i in range(600):
        lang = rng.choice(["en", "fr", "de"])
        truth[i] = lang
        prose(rng, rng.randint(15, 80), lang)
    got = {r["doc_id"]: r for r in language_id.identify(make(spark, rows), piece_model()).collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert held and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.9
    some = {r["doc_id"]: r for r in language_id.identify(odd, piece_model()).collect()}
    assert some[1]["lang_pred"] == some[2]["lang_pred"] == some[3]["lang_pred"] == "und" and some[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in some.values())
    assert language_id.identify(empty, piece_model()).count() == 0


def test_pipeline(spark, tmp_path, labelled, library):
    import re

    import corpus_pipeline as C

    rows, docs, marks = labelled
    texts = [(i, t, lang, src) for i, t, lang, src in rows] + [(5000 + i, rows[i][1], "en", "b") for i in range(0, 60)] + [(6000 + i, rows[i][1] + " more", "en", "c") for i in range(1, 40)]
    base = make(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    at = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    out = {}
    for name, stage in C.STAGES:
        at = stage(spark, at, d)
        if name != names[-1]:
            assert at.columns == base.columns
        at = at.cache()
        out[name] = at.collect()
    good = [(r["doc_id"], r["text"]) for r in out[names[0]]]
    score = {r["doc_id"]: r["predicted"] for r in quality_model.score_documents(base, marks).collect()}
    assert sorted(i for i, _ in good) == sorted(i for i, p in score.items() if p)
    last = {}
    for i, t in good:
        last[t] = max(i, last.get(t, -1))
    assert sorted(r["doc_id"] for r in out[names[1]]) == sorted(last.values())
    from test_duplicates import brute_components

    comp = brute_components([(i, t) for t, i in last.items()])
    assert sorted(r["doc_id"] for r in out[names[2]]) == sorted({c for _, c in comp.values()})
    words = Counter()
    for r in out[names[3]]:
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    sizes = Counter()
    for r in out[names[2]]:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    want = sorted((r["doc_id"], library.encode(r["text"])) for r in out[names[3]])
    assert sorted((r["doc_id"], r["ids"]) for r in out[names[4]]) == want
    assert sorted((r["doc_id"], r["ids"]) for r in C.run(spark, d).collect()) == want
