"""Quality rules by distribution divergence.

A document's histograms over character classes and over the common words of its language are
compared with references, one for each value of ``lang``, gathered from all documents: the
square root of the Jensen-Shannon divergence (base 2) lies between 0 and 1. Guards: a document
shorter than MIN_CHARS or MIN_WORDS is not judged by a histogram it cannot fill.

Everything is built-in functions. The text is scanned once for the character classes: runs of
a-z are taken out, and the short rest is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, store

#: Frequent function words of four languages.
COMMON = {
    "de": "auf das den der die ein für ist mit nicht sich und von zu".split(),
    "en": "a and as by for in is it of on that the this to was with".split(),
    "es": "de del el en la las lo los por que se su un y".split(),
    "fr": "de des en est et la le les pas pour que sur un une".split(),
}
ALL_COMMON = sorted({w for words in COMMON.values() for w in words})
#: The same words as they are written: small, with a capital, in capitals.
WRITTEN = sorted({f for w in ALL_COMMON for f in (w, w.capitalize(), w.upper())})
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
#: Thresholds on the two distances, and the least lengths at which they count.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.32, 0.75
MIN_CHARS, MIN_WORDS = 200, 50
#: Fixed values of the base rules.
BASE_MIN_WORDS, BASE_MAX_REPEAT = 50, 50


def _less(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.translate(s, chars, ""))


def window_hashes(words: Column, n: Column) -> Column:
    """A 64-bit hash of each 3-word window."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)).cast("int")), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def repeat_words(windows: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Hashes are sorted with their places;
    equal neighbours are repeats; their places give the number of words covered. Texts without
    repeats are done after a look at the distinct hashes."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(places: Column) -> Column:
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]

    def repeats(sorted_windows: Column) -> Column:
        return F.array_sort(F.transform(F.filter(sorted_windows, lambda x, k: (x["h"] == F.get(sorted_windows, k - 1)["h"]) | (x["h"] == F.get(sorted_windows, k + 1)["h"])), lambda x: x["i"]))

    hit = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(hit, F.element_at(F.transform(F.array(placed), lambda s: covered(repeats(s))), 1)).otherwise(F.lit(0)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """Counts of each document: the base figures, the character histogram and the histogram of
    common words of all languages (with the rest last)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("t")).select(
        "doc_id",
        "lang",
        F.length("t").cast("long").alias("chars"),
        F.regexp_replace("t", "[a-z]+", "").alias("rest"),
        F.filter(F.split("t", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"),
    )
    rest, words = F.col("rest"), F.col("words")
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "space": _less(rest, " \t\n\x0b\x0c\r").cast("long"),
        "n_symbols": _less(rest, "#*$%&|<>").cast("long"),
        "upper": _less(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "digit": _less(rest, "0123456789").cast("long"),
        "punctuation": _less(rest, ".,;:!?'\"()-").cast("long"),
        "lower": F.col("chars") - F.length(rest),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "common": F.transform(F.filter(words, lambda w: w.isin(WRITTEN)), lambda w: F.lower(w)),
        "windows": window_hashes(words, F.size(words)),
    })
    known = F.col("lower") + F.col("upper") + F.col("digit") + F.col("space") + F.col("punctuation") + F.col("n_symbols")
    hits = F.transform(F.array(*[F.lit(w) for w in ALL_COMMON]), lambda c: F.size(F.filter("common", lambda w: w == c)).cast("long"))
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        (F.col("chars") - F.col("space")).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeat_words(F.col("windows")).alias("n_repeat_words"),
        "chars",
        F.array("lower", "upper", "digit", "space", "punctuation", "n_symbols", F.col("chars") - known).alias("char_hist"),
        F.concat(hits, F.array(F.col("n_words") - F.size("common"))).alias("word_hist"),
    )


def references(rows: DataFrame) -> DataFrame:
    """The summed histograms of each language as shares, a row per value of lang. The number of
    rows is the number of languages; each task sends one row per language."""
    width = len(CLASSES), len(ALL_COMMON) + 1
    sums = rows.groupBy("lang").agg(*[F.sum(F.col("char_hist")[k]).alias(f"c{k}") for k in range(width[0])], *[F.sum(F.col("word_hist")[k]).alias(f"w{k}") for k in range(width[1])])
    sums = sums.withColumns({n: F.array(*[F.col(f"{p}{k}") for k in range(w)]) for n, p, w in (("c", "c", width[0]), ("w", "w", width[1]))})
    sums = sums.withColumns({f"{n}_total": F.aggregate(n, F.lit(0).cast("long"), lambda a, v: a + v) for n in "cw"})
    return sums.select(F.col("lang").alias("ref_lang"), shares(F.col("c"), F.col("c_total")).alias("char_ref"), shares(F.col("w"), F.col("w_total")).alias("word_ref"))


def shares(hist: Column, total: Column) -> Column:
    return F.transform(hist, lambda v: v / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two arrays of shares."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, char_distance, word_distance.

    Null text has no words and fails the base rules. Null lang has a reference of its own. Repeated
    rows repeat. An empty table gives an empty result; other columns are not read.
    """
    rows = store(features(docs), "rule-counts")
    refs = references(rows)
    rows = rows.join(refs, rows["lang"].eqNullSafe(refs["ref_lang"]))
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "char_share": shares(F.col("char_hist"), F.col("chars")), "word_share": shares(F.col("word_hist"), F.col("n_words"))})
    rows = rows.withColumns({f"{k}_distance": F.round(js_distance(F.col(f"{k}_share"), F.col(f"{k}_ref")), 6) for k in ("char", "word")})
    odd = ((F.col("chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "char_distance", "word_distance")
