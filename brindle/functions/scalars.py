"""Scalar functions (section 2.8): contrasts, strings, hashes, predicates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)
#: Expectations of the contrasts under a standard normal variable.
GAUSSIAN = {"logcosh": 0.37456720748834715, "exp": -1 / math.sqrt(2.0), "cube": 0.75}


def logcosh(x: Column) -> Column:
    """log(cosh(x)) without overflow."""
    return F.abs(x) + F.log1p(F.exp(-2 * F.abs(x))) - LN2


def contrast(x: Column, kind: str) -> Column:
    """A10."""
    return {"logcosh": logcosh(x), "exp": -F.exp(-x * x / 2), "cube": F.pow(x, F.lit(4.0)) / 4}[kind]


def slope(x: Column, kind: str) -> Column:
    """The contrast's derivative."""
    return {"logcosh": F.tanh(x), "exp": x * F.exp(-x * x / 2), "cube": F.pow(x, F.lit(3.0))}[kind]


def derived_seed(*parts: Column) -> Column:
    """First 15 hex digits of the SHA-256 of the joined parts, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def hash_order(seed: int | str, *key: Column) -> Column:
    """A pseudo-random order of rows that any engine can reproduce."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def geometric_midpoint(lo: Column, hi: Column) -> Column:
    """Exact where the bounds are adjacent: then the upper one."""
    return F.when(hi - lo == 1, hi.cast("double")).otherwise(F.sqrt(lo * hi))


def suffix_lengths(n: int, most: int) -> list[int]:
    """1..n, then 2n, 4n, and on by fours up to ``most``."""
    out, k = list(range(1, min(n, most) + 1)), 2 * n
    step = 2
    while k <= most:
        out.append(k)
        k, step = k * step, 4
    return out


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below x; 0 lies below the first."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x))


def even_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """0..n-1 over [lo, hi], the upper edge in the last bin; null outside."""
    k = F.floor((x - lo) / (hi - lo) * n)
    return F.when((x < lo) | (x > hi), None).otherwise(F.least(k, F.lit(n - 1))).cast("long")


def symlog(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def visible_newlines(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit("↵"))


def marked_target(s: Column) -> Column:
    """The text between the first pair of double brackets, or empty."""
    return F.regexp_extract(s, r"\[\[(.*?)\]\]", 1)


def trailing_number(s: Column, stem: str) -> Column:
    """The digits behind ``stem``; null if there are none."""
    got = F.regexp_extract(s, rf"{stem}_([0-9]+)", 1)
    return F.when(got != "", got.cast("long"))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def activation_labels(v: Column, top: Column, steps: int = 10) -> Column:
    """0..steps by the share of the group's largest value; zeros where that is not positive."""
    return F.when(top > 0, F.least(F.lit(float(steps)), F.floor(steps * F.greatest(v, F.lit(0.0)) / F.when(top > 0, top).otherwise(F.lit(1.0))))).otherwise(F.lit(0.0)).cast("long")


def indexed_labels(json: Column, n: int) -> Column:
    """Strict parse of {"0": a, ..., "n-1": z}: null unless exactly these keys are there with numbers."""
    m = F.from_json(json, "map<string,double>")
    values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(m, i.cast("string")))
    return F.when((F.size(m) == n) & F.forall(values, lambda x: x.isNotNull()), values)
