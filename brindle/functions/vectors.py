"""Row-wise vector algebra as array expressions.

All functions take and return columns. Sums run in double precision whatever the element type.
Vectors of no elements come back unchanged; null vectors stay null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is computed once; a column named inside a lambda would be
    computed anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def max_abs(v: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(doubles(v), lambda x: F.abs(x))), F.lit(0.0))


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    """P5."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """A norm below eps counts as eps, so zero rows stay zero."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(doubles(v), lambda x: x / n))


def affine(v: Column, matrix: Sequence[Sequence[float]], center: Sequence[float] | None = None) -> Column:
    """P1, P2, P3, P6 for narrow matrices: one dot product per row of the matrix. Wide ones go
    through ``operators.linear.apply_linear``."""
    x = subtract(v, literal(center)) if center is not None else doubles(v)
    return F.array(*[dot(x, literal(row)) for row in matrix])


def energy(v: Column) -> Column:
    """Shares of the squared norm. Dividing by the largest magnitude first keeps squares in
    range; all-zero rows give zeros; rows with a non-finite element are not rescaled."""
    by = let(max_abs(v), lambda top: F.when((top > 0) & (top < float("inf")) & ~F.isnan(top), top).otherwise(F.lit(1.0)))
    sq = let(by, lambda b: F.transform(doubles(v), lambda x: (x / b) * (x / b)))
    return let(sq, lambda q: let(total(q), lambda s: F.transform(q, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0)))))


def _largest(v: Column, k: int) -> Column:
    """Indices of the k largest magnitudes, ties to the lower index."""
    ranked = F.array_sort(F.transform(doubles(v), lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def keep_topk(v: Column, k: int) -> Column:
    """P8."""
    if k < 1:
        return scale(v, 0.0)
    return let(_largest(v, k), lambda top: F.transform(doubles(v), lambda x, i: F.when(F.array_contains(top, i), x).otherwise(F.lit(0.0))))


def ablate_topk(v: Column, k: int) -> Column:
    """P9."""
    if k < 1:
        return doubles(v)
    return let(_largest(v, k), lambda top: F.transform(doubles(v), lambda x, i: F.when(F.array_contains(top, i), F.lit(0.0)).otherwise(x)))


def restore_norm(v: Column, reference: Column, eps: float = EPS) -> Column:
    """P10."""
    return let(norm(reference) / F.greatest(norm(v), F.lit(eps)), lambda by: F.transform(doubles(v), lambda x: x * by))


def clamp(v: Column, values: Mapping[int, float]) -> Column:
    """Sets chosen coordinates."""
    def at(k: int, value: float, v: Column) -> Column:
        return F.transform(doubles(v), lambda x, i: F.when(i == k, F.lit(float(value))).otherwise(x))

    for k, value in values.items():
        v = at(k, value, v)
    return v


def capped_offset(score: Column, offset: Column | float, cap: Column | float) -> Column:
    """Moves a score towards a cap, by ``offset`` at most and never past the cap."""
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    room = cap - score
    return F.when(offset > 0, F.greatest(F.lit(0.0), F.least(offset, room))).when(offset < 0, F.least(F.lit(0.0), F.greatest(offset, room))).otherwise(F.lit(0.0))


def steer(v: Column, writing: Sequence[Sequence[float]], offsets: Mapping[int, float]) -> Column:
    """Adds offset times the writing direction of each chosen component (column of ``writing``)."""
    for c, offset in offsets.items():
        v = add(v, literal([offset * row[c] for row in writing]))
    return v


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Sample standard deviation, eps added to it."""
    n = F.size(v)
    centered = let(total(v) / n, lambda mean: F.transform(doubles(v), lambda x: x - mean))
    return let(centered, lambda c: let(F.sqrt(dot(c, c) / (n - 1)) + eps, lambda sd: F.transform(c, lambda x: x / sd)))


def split_sign(v: Column) -> Column:
    """Positive parts, then magnitudes of negative parts."""
    return F.concat(F.transform(doubles(v), lambda x: F.greatest(x, F.lit(0.0))), F.transform(doubles(v), lambda x: F.greatest(-x, F.lit(0.0))))


def join_sign(v: Column) -> Column:
    """The exact inverse of ``split_sign``."""
    n = (F.size(v) / 2).cast("int")
    return F.zip_with(F.slice(doubles(v), F.lit(1), n), F.slice(doubles(v), n + 1, n), lambda p, q: p - q)


def interchange(base: Column, source: Column, mask: Sequence[float]) -> Column:
    """(1 - m) * base + m * source."""
    m = literal(mask)
    return add(F.zip_with(doubles(base), m, lambda x, w: x * (1 - w)), F.zip_with(doubles(source), m, lambda x, w: x * w))


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def nmse(x: Column, approximation: Column, eps: float = EPS) -> Column:
    """Squared error over the squared norm."""
    d = subtract(x, approximation)
    return dot(d, d) / F.greatest(dot(x, x), F.lit(eps))


def all_finite(v: Column) -> Column:
    """P30."""
    return F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def require_finite(v: Column, width: int | None = None) -> Column:
    """The vector itself; rows with other widths or non-finite elements raise an error."""
    ok = all_finite(v) if width is None else all_finite(v) & (F.size(v) == width)
    return F.when(ok, v).otherwise(F.raise_error(F.lit("vector has a non-finite element or another width")))
