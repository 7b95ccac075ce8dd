"""Independent component analysis over distributed vectors.

The driver holds K x K and K x d matrices only. Each step of the fixed point is one pass over the
cached whitened rows. Fits run their full number of iterations; there is no early stop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.scalars import GAUSSIAN
from ..operators.linear import apply_linear, normalised, sum_pass

PERCENTILES = tuple(range(0, 101, 10))


@dataclass
class Fit:
    center: np.ndarray
    reading: np.ndarray  # [K, d], applied to centered rows
    writing: np.ndarray  # [d, K]
    whitening: np.ndarray
    unmixing: np.ndarray
    objectives: np.ndarray
    strengths: np.ndarray
    n_rows: int
    pre_center: np.ndarray | None = None
    l2: bool = False
    history: list[dict] = field(default_factory=list)
    held_out: list[dict] = field(default_factory=list)


def _value(s: np.ndarray, kind: str) -> np.ndarray:
    if kind == "logcosh":
        return np.abs(s) + np.log1p(np.exp(-2 * np.abs(s))) - np.log(2)
    return -np.exp(-s * s / 2) if kind == "exp" else s**4 / 4


def _slopes(s: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    if kind == "logcosh":
        t = np.tanh(s)
        return t, 1 - t * t
    if kind == "exp":
        e = np.exp(-s * s / 2)
        return s * e, (1 - s * s) * e
    return s**3, 3 * s * s


def mean_vector(df: DataFrame, *, pre_center=None, l2: bool = False, vec: str = "vec") -> tuple[int, np.ndarray]:
    """A1."""
    def partial(x):
        x = normalised(x, pre_center, l2)
        return [np.array([len(x)], float), x.sum(axis=0)]

    got = sum_pass(df, partial, vec=vec)
    if not got:
        raise ValueError("there are no rows")
    return int(got[0][0]), got[1] / got[0][0]


def scatter_matrix(df: DataFrame, center: np.ndarray, *, pre_center=None, l2: bool = False, vec: str = "vec") -> np.ndarray:
    """A2: the sum of outer products of centered rows, not divided by their number."""
    def partial(x):
        x = normalised(x, pre_center, l2) - center
        return [x.T @ x]

    return sum_pass(df, partial, vec=vec)[0]


def correlations(df: DataFrame, *, vec: str = "vec") -> np.ndarray:
    """Correlation matrix of the coordinates; NaN where one is constant."""
    n, mean = mean_vector(df, vec=vec)
    cov = scatter_matrix(df, mean, vec=vec) / n
    sd = np.sqrt(np.diag(cov))
    with np.errstate(invalid="ignore", divide="ignore"):
        return cov / np.outer(sd, sd)


def geometric_median(df: DataFrame, *, steps: int = 50, tol: float = 1e-5, vec: str = "vec") -> np.ndarray:
    """Weiszfeld steps from the mean, until the move is below ``tol`` times max(norm, 1)."""
    _, m = mean_vector(df, vec=vec)
    for _ in range(steps):
        at = m

        def partial(x, at=at):
            w = 1 / np.maximum(np.linalg.norm(x - at, axis=1), 1e-12)
            return [np.array([w.sum()]), w @ x]

        total, moved = sum_pass(df, partial, vec=vec)
        m = moved / total[0]
        if np.linalg.norm(m - at) <= tol * max(np.linalg.norm(at), 1.0):
            break
    return m


def whitening_matrix(scatter: np.ndarray, n: int, k: int) -> np.ndarray:
    """M2: rows scale to unit variance over n rows. Too low a rank is an error; the sign of each row
    makes its first element positive."""
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = values[::-1], vectors[:, ::-1]
    floor = np.finfo(float).eps * max(scatter.shape) * max(values[0], 0)
    if values[k - 1] <= floor:
        raise ValueError(f"the rows have a rank below {k}")
    rows = vectors[:, :k].T
    rows = rows * np.where(rows[:, :1] < 0, -1.0, 1.0)
    return rows / np.sqrt(values[:k, None]) * np.sqrt(n)


def decorrelate(w: np.ndarray) -> np.ndarray:
    """M5: (W W')^(-1/2) W."""
    values, vectors = np.linalg.eigh(w @ w.T)
    return (vectors / np.sqrt(np.maximum(values, np.finfo(float).eps))) @ vectors.T @ w


def _moments(white: DataFrame, w: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    def partial(x):
        g, slope = _slopes(x @ w.T, kind)
        return [g.T @ x, slope.sum(axis=0)]

    a, b = sum_pass(white, partial)
    return a, b


def component_means(rows: DataFrame, directions: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Mean of f(row . direction) for each direction."""
    got = sum_pass(rows, lambda x: [np.array([len(x)], float), f(x @ directions.T).sum(axis=0)])
    return got[1] / got[0][0]


def excess_kurtosis(rows: DataFrame, directions: np.ndarray) -> np.ndarray:
    """A3, A4: from power sums about a first-pass mean."""
    got = sum_pass(rows, lambda x: [np.array([len(x)], float), (x @ directions.T).sum(axis=0)])
    mean = got[1] / got[0][0]

    def partial(x):
        d = x @ directions.T - mean
        return [(d**2).sum(axis=0), (d**4).sum(axis=0)]

    m2, m4 = sum_pass(rows, partial)
    return got[0][0] * m4 / np.maximum(m2, 1e-300) ** 2 - 3


def fit_fastica(
    df: DataFrame,
    n_components: int,
    *,
    vec: str = "vec",
    max_iter: int = 50,
    contrast: str = "logcosh",
    algorithm: str = "parallel",
    seed: int = 0,
    l2: bool = True,
    pre_center: str | None = None,
    objective_every: int | None = None,
    held_out: DataFrame | None = None,
    held_out_every: int = 10,
    checkpoint: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None] | None = None,
    initial_unmixing: np.ndarray | None = None,
    start_iteration: int = 0,
) -> Fit:
    """M1. Rows: an array column ``vec``. ``pre_center``: None or "geometric_median"."""
    if contrast not in GAUSSIAN or algorithm not in ("parallel", "deflation"):
        raise ValueError("unknown contrast or algorithm")
    pre = geometric_median(df, vec=vec) if pre_center == "geometric_median" else None
    n, center = mean_vector(df, pre_center=pre, l2=l2, vec=vec)
    k, d = n_components, len(center)
    if not 1 <= k <= min(n - 1, d):
        raise ValueError(f"n_components must lie between 1 and {min(n - 1, d)}")
    whitening = whitening_matrix(scatter_matrix(df, center, pre_center=pre, l2=l2, vec=vec), n, k)

    def prepare(rows: DataFrame) -> DataFrame:
        return apply_linear(rows.select(vec), whitening, vec=vec, out="white", offset=center, pre_center=pre, l2=l2).selectExpr("white as vec")

    white = prepare(df).persist(StorageLevel.MEMORY_AND_DISK)
    other = prepare(held_out).persist(StorageLevel.MEMORY_AND_DISK) if held_out is not None else None
    history: list[dict] = []
    tracked: list[dict] = []
    try:
        w = initial_unmixing if initial_unmixing is not None else np.random.default_rng(seed).standard_normal((k, k))
        if algorithm == "parallel":
            w = decorrelate(np.asarray(w, float))
            for it in range(start_iteration + 1, max_iter + 1):
                a, b = _moments(white, w, contrast)
                w = decorrelate((a - b[:, None] * w) / n)
                if (objective_every and it % objective_every == 0) or (objective_every and it == max_iter):
                    values = component_means(white, w, lambda s: _value(s, contrast))
                    history.append({"iteration": it, "percentiles": np.percentile(values, PERCENTILES).tolist(), "mean": float(values.mean())})
                if other is not None and (it % held_out_every == 0 or it == max_iter):
                    tracked.append({"iteration": it, "train": excess_kurtosis(white, w).tolist(), "held_out": excess_kurtosis(other, w).tolist()})
                if checkpoint is not None:
                    checkpoint(it, w, whitening, center)
        else:
            w = np.asarray(w, float)
            for c in range(k):
                row = w[c] - (w[:c] @ w[c]) @ w[:c]
                row /= np.linalg.norm(row)
                for _ in range(max_iter):
                    a, b = _moments(white, row[None], contrast)
                    row = (a[0] - b[0] * row) / n
                    row -= (w[:c] @ row) @ w[:c]
                    row /= np.linalg.norm(row)
                w[c] = row
        objectives = component_means(white, w, lambda s: _value(s, contrast))
    finally:
        white.unpersist()
        if other is not None:
            other.unpersist()
    strengths = np.abs(objectives - GAUSSIAN[contrast])
    order = np.argsort(-strengths, kind="stable")
    w = w[order]
    reading = w @ whitening
    return Fit(center, reading, np.linalg.pinv(reading), whitening, w, objectives[order], strengths[order], n, pre, l2, history, tracked)


def pca_basis(writing: np.ndarray, k: int | None = None) -> np.ndarray:
    """Principal directions of the space that the writing matrix spans, strongest first."""
    values, vectors = np.linalg.eigh(writing @ writing.T)
    return vectors[:, ::-1][:, : k or writing.shape[1]].T


def pca_from_precision(reading: np.ndarray, k: int | None = None) -> np.ndarray:
    """Whitened principal directions from R'R."""
    values, vectors = np.linalg.eigh(reading.T @ reading)
    keep = np.argsort(-values, kind="stable")[: k or reading.shape[0]]
    return (vectors[:, keep] * np.sqrt(np.maximum(values[keep], 0))).T


def random_orthogonal(rows: int, width: int, seed: int) -> np.ndarray:
    """Orthonormal rows by QR with positive diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rows)))
    return (q * np.where(np.diag(r) < 0, -1.0, 1.0)).T


def unfitted_control(fit: Fit, seed: int) -> np.ndarray:
    """A random rotation of the whitened space instead of the fitted one."""
    return decorrelate(np.random.default_rng(seed).standard_normal(fit.unmixing.shape)) @ fit.whitening


def sample_pca(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and directions of the covariance over n - 1, descending."""
    values, vectors = np.linalg.eigh(scatter / (n - 1))
    return values[::-1], vectors[:, ::-1].T
