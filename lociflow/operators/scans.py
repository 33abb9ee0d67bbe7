"""Association of a phenotype with every marker: least squares with covariates, logistic and mixed-model scans.

All take rows (marker, x), x an array of one value a sample with missing ones null,
and return (marker, beta, se, stat, p_value, n_samples).  Markers stay where Spark
has put them: no scan shuffles.  What is sent to the tasks is one value a sample
and covariate, and for the mixed model the n x n eigenvectors; n samples have to
fit a worker, which is the documented limit of these methods.

A marker that cannot be tested (no variance, too few values, no convergence) has
beta 0, se infinite, stat 0 and p 1.  A perfect fit has se 0, stat infinite and p 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .linear import partial_fits, sliced

SCHEMA = "marker long, beta double, se double, stat double, p_value double, n_samples long"
_log_gamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    """P(|Z| >= |z|) of the normal distribution."""
    return _erfc(np.abs(z) / math.sqrt(2))


def _beta_fraction(a: np.ndarray, b: float | np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / guard(1 + term * d)
            c = guard(1 + term / c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's t with df degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
        a, b = df / 2, 0.5
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        near = front * _beta_fraction(a, b, np.where(x < 1, x, 0.5)) / a
        # past the mean of the beta distribution the mirrored fraction converges faster
        far = 1 - front * _beta_fraction(np.full_like(a, b), a, np.where(x < 1, 1 - x, 0.5)) / b
    out = np.where(x < (a + 1) / (a + b + 2), near, far)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(out, 0, 1)))


def beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(X <= x) of the Beta(a, b) distribution, for 0 < x < 1."""
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    near = x < (a + 1) / (a + b + 2)
    # past the mean the mirrored fraction converges faster
    return np.where(near, front * _beta_fraction(a, b, np.where(near, x, 0.5)) / a, 1 - front * _beta_fraction(b, a, np.where(near, 0.5, 1 - x)) / b)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The q-quantiles of Beta(a, b), by bisection."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        half = (low + high) / 2
        below = beta_tail(half, a, b) < q
        low, high = np.where(below, half, low), np.where(below, high, half)
    return (low + high) / 2


def _design(covariates: np.ndarray | None, n: int) -> np.ndarray:
    """A column of ones and the covariates."""
    return np.ones((n, 1)) if covariates is None else np.column_stack([np.ones(n), covariates])


def _values(column: pd.Series, keep: np.ndarray | None = None) -> np.ndarray:
    x = np.array([np.array(v, dtype=float) for v in column])
    return x if keep is None else x[:, keep]


def _result(markers: pd.Series, beta, se, df, n) -> pd.DataFrame:
    """Test statistics of slopes; df <= 0 leaves the slope with an infinite error."""
    beta, se, df, n = np.broadcast_arrays(beta, se, df, n)
    se = np.where(df > 0, se, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = np.where(np.isinf(se), 0.0, np.where((se == 0) & (beta == 0), 0.0, beta / se))
    return pd.DataFrame({"marker": markers.to_numpy(), "beta": beta, "se": se, "stat": stat, "p_value": np.where(df > 0, t_two_sided(stat, np.maximum(df, 1)), 1.0), "n_samples": n})


def _slopes(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope and residual sum of squares of y on each row of x, both cleared of q, and whether x varies."""
    scale = (x * x).sum(axis=1)
    x, y = x - (x @ q) @ q.T, y - q @ (q.T @ y)
    return _ratios(x, np.broadcast_to(y, x.shape), scale)


def _ratios(x: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    xx = (x * x).sum(axis=1)
    ok = xx > 1e-12 * np.maximum(scale, 1e-300)
    beta = np.where(ok, (x * y).sum(axis=1) / np.where(ok, xx, 1), 0.0)
    rss = ((y - beta[:, None] * x) ** 2).sum(axis=1)
    return beta, rss / np.where(ok, xx, 1), ok


Kernel = Callable[[pd.Series, np.ndarray], pd.DataFrame]


def ols_kernel(y: np.ndarray, covariates: np.ndarray | None = None) -> Kernel:
    """Least squares of y and covariates as a function of markers and their values."""
    design = _design(covariates, len(y))
    q, p = np.linalg.qr(design)[0], design.shape[1]

    def kernel(markers: pd.Series, x: np.ndarray) -> pd.DataFrame:
        seen = np.isfinite(x)
        n = seen.sum(axis=1)
        enough = n >= p + 2
        seen &= enough[:, None]
        x, ys, s = np.where(seen, x, 0.0), np.where(seen, y, 0.0), seen.astype(float)
        scale = (x * x).sum(axis=1)
        s[~enough] = 1.0
        clear = lambda v: (v - partial_fits(s, v, q) @ q.T) * seen
        beta, ratio, ok = _ratios(clear(x), clear(ys), scale)
        se = np.where(ok & enough, np.sqrt(ratio / np.maximum(n - p - 1, 1)), np.inf)
        return _result(markers, np.where(enough, beta, 0.0), se, n - p - 1, n)

    return kernel


def ols_scan(rows: DataFrame, y: np.ndarray, covariates: np.ndarray | None = None, keep: np.ndarray | None = None) -> DataFrame:
    """Least squares of y on each marker and the covariates, over the samples where the marker is present.

    keep numbers the samples of x that y and the covariates are of, by default all.
    All markers of a batch are solved together, each by its own samples.
    """
    width = len(y) + (1 if covariates is None else 1 + covariates.shape[1]) ** 2

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = ols_kernel(y, covariates)
        for pdf in sliced(batches, width):
            yield kernel(pdf["marker"], _values(pdf["x"], keep))

    return rows.select("marker", "x").mapInPandas(scan, SCHEMA)


def logistic_scan(rows: DataFrame, y: np.ndarray, covariates: np.ndarray | None = None, most_steps: int = 25, tolerance: float = 1e-6) -> DataFrame:
    """Logistic regression of y (0/1) on each marker and the covariates; all markers of a batch step together.

    p is that of the normal distribution.  A missing value takes its sample out of its marker's fit.
    """
    design = _design(covariates, len(y))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches, 4 * len(y) * (design.shape[1] + 1)):
            x = _values(pdf["x"])
            seen = np.isfinite(x)
            n = seen.sum(axis=1)
            d = np.concatenate([np.broadcast_to(design, (len(x), *design.shape)), np.where(seen, x, 0)[:, :, None]], axis=2)
            d = d * seen[:, :, None]
            varies = np.where(seen, x, -np.inf).max(axis=1) > np.where(seen, x, np.inf).min(axis=1)
            going = varies & (n >= d.shape[2] + 1)
            beta, se, done = np.zeros((len(x), d.shape[2])), np.full(len(x), np.inf), np.zeros(len(x), bool)
            for _ in range(most_steps):
                at = np.flatnonzero(going & ~done)
                if not len(at):
                    break
                mu = 1 / (1 + np.exp(-np.clip(np.einsum("mnq,mq->mn", d[at], beta[at]), -20, 20)))
                w = np.maximum(mu * (1 - mu), 1e-10)
                info = np.einsum("mnq,mn,mnr->mqr", d[at], w, d[at])
                solid = np.linalg.cond(info) < 1e12
                going[at[~solid]] = False
                at, info = at[solid], info[solid]
                step = np.linalg.solve(info, np.einsum("mnq,mn->mq", d[at], (y - mu[solid]) * seen[at])[..., None])[..., 0]
                beta[at] += step
                near = np.abs(step).max(axis=1, initial=0) < tolerance
                se[at] = np.sqrt(np.linalg.inv(info)[:, -1, -1])
                done[at[near]] = True
            slope, se = np.where(done, beta[:, -1], 0.0), np.where(done, se, np.inf)
            stat = np.where(done, slope / np.where(done, se, 1), 0.0)
            yield pd.DataFrame({"marker": pdf["marker"].to_numpy(), "beta": slope, "se": se, "stat": stat, "p_value": normal_two_sided(stat), "n_samples": n})

    return rows.select("marker", "x").mapInPandas(scan, SCHEMA)


def reml_delta(value: np.ndarray, y: np.ndarray, design: np.ndarray, low: float = -5.0, high: float = 5.0, within: float = 1e-4) -> float:
    """The ratio of residual to genetic variance of largest restricted likelihood, by golden sections of its log10.

    value: eigenvalues of the relationship matrix; y and design are rotated by its eigenvectors.
    """
    n, p = design.shape

    def loss(log_delta: float) -> float:
        w = 1 / (value + 10**log_delta)
        info = design.T @ (w[:, None] * design)
        fit = design @ np.linalg.solve(info, design.T @ (w * y))
        variance = (w * (y - fit) ** 2).sum() / (n - p)
        return math.inf if variance <= 0 else ((n - p) * math.log(variance) - np.log(w).sum() + np.linalg.slogdet(info)[1]) / 2

    ratio = (math.sqrt(5) - 1) / 2
    while high - low > within:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return 10 ** ((low + high) / 2)


def lmm_kernel(y: np.ndarray, relationship: np.ndarray, covariates: np.ndarray | None = None) -> Kernel:
    """The mixed model of y as a function of markers and their values; the matrix is decomposed and the variance ratio fitted here, once."""
    value, vector = np.linalg.eigh(relationship)
    value = np.maximum(value, 0)
    design = vector.T @ _design(covariates, len(y))
    turned = vector.T @ y
    root = 1 / np.sqrt(value + reml_delta(value, turned, design))
    q, (n, p) = np.linalg.qr(root[:, None] * design)[0], design.shape
    turned = root * turned

    def kernel(markers: pd.Series, x: np.ndarray) -> pd.DataFrame:
        seen = np.isfinite(x)
        mean = np.where(seen, x, 0).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
        beta, ratio, ok = _slopes((np.where(seen, x, mean[:, None]) @ vector) * root, turned, q)
        return _result(markers, beta, np.where(ok, np.sqrt(ratio / max(n - p - 1, 1)), np.inf), n - p - 1, n)

    return kernel


def lmm_scan(rows: DataFrame, y: np.ndarray, relationship: np.ndarray, covariates: np.ndarray | None = None, keep: np.ndarray | None = None) -> DataFrame:
    """Generalised least squares under a relationship matrix, the variance ratio fitted once without markers.

    keep numbers the samples of x that y, the matrix and the covariates are of.  Missing values are the marker's mean; a marker without values cannot be tested.
    """
    kernel, n = lmm_kernel(y, relationship, covariates), len(y)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches, n):
            yield kernel(pdf["marker"], _values(pdf["x"], keep))

    return rows.select("marker", "x").mapInPandas(scan, SCHEMA)


def weights(value: np.ndarray, rest: float, delta: float) -> tuple[float, np.ndarray]:
    """Weight outside the known eigenvectors, and what each of them adds to it."""
    base = 1 / (rest + delta)
    return base, 1 / (np.maximum(value, 0) + delta) - base


def products_delta(value: np.ndarray, rest: float, n: int, turned: np.ndarray, plain: np.ndarray, low: float = -5.0, high: float = 5.0, within: float = 1e-4) -> float:
    """As reml_delta, from the products of design and outcome (the last) with one another (plain) and with the known eigenvectors (turned, k rows)."""
    p = len(plain) - 1

    def loss(log_delta: float) -> float:
        base, more = weights(value, rest, 10**log_delta)
        info = base * plain + turned.T @ (more[:, None] * turned)
        variance = (info[p, p] - info[p, :p] @ np.linalg.solve(info[:p, :p], info[:p, p])) / (n - p)
        log_weights = np.log(base + more).sum() + (n - len(value)) * math.log(base)
        return math.inf if variance <= 0 else ((n - p) * math.log(variance) - log_weights + np.linalg.slogdet(info[:p, :p])[1]) / 2

    ratio = (math.sqrt(5) - 1) / 2
    while high - low > within:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return 10 ** ((low + high) / 2)


def low_rank_delta(value: np.ndarray, vector: np.ndarray, rest: float, y: np.ndarray, design: np.ndarray, low: float = -5.0, high: float = 5.0, within: float = 1e-4) -> float:
    """As reml_delta, of a matrix with the given leading eigenvalues and vectors (n x k) and the value ``rest`` on all that is at right angles to them."""
    both = np.column_stack([design, y])
    return products_delta(value, rest, len(y), vector.T @ both, both.T @ both, low, high, within)


def slopes_of_products(markers: pd.Series, own: np.ndarray, cross: np.ndarray, info: np.ndarray, along: np.ndarray, whole: float, n: int) -> pd.DataFrame:
    """Tests of markers from their weighted products with themselves (own) and with the design and the outcome (cross), and those of the design."""
    p = len(info)
    solved = np.linalg.solve(info, cross[:, :p].T).T
    square = own - (cross[:, :p] * solved).sum(axis=1)
    ok = square > 1e-10 * np.maximum(own, 1e-300)
    square = np.where(ok, square, 1.0)
    beta = np.where(ok, (cross[:, p] - solved @ along) / square, 0.0)
    se = np.where(ok, np.sqrt(np.maximum(whole - beta**2 * square, 0) / max(n - p - 1, 1) / square), np.inf)
    return _result(markers, beta, se, n - p - 1, n)


def low_rank_lmm_scan(rows: DataFrame, y: np.ndarray, value: np.ndarray, vector: np.ndarray, trace: float, covariates: np.ndarray | None = None) -> DataFrame:
    """The mixed-model scan with the leading eigenvalues and vectors (n x k) of the relationship matrix; its other eigenvalues count as their mean.

    With all of them it is lmm_scan.  Tasks hold n x k numbers, never n x n.
    """
    n = len(y)
    design = _design(covariates, n)
    p, left = design.shape[1], n - len(value)
    rest = max((trace - value.sum()) / left, 0.0) if left else 0.0
    base, more = weights(value, rest, low_rank_delta(value, vector, rest, y, design))
    weigh = lambda z: base * z + vector @ (more[:, None] * (vector.T @ z))
    both = np.column_stack([design, y])
    heavy = weigh(both)
    info, along = design.T @ heavy[:, :p], design.T @ heavy[:, p]
    whole = y @ heavy[:, p] - along @ np.linalg.solve(info, along)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches, n):
            x = _values(pdf["x"], None)
            seen = np.isfinite(x)
            mean = np.where(seen, x, 0).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
            x = np.where(seen, x, mean[:, None])
            cross, turned = x @ heavy, x @ vector
            yield slopes_of_products(pdf["marker"], base * (x * x).sum(axis=1) + (turned * turned) @ more, cross, info, along, whole, n)

    return rows.select("marker", "x").mapInPandas(scan, SCHEMA)
