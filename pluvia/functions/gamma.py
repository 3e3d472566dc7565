"""Gamma distribution: fit from three averages, distribution function, quantile, quantile map.

Fits are SQL arithmetic over one row per key. The distribution function and its
inverse need a loop per value; they run on whole Arrow batches with numpy.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get the numpy helpers inside the UDF, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHIFT = 8  # arguments are raised by this before an asymptotic series is used
_NEWTON_STEPS = 6


# ---- SQL text over named columns ---------------------------------------------------------
# Text, as one parsed expression is far quicker to build than hundreds of Column calls.


def _series(z: str, *coefficients: float) -> str:
    """c0 + c1/z^2 + c2/z^4 + ..."""
    text = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        text = f"({c!r}D + {text} / ({z} * {z}))"
    return text


def _raised(k: str, term: str) -> str:
    """Sum of ``term`` over k, k + 1, ..., the values below the raised argument."""
    return " + ".join(term.format(f"({k} + {i})") for i in range(_SHIFT))


def digamma(k: str) -> str:
    z = f"({k} + {_SHIFT})"
    tail = _series(z, 1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)
    return f"(ln({z}) - 0.5D / {z} - {tail} / ({z} * {z}) - ({_raised(k, '1D / {0}')}))"


def trigamma(k: str) -> str:
    z = f"({k} + {_SHIFT})"
    tail = _series(z, 1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)
    squares = _raised(k, "1D / ({0} * {0})")
    return f"(1D / {z} + 0.5D / ({z} * {z}) + {tail} / ({z} * {z} * {z}) + {squares})"


def log_gamma(k: str) -> str:
    z = f"({k} + {_SHIFT})"
    tail = _series(z, 1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
    head = f"({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D"
    return f"({head} + {tail} / {z} - ({_raised(k, 'ln({0})')}))"


def _newton(start: str, step: str) -> Column:
    """``start`` after a fixed number of steps from k to ``step``."""
    return F.expr(f"aggregate(sequence(1, {_NEWTON_STEPS}), {start}, (k, i) -> {step})")


def mle_shape(s: str) -> Column:
    """Maximum likelihood shape: the k with ln k - digamma(k) = s, for s = ln mean - mean log."""
    start = f"(3D - {s} + sqrt(({s} - 3D) * ({s} - 3D) + 24D * {s})) / (12D * {s})"
    return _newton(start, f"k - (ln(k) - {digamma('k')} - {s}) / (1D / k - {trigamma('k')})")


def inverse_digamma(y: str) -> Column:
    """The k with digamma(k) = y."""
    start = f"if({y} >= -2.22D, exp({y}) + 0.5D, -1D / ({y} + 0.5772156649015329D))"
    return _newton(start, f"k - ({digamma('k')} - {y}) / {trigamma('k')}")


def mean_log_likelihood(shape: str, scale: str, mean: str, mean_log: str) -> Column:
    return F.expr(
        f"({shape} - 1) * {mean_log} - {mean} / {scale} - {shape} * ln({scale})"
        f" - {log_gamma(shape)}"
    )


# ---- numpy on Arrow batches --------------------------------------------------------------


def _np_log_gamma(a: np.ndarray) -> np.ndarray:
    product = np.ones_like(a)
    for i in range(_SHIFT):
        product = product * (a + i)
    z = a + _SHIFT
    r = 1.0 / (z * z)
    tail = (1 / 12 + r * (-1 / 360 + r * (1 / 1260 + r * (-1 / 1680 + r / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail - np.log(product)


#: Terms between two looks at which elements are done; the others go on without them.
_TERMS = 8


def _lower_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of x^i / (a (a+1) ... (a+i)), for x < a + 1."""
    out, place = np.empty_like(x), np.arange(x.size)
    term = 1.0 / a
    total, i = term.copy(), 0
    while place.size:
        for i in range(i + 1, i + 1 + _TERMS):
            term = term * x / (a + i)
            total += term
        open_ = term > total * 1e-17
        if not open_.all():
            out[place[~open_]] = total[~open_]
            place, a, x, term, total = (v[open_] for v in (place, a, x, term, total))
    return out


def _fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the upper tail, for x >= a + 1. NaN where it does not converge."""
    out, place = np.full_like(x, np.nan), np.arange(x.size)
    b = x + 1.0 - a
    c = np.full_like(x, 1e300)
    d = 1.0 / b
    h, i = d.copy(), 0
    while place.size and i < 100_000:
        for i in range(i + 1, i + 1 + _TERMS):
            an = -i * (i - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            change = c * d
            h = h * change
        open_ = np.abs(change - 1.0) > 1e-15
        near = np.abs(change - 1.0) <= 1e-12
        out[place[near]] = h[near]
        if not open_.all():
            place, a, b, c, d, h = (v[open_] for v in (place, a, b, c, d, h))
    return out


def _log_tails(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of P(X <= x) and P(X > x) for scale 1, each accurate when small, also where the
    tail itself is too small for a number. Needs a > 0, x > 0. NaN where the fraction does not
    converge."""
    lower, upper = np.empty_like(x), np.empty_like(x)
    front = a * np.log(x) - x - _np_log_gamma(a)

    small = x < a + 1.0
    lower[small] = np.minimum(front[small] + np.log(_lower_series(a[small], x[small])), 0.0)
    with np.errstate(divide="ignore"):
        upper[small] = np.log(-np.expm1(lower[small]))

    large = ~small
    upper[large] = np.minimum(front[large] + np.log(_fraction(a[large], x[large])), 0.0)
    with np.errstate(divide="ignore"):
        lower[large] = np.log(-np.expm1(upper[large]))
    return lower, upper


def _normal_quantile(log_tail: np.ndarray) -> np.ndarray:
    """Rough positive normal quantile of an upper tail <= 0.5, given its logarithm."""
    t = np.sqrt(-2.0 * log_tail)
    top = 2.515517 + t * (0.802853 + t * 0.010328)
    return t - top / (1.0 + t * (1.432788 + t * (0.189269 + t * 0.001308)))


def _invert(a: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """x with the given logarithms of its tails, solved on the smaller one. NaN if that fails."""
    use_lower = lower <= upper
    log_tail = np.where(use_lower, lower, upper)
    z = _normal_quantile(log_tail) * np.where(use_lower, -1.0, 1.0)
    c = 1.0 / (9.0 * a)
    cube = a * (1.0 - c + z * np.sqrt(c)) ** 3
    power = (lower + _np_log_gamma(a + 1.0)) / a
    t = np.where(
        (power < np.log(0.3 * (a + 1.0))) | (cube <= 0.0), power, np.log(np.maximum(cube, 1e-300))
    )
    low, high = np.full_like(t, -np.inf), np.full_like(t, np.inf)
    # far down, P(x) = x^a / gamma(a+1) holds to the last digit and x may underflow
    todo = np.flatnonzero(t > -40.0)
    for _ in range(200):
        if not todo.size:
            break
        ai, ti = a[todo], t[todo]
        x = np.exp(ti)
        p, q = _log_tails(ai, x)
        tail = np.where(use_lower[todo], p, q)
        sign = np.where(use_lower[todo], 1.0, -1.0)
        with np.errstate(all="ignore"):
            gap = sign * (tail - log_tail[todo])
            slope = np.exp(ai * ti - x - _np_log_gamma(ai) - tail)
            bend = slope * (ai - x - sign * slope)
            move = 2.0 * gap * slope / (2.0 * slope * slope - gap * bend)
        high[todo] = np.where(gap > 0, np.minimum(high[todo], ti), high[todo])
        low[todo] = np.where(gap < 0, np.maximum(low[todo], ti), low[todo])
        target = ti - move
        lo, hi = low[todo], high[todo]
        middle = np.where(
            np.isinf(lo), np.minimum(ti, hi) - 1.0, np.where(np.isinf(hi), ti + 1.0, (lo + hi) / 2)
        )
        bad = ~np.isfinite(target) | (target < lo) | (target > hi)
        target = np.where(bad, middle, target)
        t[todo] = target
        # a step cubes the error, so after one below 1e-6 nothing is left to gain
        todo = todo[(bad | (np.abs(target - ti) > 1e-6)) & (gap != 0)]
    t[todo] = np.nan
    return np.exp(t)


def np_cdf(x, shape, scale) -> np.ndarray:
    x, shape, scale = (np.asarray(v, dtype=float) for v in (x, shape, scale))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(shape) & np.isfinite(scale) & ~np.isnan(x)
    out[ok & (x <= 0)] = 0.0
    out[ok & np.isposinf(x)] = 1.0
    go = ok & (x > 0) & np.isfinite(x)
    out[go] = np.exp(_log_tails(shape[go], x[go] / scale[go])[0])
    return out


def np_quantile(p, shape, scale) -> np.ndarray:
    p, shape, scale = (np.asarray(v, dtype=float) for v in (p, shape, scale))
    out = np.full(p.shape, np.nan)
    ok = np.isfinite(shape) & np.isfinite(scale)
    out[ok & (p == 0)] = 0.0
    out[ok & (p == 1)] = np.inf
    go = ok & (p > 0) & (p < 1)
    out[go] = _invert(shape[go], np.log(p[go]), np.log1p(-p[go])) * scale[go]
    return out


def np_quantile_map(x, model_shape, model_scale, obs_shape, obs_scale) -> np.ndarray:
    """Quantile of the observed fit at the model fit's probability of x.

    The probability is kept as the logarithms of its two tails, so no x is too large for it.
    """
    x, ms, mc, os_, oc = (
        np.asarray(v, dtype=float) for v in (x, model_shape, model_scale, obs_shape, obs_scale)
    )
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(x) & np.isfinite(ms) & np.isfinite(mc) & np.isfinite(os_) & np.isfinite(oc)
    out[ok & (x <= 0)] = 0.0
    scaled = np.divide(x, mc, out=np.zeros_like(x), where=ok)
    out[ok & (x > 0) & (scaled <= 0)] = 0.0  # too small for a number
    rows = np.flatnonzero(ok & (scaled > 0))
    out[rows] = _invert(os_[rows], *_log_tails(ms[rows], scaled[rows])) * oc[rows]
    return out


@F.pandas_udf(T.DoubleType())
def gamma_cdf(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(np_cdf(x, shape, scale))


@F.pandas_udf(T.DoubleType())
def gamma_quantile(p: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(np_quantile(p, shape, scale))


@F.pandas_udf(T.DoubleType())
def gamma_quantile_map(
    x: pd.Series, model_shape: pd.Series, model_scale: pd.Series,
    obs_shape: pd.Series, obs_scale: pd.Series,
) -> pd.Series:
    return pd.Series(np_quantile_map(x, model_shape, model_scale, obs_shape, obs_scale))
