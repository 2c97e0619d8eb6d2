"""Releases of AVG, VAR, STDDEV and COVAR from noisy Bernstein coefficients.

Values are brought to [0, 1]; the coefficients of a row sum to one, so one
row moves them by a bounded amount whatever its value, and every statistic is
a ratio of their noisy sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from ..errors import AggregationError

Noise = Callable[[float, float], float]


def _width(low: float, high: float) -> float:
    if not low < high:
        raise AggregationError("the lower clipping threshold must be below the upper one")
    return high - low


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def private_avg(n: float, total: float, low: float, high: float, sigma: float, noise: Noise) -> float:
    d = _width(low, high)
    s = (total - low * n) / d
    one, zero = noise(s, sigma / d), noise(n - s, sigma / d)
    return d * min(1.0, max(0.0, _ratio(one, one + zero))) + low


def private_var(n: float, total: float, squares: float, low: float, high: float, sigma: float, noise: Noise, sample: bool) -> float:
    d = _width(low, high)
    s = (total - low * n) / d
    q = (squares - 2 * low * total + n * low * low) / (d * d)
    b0, b1, b2 = (noise(b, sigma / d) for b in (n - 2 * s + q, 2 * (s - q), q))
    m = b0 + b1 + b2
    v = min(0.25, max(0.0, _ratio(b2, m) - _ratio(b1 / 2 + b2, m) ** 2))
    return d * d * _sampled(v, m, sample)


def private_stddev(*args, **options) -> float:
    return math.sqrt(private_var(*args, **options))


def private_covar(n: float, sx: float, sy: float, sxy: float, x: tuple[float, float], y: tuple[float, float], sigma: float, noise: Noise, sample: bool) -> float:
    dx, dy = _width(*x), _width(*y)
    p, q = (sx - x[0] * n) / dx, (sy - y[0] * n) / dy
    r = (sxy - x[0] * sy - y[0] * sx + n * x[0] * y[0]) / (dx * dy)
    b0, b1, b2, b3 = (noise(b, sigma / dx) for b in (n - p - q + r, q - r, p - r, r))
    m = b0 + b1 + b2 + b3
    c = min(0.25, max(-0.25, _ratio(b3, m) - _ratio(b2 + b3, m) * _ratio(b1 + b3, m)))
    return dx * dy * _sampled(c, m, sample)


def _sampled(v: float, n: float, sample: bool) -> float:
    return v if not sample else 0.0 if n <= 1 else v * n / (n - 1)
