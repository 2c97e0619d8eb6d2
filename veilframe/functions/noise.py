"""Gaussian noise: exact discrete sampling on a fixed grid (Canonne, Kamath and Steinke, 2020)."""

from __future__ import annotations

import math
import random
from enum import Enum
from fractions import Fraction
from secrets import SystemRandom

_SECURE = SystemRandom()
#: The first normal deviate of random.seed(0), which debug noise repeats.
DEBUG_DEVIATE = 0.9417154046806644


class NoiseMode(Enum):
    SECURE = "secure"
    DEBUG = "debug"
    AUDIT = "audit"


def _bernoulli(p: Fraction) -> bool:
    return _SECURE.randrange(p.denominator) < p.numerator


def _bernoulli_exp(x: Fraction) -> bool:
    """True with probability exp(-x)."""
    while x > 1:
        if not _bernoulli_exp(Fraction(1)):
            return False
        x -= 1
    k = 1
    while _bernoulli(x / k):
        k += 1
    return k % 2 == 1


def _laplace(t: int) -> int:
    while True:
        u = _SECURE.randrange(t)
        if not _bernoulli_exp(Fraction(u, t)):
            continue
        v = 0
        while _bernoulli_exp(Fraction(1)):
            v += 1
        x = u + t * v
        negative = _SECURE.randrange(2)
        if x or not negative:
            return -x if negative else x


def discrete_gaussian(sigma: Fraction) -> int:
    t = math.floor(sigma) + 1
    while True:
        x = _laplace(t)
        if _bernoulli_exp((abs(x) - sigma * sigma / t) ** 2 / (2 * sigma * sigma)):
            return x


def gaussian(x: float, sigma: float, mode: NoiseMode = NoiseMode.SECURE) -> float:
    """x plus N(0, sigma^2)."""
    x, sigma = float(x), float(sigma)
    if not (math.isfinite(x) and math.isfinite(sigma)) or sigma < 0:
        raise ValueError("noise needs finite values and a scale of 0 at least")
    if sigma == 0:
        return x
    if mode is NoiseMode.DEBUG:
        return x + sigma * DEBUG_DEVIATE
    if mode is NoiseMode.AUDIT:
        return x + random.gauss(0, sigma)
    grid = Fraction(2) ** (math.frexp(sigma)[1] - 41)  # under sigma * 2**-40
    return float((round(Fraction(x) / grid) + discrete_gaussian(Fraction(sigma) / grid)) * grid)
