"""Empirical checks of mechanisms by hockey-stick divergence."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np


class Mechanism(ABC):
    @abstractmethod
    def draw(self, value, n: int) -> np.ndarray:
        """n outputs of the mechanism on one input."""


def calculate_hockey_stick_divergence(p, q, epsilon: float) -> float:
    p, q, e = np.asarray(p, float), np.asarray(q, float), math.exp(epsilon)
    return float(max(np.maximum(p - e * q, 0).sum(), np.maximum(q - e * p, 0).sum()))


def estimate_hockey_stick_divergence(mechanism: Mechanism, inputs, epsilon: float, bins: int, n: int) -> float:
    a, b = (mechanism.draw(v, n) for v in inputs)
    edges = np.quantile(np.concatenate([a, b]), np.linspace(0, 1, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    p, q = (np.histogram(x, edges)[0] / n for x in (a, b))
    return calculate_hockey_stick_divergence(p, q, epsilon)
