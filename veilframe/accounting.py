"""Privacy ledgers: basic, zero-concentrated (Renyi) and privacy-loss composition."""

from __future__ import annotations

import math
import warnings
from abc import ABC, abstractmethod

import numpy as np

from .errors import InvalidPrivacyParametersError
from .functions.calibrate import gaussian_sigma, noise_parameters, phi, sensitivities
from .model import DPParams

MAX_REMAINING_QUERIES = 1_000_000


def zcdp_cost(deltas: list[float], sigmas: list[float], tau: float, sigma_thr: float, params: DPParams) -> tuple[float, float]:
    """(alpha, beta) of one release; infinite where there is no noise."""
    k = params.contribution_bound
    half = lambda d, s: 0.0 if d == 0 else math.inf if s == 0 else d * d / (2 * s * s)
    alpha = sum(map(half, deltas, sigmas)) + half(k, sigma_thr)
    if sigma_thr == 0:
        return math.inf, 1.0
    tail = 0.5 * math.erfc((tau - params.min_frequency) / sigma_thr / math.sqrt(2))
    return alpha, -math.expm1(k * math.log1p(-tail)) if tail < 1 else 1.0


def minimum_epsilon(alpha: float, beta: float, delta: float) -> float:
    if delta >= 1:
        return 0.0
    if beta >= delta or math.isinf(alpha):
        return math.inf
    return alpha + math.sqrt(4 * alpha * math.log(1 / (delta - beta)))


class Accountant(ABC):
    """epsilon > 0 and 0 < delta <= 1; delta = 1 is a budget without end."""

    def __init__(self, epsilon: float, delta: float):
        if not epsilon > 0 or not 0 < delta <= 1:
            raise InvalidPrivacyParametersError("epsilon must be positive and delta in (0, 1]")
        self.epsilon, self.delta = epsilon, delta
        self.spent_epsilon = self.spent_delta = 0.0

    def check_budget(self, aggs, params: DPParams) -> bool:
        return self.delta >= 1 or self.fits(sensitivities(aggs, params), *noise_parameters(aggs, params), params)

    def fits(self, deltas, sigmas, tau, sigma_thr, params: DPParams) -> bool:
        if self.delta >= 1:
            return True
        return self._basic(params) or self._composed(deltas, sigmas, tau, sigma_thr, params)

    def _basic(self, params: DPParams) -> bool:
        if params.epsilon is None or params.delta is None:
            return False
        slack = 1 + 1e-12
        return self.spent_epsilon + params.epsilon <= self.epsilon * slack and self.spent_delta + params.delta <= self.delta * slack

    def _composed(self, deltas, sigmas, tau, sigma_thr, params) -> bool:
        return False

    def update_budget(self, aggs, params: DPParams) -> None:
        known = params.epsilon is not None and params.delta is not None
        self.spent_epsilon += params.epsilon if known else math.inf
        self.spent_delta += params.delta if known else math.inf
        self._record(sensitivities(aggs, params), *noise_parameters(aggs, params), params)

    def _record(self, deltas, sigmas, tau, sigma_thr, params) -> None:
        pass

    def remaining_queries(self, epsilon: float, delta: float) -> int:
        if not epsilon > 0 or not delta > 0:
            raise InvalidPrivacyParametersError("epsilon and delta must be positive")
        if self.delta >= 1:
            return MAX_REMAINING_QUERIES
        left = min((self.epsilon - self.spent_epsilon) / epsilon, (self.delta - self.spent_delta) / delta)
        basic = 0 if math.isnan(left) or left < 0 else MAX_REMAINING_QUERIES if math.isinf(left) else math.floor(left + 1e-9)
        return min(MAX_REMAINING_QUERIES, max(basic, self._remaining(epsilon, delta)))

    @abstractmethod
    def _remaining(self, epsilon: float, delta: float) -> int: ...


class BasicAccountant(Accountant):
    """Sums of epsilon and delta."""

    def __init__(self, epsilon: float, delta: float):
        super().__init__(epsilon, delta)
        warnings.warn("basic composition is the loosest; RenyiAccountant allows more queries", UserWarning, stacklevel=2)

    def _remaining(self, epsilon, delta) -> int:
        return 0


class RenyiAccountant(Accountant):
    """Zero-concentrated composition, or the basic sums where those are better."""

    def __init__(self, epsilon: float, delta: float):
        super().__init__(epsilon, delta)
        self.alpha = self.beta = 0.0

    def _composed(self, deltas, sigmas, tau, sigma_thr, params) -> bool:
        a, b = zcdp_cost(deltas, sigmas, tau, sigma_thr, params)
        return self.epsilon >= minimum_epsilon(self.alpha + a, self.beta + b, self.delta)

    def _record(self, deltas, sigmas, tau, sigma_thr, params) -> None:
        a, b = zcdp_cost(deltas, sigmas, tau, sigma_thr, params)
        self.alpha, self.beta = self.alpha + a, self.beta + b

    def _remaining(self, epsilon, delta) -> int:
        fits = lambda n: minimum_epsilon(self.alpha + n * epsilon**2 / 2, self.beta + n * delta, self.delta) < self.epsilon
        return _largest(fits)


class PrivacyLoss:
    """A discretised privacy-loss distribution, losses rounded up."""

    def __init__(self, start: int, mass: np.ndarray, infinite: float, step: float):
        self.start, self.mass, self.infinite, self.step = start, mass, infinite, step

    @staticmethod
    def gaussian(sigma: float, delta2: float, step: float) -> "PrivacyLoss":
        if delta2 == 0:
            return PrivacyLoss(0, np.ones(1), 0.0, step)
        if sigma == 0:
            return PrivacyLoss(0, np.zeros(1), 1.0, step)
        m = delta2 / sigma
        low, high = m * m / 2 - 9 * m, m * m / 2 + 9 * m  # the loss is N(m^2 / 2, m^2)
        first, last = math.floor(low / step), math.ceil(high / step)
        edges = np.arange(first, last + 1) * step
        cdf = np.array([phi(x) for x in (edges - m * m / 2) / m])
        return PrivacyLoss(first + 1, np.append(cdf[0], np.zeros(0)) if len(cdf) < 2 else np.diff(cdf) + np.eye(1, len(cdf) - 1)[0] * cdf[0], 1 - float(cdf[-1]), step)

    def then(self, other: "PrivacyLoss") -> "PrivacyLoss":
        n = len(self.mass) + len(other.mass) - 1
        size = 1 << (n - 1).bit_length()
        both = np.fft.irfft(np.fft.rfft(self.mass, size) * np.fft.rfft(other.mass, size), size)[:n]
        infinite = 1 - (1 - self.infinite) * (1 - other.infinite)
        return PrivacyLoss(self.start + other.start, np.maximum(both, 0), infinite, self.step)

    def lost(self, delta: float) -> "PrivacyLoss":
        return PrivacyLoss(self.start, self.mass * (1 - delta), self.infinite + (1 - self.infinite) * delta, self.step)

    def delta(self, epsilon: float) -> float:
        loss = (self.start + np.arange(len(self.mass))) * self.step
        over = loss > epsilon
        return self.infinite + float((-np.expm1(epsilon - loss[over]) * self.mass[over]).sum())

    def epsilon(self, delta: float) -> float:
        if self.infinite > delta:
            return math.inf
        low, high = 0.0, max(0.0, (self.start + len(self.mass)) * self.step)
        if self.delta(low) <= delta:
            return 0.0
        while high - low > self.step / 16:
            mid = (low + high) / 2
            low, high = (low, mid) if self.delta(mid) <= delta else (mid, high)
        return high


class PLDAccountant(Accountant):
    """Numerical composition of privacy-loss distributions."""

    def __init__(self, epsilon: float, delta: float, discretization_interval: float = 1e-4):
        super().__init__(epsilon, delta)
        self.step = discretization_interval
        self.loss = PrivacyLoss(0, np.ones(1), 0.0, discretization_interval)

    def _release(self, deltas, sigmas, tau, sigma_thr, params) -> PrivacyLoss:
        _, beta = zcdp_cost(deltas, sigmas, tau, sigma_thr, params)
        out = PrivacyLoss.gaussian(sigma_thr, params.contribution_bound, self.step).lost(min(1.0, beta))
        for d, s in zip(deltas, sigmas, strict=True):
            out = out.then(PrivacyLoss.gaussian(s, d, self.step))
        return out

    def _composed(self, deltas, sigmas, tau, sigma_thr, params) -> bool:
        return self.epsilon >= self.loss.then(self._release(deltas, sigmas, tau, sigma_thr, params)).epsilon(self.delta)

    def _record(self, deltas, sigmas, tau, sigma_thr, params) -> None:
        self.loss = self.loss.then(self._release(deltas, sigmas, tau, sigma_thr, params))

    def _remaining(self, epsilon, delta) -> int:
        """How often a Gaussian of this (epsilon, delta) still fits."""
        sigma = gaussian_sigma(epsilon, delta, 1.0)
        fits = lambda loss: loss.epsilon(self.delta) <= self.epsilon
        powers, n = [PrivacyLoss.gaussian(sigma, 1.0, self.step)], 0  # of 1, 2, 4, ... releases
        while 1 << len(powers) <= MAX_REMAINING_QUERIES and fits(self.loss.then(powers[-1])):
            powers.append(powers[-1].then(powers[-1]))
        loss = self.loss
        for k in reversed(range(len(powers))):  # the binary digits of the count
            if n + (1 << k) <= MAX_REMAINING_QUERIES and fits(more := loss.then(powers[k])):
                loss, n = more, n + (1 << k)
        return n


def _largest(fits) -> int:
    if not fits(1):
        return 0
    low, high = 1, MAX_REMAINING_QUERIES + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low
