"""Noise scales from (epsilon, delta): the analytic Gaussian mechanism (Balle and Wang, 2018)."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from ..errors import InvalidPrivacyParametersError
from ..model import DPParams, sensitivity


def phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def gaussian_delta(sigma: float, epsilon: float, delta2: float) -> float:
    """The smallest delta at epsilon for noise sigma and sensitivity delta2."""
    if sigma == 0:
        return 1.0
    a, b = delta2 / (2 * sigma), epsilon * sigma / delta2
    tail = phi(-a - b)
    return phi(a - b) - (math.exp(epsilon + math.log(tail)) if tail > 0 else 0.0)


@lru_cache(4096)
def gaussian_sigma(epsilon: float, delta: float, delta2: float) -> float:
    if not epsilon > 0 or not 0 < delta <= 1:
        raise InvalidPrivacyParametersError("epsilon must be positive and delta in (0, 1]")
    if delta2 == 0 or delta >= 1 or math.isinf(epsilon):
        return 0.0
    high = delta2
    while gaussian_delta(high, epsilon, delta2) > delta:
        high *= 2
    low = high / 2
    while low > 0 and gaussian_delta(low, epsilon, delta2) <= delta:
        high, low = low, low / 2
    while high - low > 1e-12 * max(1.0, high):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if gaussian_delta(mid, epsilon, delta2) <= delta else (mid, high)
    return high


def sensitivities(aggs, params: DPParams) -> list[float]:
    if len(aggs) != len(params.clipping_thresholds):
        raise InvalidPrivacyParametersError("one entry of clipping_thresholds is needed for each aggregate")
    return [sensitivity(a.aggregation, params.contribution_bound, c) for a, c in zip(aggs, params.clipping_thresholds, strict=True)]


def split(deltas: list[float], params: DPParams, epsilon: float, delta: float) -> tuple[list[float], float, float]:
    """(sigmas, tau, sigma of thresholding) for equal shares of the budget."""
    shares = len(deltas) + 1
    e, d, k = epsilon / shares, delta / shares, params.contribution_bound
    sigmas = [gaussian_sigma(e, d, x) for x in deltas]
    threshold = gaussian_sigma(e, d / 2, k)
    tau = params.min_frequency + (threshold * NormalDist().inv_cdf((1 - d / 2) ** (1 / k)) if threshold > 0 else 0.0)
    return sigmas, max(tau, params.min_frequency), threshold


def noise_parameters(aggs, params: DPParams) -> tuple[list[float], float, float]:
    deltas = sensitivities(aggs, params)
    if params.sigmas is not None:
        if len(params.sigmas) != len(deltas):
            raise InvalidPrivacyParametersError("one sigma is needed for each aggregate")
        return list(params.sigmas), params.tau, params.sigma_for_thresholding
    best = split(deltas, params, params.epsilon, params.delta)
    if params.accountant_class is None or params.delta >= 1 or math.isinf(params.epsilon):
        return best
    # the largest epsilon whose noise still fits the budget by composition
    low, high = params.epsilon, 32 * params.epsilon
    while high - low > params.epsilon / 32:
        mid = (low + high) / 2
        own = split(deltas, params, mid, params.delta)
        if params.accountant_class(params.epsilon, params.delta).fits(deltas, *own, params):
            low, best = mid, own
        else:
            high = mid
    return best
