"""Aggregates and privacy parameters."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from enum import Enum

from .errors import AggregationError, InvalidPrivacyParametersError

Clip = tuple | None


class Aggregation(Enum):
    COUNT = "count"
    COUNT_DISTINCT = "count_distinct"
    SUM = "sum"
    AVG = "avg"
    STDDEV_SAMP = "stddev_samp"
    STDDEV_POP = "stddev_pop"
    VAR_SAMP = "var_samp"
    VAR_POP = "var_pop"
    COVAR_SAMP = "covar_samp"
    COVAR_POP = "covar_pop"

    @staticmethod
    def named(name: str) -> "Aggregation":
        name = name.lower()
        name = {"var": "var_samp", "stddev": "stddev_samp", "covar": "covar_samp"}.get(name, name)
        try:
            return Aggregation(name)
        except ValueError:
            raise AggregationError(f"unsupported aggregate {name}") from None

    @property
    def covariance(self) -> bool:
        return self in (Aggregation.COVAR_SAMP, Aggregation.COVAR_POP)

    @property
    def counts(self) -> bool:
        return self in (Aggregation.COUNT, Aggregation.COUNT_DISTINCT)

    @property
    def literals(self) -> int:
        """Clipping literals that a call in SQL takes."""
        return 0 if self.counts else 4 if self.covariance else 2


@dataclass(frozen=True)
class AggregationColumn:
    aggregation: Aggregation
    columns: tuple[str, ...]
    alias: str | None = None
    parameters: tuple[float, ...] = ()

    @property
    def name(self) -> str:
        return self.alias or f"{self.aggregation.value}({','.join(self.columns)})"

    def clip(self) -> Clip:
        p = self.parameters
        if len(p) != self.aggregation.literals:
            raise AggregationError(f"{self.aggregation.name} takes {self.aggregation.literals} clipping literals, not {len(p)}")
        return None if not p else ((p[0], p[1]), (p[2], p[3])) if len(p) == 4 else ((p[0], p[1]),)


def bounds(clip: Clip, of: int) -> tuple[float, float]:
    """The of-th (lower, upper) of one aggregate's clipping thresholds."""
    if clip is None:
        raise AggregationError("clipping thresholds are missing")
    pairs = [clip] if not isinstance(clip[0], (tuple, list)) else list(clip)
    if of >= len(pairs) or len(pairs[of]) != 2:
        raise AggregationError("clipping thresholds are incomplete")
    return float(pairs[of][0]), float(pairs[of][1])


def sensitivity(agg: Aggregation, k: float, clip: Clip) -> float:
    """L2 sensitivity of the released statistic for k rows a unit."""
    if agg.counts:
        return float(k)
    low, high = bounds(clip, 0)
    if agg is Aggregation.SUM:
        return k * max(abs(low), abs(high))
    pairs = [bounds(clip, i) for i in range(2 if agg.covariance else 1)]
    if any(a >= b for a, b in pairs):
        raise AggregationError("the lower clipping threshold must be below the upper one")
    return k * (high - low)


@dataclass(frozen=True)
class DPParams:
    contribution_bound: float
    clipping_thresholds: list = field(default_factory=list)
    min_frequency: float = 1
    epsilon: float | None = None
    delta: float | None = None
    sigmas: list | None = None
    tau: float | None = None
    sigma_for_thresholding: float | None = None
    accountant_class: type | None = None

    def __post_init__(self):
        bad = InvalidPrivacyParametersError
        if self.contribution_bound < 1:
            raise bad("contribution_bound must be 1 at least")
        if self.min_frequency < 1:
            raise bad("min_frequency must be 1 at least")
        budget = self.epsilon is not None and self.delta is not None
        preset = self.sigmas is not None or self.tau is not None or self.sigma_for_thresholding is not None
        if budget and preset:  # or the charge would not be for the noise drawn
            raise bad("give epsilon and delta, or sigmas, tau and sigma_for_thresholding, not both")
        if budget:
            if not self.epsilon > 0 or not 0 < self.delta <= 1:
                raise bad("epsilon must be positive and delta in (0, 1]")
            return
        if self.sigmas is None or self.tau is None or self.sigma_for_thresholding is None:
            raise bad("epsilon and delta, or sigmas, tau and sigma_for_thresholding are required")
        warnings.warn("noise scales set by hand", DeprecationWarning, stacklevel=3)
        if self.tau < self.min_frequency:
            raise bad("tau must not be below min_frequency")
        if min([*self.sigmas, self.sigma_for_thresholding], default=0) < 0:
            raise bad("noise scales must not be negative")
