"""Raw statistics of a release as columns of one aggregation.

Equal kernels are computed once, so AVG, VAR and SUM of a column share their
sums. Clipping skips NULL (``least`` and ``greatest`` alone would not).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..model import Aggregation, AggregationColumn, bounds


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clipped(name: str, low: float, high: float) -> Column:
    x = quoted(name).cast("double")
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


class Kernels:
    """Collects kernels and gives each a helper column name."""

    def __init__(self) -> None:
        self.columns: dict[tuple, Column] = {}
        self.names: dict[tuple, str] = {}

    def _add(self, key: tuple, column: Column) -> str:
        if key not in self.names:
            self.names[key] = f"__raw_{len(self.names)}"
            self.columns[key] = column.alias(self.names[key])
        return self.names[key]

    def of(self, agg: AggregationColumn, clip) -> tuple[str, ...]:
        a, cols = agg.aggregation, agg.columns
        if a is Aggregation.COUNT:
            c = cols[0] if cols else "*"
            return (self._add(("n", c), F.count(F.lit(1) if c == "*" else quoted(c)).cast("double")),)
        if a is Aggregation.COUNT_DISTINCT:
            if len(cols) != 1:
                raise ValidationError("COUNT(DISTINCT) takes one column")
            return (self._add(("d", cols[0]), F.count_distinct(quoted(cols[0])).cast("double")),)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        x = (cols[0], *bounds(clip, 0))
        if not a.covariance:
            cx = clipped(*x)
            names = [self._add(("n", x[0]), F.count(quoted(x[0])).cast("double")), self._add(("s", x), total(cx))]
            if a is Aggregation.SUM:
                return (names[1],)
            if a is not Aggregation.AVG:
                names.append(self._add(("q", x), total(cx * cx)))
            return tuple(names)
        y = (cols[1], *bounds(clip, 1))
        both = quoted(x[0]).isNotNull() & quoted(y[0]).isNotNull()
        cx, cy = (F.when(both, clipped(*v)) for v in (x, y))
        return (
            self._add(("n2", x[0], y[0]), F.count(F.when(both, F.lit(1))).cast("double")),
            self._add(("s2", x, y), total(cx)),
            self._add(("s2", y, x), total(cy)),
            self._add(("p", x, y), total(cx * cy)),
        )
