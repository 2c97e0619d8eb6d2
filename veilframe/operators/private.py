"""Relational operators of a private release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.kernels import quoted

HELPER = "__veil_"
#: The largest k for which Spark limits groups before it shuffles them.
GROUP_LIMIT = 1000
#: Parts of a unit, for larger k.
PARTS = 64
#: Units, and characters of them, that are broadcast at most.
HEAVY_UNITS, HEAVY_CHARS = 10_000, 1 << 20


def heavy_units(df: DataFrame, unit: str, k: float) -> list | None:
    """Privacy units with more than k rows (NULL: one unit), or None for more
    than ``HEAVY_UNITS`` of them. Counts are combined before they are
    shuffled, so this moves units, not rows, and a hot unit is no key apart."""
    counted = df.groupBy(quoted(unit)).agg(F.count(F.lit(1)).alias(f"{HELPER}rows")).where(F.col(f"{HELPER}rows") > int(k))
    found = [r[0] for r in counted.select(quoted(unit)).limit(HEAVY_UNITS + 1).collect()]
    return found if len(found) <= HEAVY_UNITS and sum(len(str(x)) for x in found) <= HEAVY_CHARS else None


def bound_contributions(df: DataFrame, unit: str, k: float, heavy: list | None = None) -> DataFrame:
    """At most k random rows of each privacy unit (NULL: one unit).

    Where ``heavy`` lists all units with more than k rows, only their rows are
    ranked and all others pass as they are; otherwise every row is ranked. Up to ``GROUP_LIMIT`` a task sends k rows of a unit at most. Beyond it the
    rows of a unit are first dealt by chance to ``PARTS`` parts, of which k
    rows each are kept, so no task sorts a whole hot unit.
    """
    if any(c.lower().startswith(HELPER) for c in df.columns):
        raise ValidationError(f"column names may not begin with {HELPER}")
    if heavy is not None:
        if not heavy:
            return df
        few = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in heavy], T.StructType([T.StructField(f"{HELPER}unit", df.schema[_named(df, unit)].dataType)])))
        same = quoted(unit).eqNullSafe(F.col(f"{HELPER}unit"))
        return df.join(few, same, "left_anti").union(bound_contributions(df.join(few, same, "left_semi"), unit, k))
    order, rank = F.col(f"{HELPER}order"), F.col(f"{HELPER}rank")
    first = lambda rows, *by: rows.withColumn(f"{HELPER}rank", F.row_number().over(W.partitionBy(quoted(unit), *by).orderBy(order))).where(rank <= int(k))
    rows = df.withColumn(f"{HELPER}order", F.rand())
    if k > GROUP_LIMIT:
        part = F.floor(order * (PARTS << 20)) % PARTS  # finer digits than those that rank
        rows = first(rows, part).drop(rank)
    return first(rows).drop(f"{HELPER}order", f"{HELPER}rank")


def _named(df: DataFrame, name: str) -> str:
    return next(c for c in df.columns if c.lower() == name.lower())


def unit_counts(df: DataFrame, unit: str, keys: list[str], least: float) -> DataFrame:
    """Keys with at least ``least`` distinct units, and that count."""
    counted = df.groupBy(*[quoted(k) for k in keys]).agg(F.count_distinct(quoted(unit)).cast("double").alias(f"{HELPER}units"))
    return counted.where(F.col(f"{HELPER}units") >= least)


def keep_keys(df: DataFrame, keys: list[str], selected: DataFrame, few: bool) -> DataFrame:
    """Rows whose keys are selected; NULL keys match NULL."""
    other = selected.select(*[quoted(k).alias(f"{HELPER}key{i}") for i, k in enumerate(keys)])
    cond = None
    for i, k in enumerate(keys):
        same = quoted(k).eqNullSafe(F.col(f"{HELPER}key{i}"))
        cond = same if cond is None else cond & same
    return df.join(F.broadcast(other) if few else other, cond, "left_semi")
