"""The fixed plan of one release, in three Spark jobs.

    count rows by unit: which units exceed the bound       (job 1)
    bound -> count units by key -> two thresholds          (job 2)
    inner semi-joined with the selected keys -> bound again
          -> one aggregation with all kernels -> noise      (job 3)

Job 1 moves one number a unit and spares both bounds their shuffle and sort
of all rows where no unit, or few, exceed k.

Noise is drawn once: on the driver for up to ``DRIVER_KEYS`` keys, otherwise
by tasks into a written table, so that no later action draws it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionBackendError
from ..functions import mechanisms as m
from ..functions.calibrate import noise_parameters
from ..functions.kernels import Kernels
from ..functions.noise import NoiseMode, gaussian
from ..model import Aggregation, AggregationColumn, DPParams, bounds
from ..operators.private import HELPER, bound_contributions, heavy_units, keep_keys, unit_counts
from ..storage import session_folder

DRIVER_KEYS = 100_000
#: Estimated bytes of input beyond which raw statistics are written before
#: they are counted, as a second run would cost more than the write.
WRITE_FIRST = 4 << 30


def _cell(agg: AggregationColumn, clip, raw: list[float], sigma: float, noise: Callable[[float, float], float]) -> float:
    a = agg.aggregation
    if a.counts or a is Aggregation.SUM:
        return noise(raw[0], sigma)
    if a.covariance:
        return m.private_covar(*raw, bounds(clip, 0), bounds(clip, 1), sigma, noise, a is Aggregation.COVAR_SAMP)
    low, high = bounds(clip, 0)
    if a is Aggregation.AVG:
        return m.private_avg(*raw, low, high, sigma, noise)
    f = m.private_var if a in (Aggregation.VAR_POP, Aggregation.VAR_SAMP) else m.private_stddev
    return f(*raw, low, high, sigma, noise, a in (Aggregation.VAR_SAMP, Aggregation.STDDEV_SAMP))


def _written(df: DataFrame) -> DataFrame:
    path = f"{session_folder(df.sparkSession)}/release-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _input_bytes(df: DataFrame) -> int:
    """The estimated size of the relations that df reads; rows of the driver's
    own, such as selected keys, have no estimate."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(x.stats().sizeInBytes())) for x in map(leaves.apply, range(leaves.size())) if x.nodeName() != "LogicalRDD")


def _once(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> tuple[DataFrame, bool]:
    """f over all rows of df, computed once; and whether the rows were few."""
    spark = df.sparkSession
    if _input_bytes(df) > WRITE_FIRST:
        df = _written(df)
    # as objects: a NULL key must not turn integers into floats
    head = pd.DataFrame([tuple(r) for r in df.limit(DRIVER_KEYS + 1).collect()], columns=df.columns, dtype=object)
    if len(head) <= DRIVER_KEYS:
        rows = f(head).astype(object)
        rows = rows.where(rows.notna(), None)
        return spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], schema), True
    return _written(df.mapInPandas(lambda parts: map(f, parts), schema)), False


def release(inner: DataFrame, unit: str, items: list[AggregationColumn | str], keys: list[str], params: DPParams, order=(), limit: int | None = None, offset: int = 0, mode: NoiseMode = NoiseMode.SECURE, enforce_global_min_frequency: bool = False) -> DataFrame:
    """The noisy result: columns in the order of ``items``; counts are doubles."""
    aggs = [x for x in items if isinstance(x, AggregationColumn)]
    sigmas, tau, sigma_thr = noise_parameters(aggs, params)
    k = params.contribution_bound
    noise = lambda x, s: gaussian(x, s, mode)
    kernels = Kernels()
    raw = [kernels.of(a, c) for a, c in zip(aggs, params.clipping_thresholds, strict=True)]
    names = [x if isinstance(x, str) else x.name for x in items]
    fields = {f.name: f for f in inner.schema.fields}
    lower = {n.lower(): f for n, f in fields.items()}
    schema = T.StructType([T.StructField(x, lower[x.lower()].dataType) if isinstance(x, str) else T.StructField(x.name, T.DoubleType()) for x in items])

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        keep = [noise(n, sigma_thr) >= tau for n in rows[f"{HELPER}units"]]
        return rows[pd.Series(keep, index=rows.index, dtype=bool)][keys]

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        out, i = {}, 0
        for x, name in zip(items, names, strict=True):
            if isinstance(x, str):
                out[name] = rows[x]
            else:
                clip = params.clipping_thresholds[i]
                out[name] = [_cell(x, clip, list(v), sigmas[i], noise) for v in rows[list(raw[i])].itertuples(index=False)]
                i += 1
        return pd.DataFrame(out, columns=names)

    try:
        heavy = heavy_units(inner, unit, k)
        if keys or enforce_global_min_frequency:
            counts = unit_counts(bound_contributions(inner, unit, k, heavy), unit, keys, params.min_frequency)
            chosen = T.StructType([T.StructField(x, lower[x.lower()].dataType) for x in keys])
            if keys:
                selected, few = _once(counts, select, chosen)
                inner = keep_keys(inner, keys, selected, few)
            else:
                row = counts.first()
                if row is None or noise(row[0], sigma_thr) < tau:
                    return inner.sparkSession.createDataFrame([], schema)
        # fewer rows have no more heavy units
        rows = bound_contributions(inner, unit, k, heavy)
        totals = rows.groupBy(*[f"`{x}`" for x in keys]).agg(*kernels.columns.values())
        out, _ = _once(totals, draw, schema)
    except Exception as e:  # messages of the host may hold values of rows
        if type(e).__module__.startswith(("pyspark", "py4j")):
            raise ExecutionBackendError("the query could not be run", cause=e, hint=getattr(e, "getCondition", lambda: None)()) from None
        raise
    if order:
        out = out.orderBy(*[(F.asc_nulls_last if up else F.desc_nulls_last)(f"`{c}`") for c, up in order])
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
