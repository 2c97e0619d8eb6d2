"""What the learned scorers share: label rows, bounded samples, score columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow


def held_out(id_col: str, modulus: int, remainder: int):
    """True for ids whose labels are never learned from (a null id counts as 'null')."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    return F.crc32(text) % modulus == remainder


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int, limit: int, id_col="doc_id", text_col="text") -> DataFrame:
    """text and label of at most ``limit`` labelled documents outside the
    held-out fold, chosen by a hash of the id. A document with several labels
    takes the largest; null labels and ids are left out."""
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col, modulus, remainder))
    known = known.groupBy(F.col(f"`{id_col}`").alias("l_id")).agg(F.max(f"`{label_col}`").cast("double").alias("label"))
    some = known.orderBy(F.xxhash64("l_id"), "l_id").limit(limit)
    # the broadcast side has ``limit`` rows of two numbers at most
    return docs.select(F.col(f"`{id_col}`").alias("d_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(some), F.col("d_id") == F.col("l_id")).select("text", "label")


def append_score(docs: DataFrame, scorer: Callable[[pa.Array], np.ndarray], text_col: str, out_col: str) -> DataFrame:
    """``docs`` with one double column more, from whole texts."""
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(np.asarray(scorer(batch.column(at)), np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out_col])

    return map_arrow(docs, rows, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


class Adam:
    """Adam over a dictionary of parameters."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
