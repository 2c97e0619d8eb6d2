"""Helpers shared by the corpus operators: storage, hashing and text batches.

All functions that run on executors work on Arrow batches and bound their
working set by slicing batches into blocks of about ``BLOCK_BYTES`` of text.
"""

from __future__ import annotations

import ctypes
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import session_folder
from . import tokenise

#: Bytes of text that one vectorised step works on (a longer text is one block).
BLOCK_BYTES = 1 << 20
U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


# --- storage ---------------------------------------------------------------
def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the folder that driver and executors share."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, and later
    jobs see one fixed version of rows even when executors are lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """A pyarrow file system and path for a URI of the shared folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- memory ----------------------------------------------------------------
#: Bytes of an Arrow batch of rows on its way to a worker, unless the
#: application sets this itself (Spark's default of 64 MB is held several times
#: by an executor: in both directions, by each of its tasks and their workers).
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Seconds between two returns of memory.
GIVE_BACK_S = 0.5
_given_back = 0.0


def give_back() -> None:
    """Returns what this worker has freed to the system: workers outlive their
    tasks, and allocators would keep the largest size ever needed."""
    global _given_back
    if time.monotonic() - _given_back < GIVE_BACK_S:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    _given_back = time.monotonic()


def lean(task: Callable, encodes: bool = False) -> Callable:
    """The task, returning memory as it goes; one that does not encode texts
    lets go of the encoders that earlier tasks left in its worker."""

    def spent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            tokenise.forget()
        try:
            yield from task(spent(batches))
        finally:
            give_back()

    return run


def map_arrow(df: DataFrame, task: Callable, schema, encodes: bool = False, bound: bool = True) -> DataFrame:
    """``df.mapInArrow`` of a lean task, on batches of bounded size if ``bound``."""
    conf = df.sparkSession.conf
    if bound and conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(lean(task, encodes), schema)


# --- hashing ---------------------------------------------------------------
def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x + _M1
    x ^= x >> U(30)
    x *= _M2
    x ^= x >> U(27)
    x *= _M3
    x ^= x >> U(31)
    return x


_BASE = 0x5851F42D4C957F2D
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (the base is odd)."""
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        inv = pow(_BASE, -1, 1 << 64)
        p, q = np.full(size, U(_BASE)), np.full(size, U(inv))
        p[0] = q[0] = 1
        _POW["p"], _POW["q"] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POW["p"][:n], _POW["q"][:n]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range [start, end) of ``data``."""
    p, q = _powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * p[:-1], out=acc[1:])
    return mix64((acc[end] - acc[start]) * q[start] + (end - start).astype(np.uint64))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _M1
        out += h[i : i + n]
    return mix64(out)


# --- text batches ----------------------------------------------------------
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class TextBlock:
    """Some whole texts as one byte array, with the words of all of them.

    ``rows``: positions in the Arrow batch; ``bounds``: byte offsets of the
    texts; words are ``[^\\x20\\x09-\\x0D]+``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self, lower: bool = False) -> None:
        """Sets w_start, w_end (bytes), w_bounds (words of each text)."""
        if lower:
            self.data = _LOWER[self.data]
        sep = _SEP[self.data]
        n = len(self.data)
        is_start, is_end = ~sep, ~sep
        if n:
            is_start[1:] &= sep[:-1]
            is_end[:-1] &= sep[1:]
            inner = self.bounds[(self.bounds > 0) & (self.bounds < n)]
            is_start[inner] |= ~sep[inner]
            is_end[inner - 1] |= ~sep[inner - 1]
        self.w_start = np.flatnonzero(is_start)
        self.w_end = np.flatnonzero(is_end) + 1
        self.w_bounds = np.searchsorted(self.w_start, self.bounds)

    def word_hash(self) -> np.ndarray:
        return span_hash(self.data, self.w_start, self.w_end)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """Blocks of whole texts (null: empty) of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield TextBlock(raw[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


# --- columns ---------------------------------------------------------------
def doc_columns(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, under the operators' own names."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(n) for c, n in zip(cols[::2], cols[1::2], strict=True)])
