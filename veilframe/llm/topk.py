"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Components become integers ``floor(scale * x)``. Candidates are ordered by
descending length. For one query block a task looks at its candidates in
three steps, each of which can only drop what cannot reach the query's
threshold: the length bound ``|q| |c|``, the partial sum over the leading
rotated components plus the Cauchy-Schwarz bound of the residuals, and the
exact integer product of what is left. Thresholds are the k-th best score
among the longest vectors (a seed of fixed size) and then the best so far.

Parts of about ``PART_ROWS`` candidates are searched in waves, each several
times as many parts as all before, longest vectors first; between waves the
best of each query are merged and its threshold rises. A merge goes by (query,
some of the parts) and then by query, so no task meets one query's rows of all
parts.

Queries are a stated set: they are written once to the shared folder as
blocks, and every task streams the blocks past its candidates, so neither
side is broadcast or collected.

Defined cases: a table with a vector whose integers have a length of 2**31 or
more is refused, as scores might not fit a long; vectors that are null or hold null, NaN or infinite components
take no part; shorter vectors count as padded with zeros; rows that repeat a
vec_id are candidates each, and a query's own id is never its candidate; ties
go to the smaller id; fewer than k candidates give fewer rows; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, open_fs, shared_path

SCALE, K, QUERY_EVERY = 1024, 10, 100
LONGEST = 2.0**31
SEED_ROWS, QUERY_BLOCK, PART_ROWS, HEAD = 2048, 256, 16384, 16
#: Parts of the first wave, and by how much a wave is larger than the one before.
FIRST_WAVE, WAVE = 64, 8


def integer_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (integers), norm2, for the rows that take part."""
    v = F.col(f"`{vector_col}`")
    whole = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    rows = rows.where(v.isNotNull() & F.col(f"`{id_col}`").isNotNull()).where(F.forall(v, whole))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    # integers beyond 64 bits are cut to them, and are too long still
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat, off = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    off = off - off[0] if len(off) else off
    n = len(column)
    out = np.zeros((n, d), np.int64)
    size = np.diff(off)
    if n and d and (size == d).all():
        return flat.astype(np.int64).reshape(n, d)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1], size)] = flat
    return out


def _gram(d: int):
    i, j = np.triu_indices(d)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column(0), d).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    return rows


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all vectors (d x d), strongest first."""
    cells = vectors.select("v").mapInArrow(_gram(d), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # d * d rows
    gram = np.zeros((d, d))
    for r in cells:
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["s"]
    values, vecs = np.linalg.eigh(gram)
    return vecs[:, np.argsort(-values)]


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, through doubles while those are exact."""
    if not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _seeded(seed_ids: np.ndarray, seed: np.ndarray, k: int, d: int):
    """Query rows with their k-th best score among the seed (null: fewer)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(i, QUERY_BLOCK)
                ids, q = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), d)
                s = _scores(q, seed).astype(np.float64)
                s[ids[:, None] == seed_ids[None, :]] = -np.inf
                best = np.full(len(ids), -np.inf) if s.shape[1] < k else np.partition(s, s.shape[1] - k, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best)], ["vec_id", "v", "least"])

    return rows


def _query_blocks(uri: str, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, root = open_fs(uri)
    for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda x: x.path):
        if info.base_name.startswith(("_", ".")) or not info.size:
            continue
        with fs.open_input_file(info.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(QUERY_BLOCK):
                yield batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), d), batch.column("least").to_numpy().copy()


def _search(uri: str, vt: np.ndarray, k: int, d: int):
    head = min(HEAD, d)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, PART_ROWS):
                part = b.slice(i, PART_ROWS)
                held.append((part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), d)))
                n += part.num_rows
                if n >= PART_ROWS:
                    yield from one(held)
                    held, n = [], 0
        if held:
            yield from one(held)

    def one(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, c = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norm))
        ids, c, norm = ids[order], c[order], norm[order]
        rot = c.astype(np.float64) @ vt
        c_head, c_tail = rot[:, :head], np.sqrt((rot[:, head:] ** 2).sum(1))
        for q_ids, q, least in _query_blocks(uri, d):
            q_rot = q.astype(np.float64) @ vt
            q_norm, q_head, q_tail = np.sqrt((q_rot**2).sum(1)), q_rot[:, :head], np.sqrt((q_rot[:, head:] ** 2).sum(1))
            found: list[tuple[np.ndarray, ...]] = []
            for a in range(0, len(ids), 4096):  # longest first
                slack = 1e-6 * q_norm * norm[a] + 1e-3
                live = np.flatnonzero(q_norm * norm[a] + slack >= least)
                if not len(live):
                    break
                b = min(a + 4096, len(ids))
                bound = q_head[live] @ c_head[a:b].T + q_tail[live, None] * c_tail[None, a:b] + slack[live, None]
                keep = bound >= least[live, None]
                r, col = np.nonzero(keep)
                if not len(r):
                    continue
                if len(r) * 4 > keep.size:
                    s = _scores(q[live], c[a:b])[r, col]
                else:
                    s = np.concatenate([np.einsum("ij,ij->i", q[live[r[x : x + 65536]]], c[a + col[x : x + 65536]]) for x in range(0, len(r), 65536)])
                r, col = live[r], col + a
                fine = (s >= least[r]) & (q_ids[r] != ids[col])
                found.append((r[fine], s[fine], ids[col[fine]]))
                if len(found) > 1:
                    found = [tuple(np.concatenate(x) for x in zip(*found, strict=True))]
                found = [_best(*found[0], k)]
                r, s, _ = found[0]
                n = np.bincount(r, minlength=len(q_ids))
                full = n >= k
                kth = np.full(len(q_ids), np.inf)
                np.minimum.at(kth, r, s.astype(np.float64))
                least = np.where(full, np.maximum(least, kth), least)
            if found and len(found[0][0]):
                r, s, i = found[0]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    return rows


def _best(r: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -s, r))
    r, s, ids = r[order], s[order], ids[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], s[keep], ids[keep]


def top_k(rows: DataFrame, k: int = K, query_every: int = QUERY_EVERY, id_col="vec_id", vector_col="embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query."""
    spark = rows.sparkSession
    vectors = materialise(integer_vectors(rows, id_col, vector_col, scale), "vectors")
    size = vectors.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n"), F.max("norm2").alias("longest")).first()
    d, n = max(1, size["d"] or 1), size["n"]
    if (size["longest"] or 0) >= LONGEST**2:  # by Cauchy-Schwarz all sums below are exact
        raise ValueError("a vector is too long for scores of 64 bits")
    vt = rotation(vectors, d)
    seed = vectors.orderBy(F.col("norm2").desc(), "vec_id").limit(SEED_ROWS).select("vec_id", "v").toArrow().combine_chunks()
    seed_ids, seed_rows = seed.column("vec_id").to_numpy(), _matrix(seed.column("v").combine_chunks(), d) if seed.num_rows else np.zeros((0, d), np.int64)
    uri = shared_path(spark, "queries")
    queries = vectors.where(F.pmod("vec_id", F.lit(query_every)) == 0).select("vec_id", "v")
    queries.mapInArrow(_seeded(seed_ids, seed_rows, k, d), "vec_id long, v array<long>, least double").write.parquet(uri)
    parts = max(1, -(-n // PART_ROWS))
    ranged = vectors.repartitionByRange(parts, F.col("norm2").desc(), "vec_id")
    if parts > FIRST_WAVE:
        ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    best, begin, end = None, 0, min(parts, FIRST_WAVE)
    while True:
        wave = ranged if parts <= FIRST_WAVE else ranged.where((F.col("part") >= begin) & (F.col("part") < end))
        hits = wave.select("vec_id", "v").mapInArrow(_search(uri, vt, k, d), "query_id long, vec_id long, score long")
        best = _merged(hits if best is None else hits.union(best.select(*hits.columns)), k, end - begin)
        if end >= parts:
            return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        best = materialise(best, "best")
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("k_id"), F.col("score").cast("double").alias("kth"))
        old = spark.read.parquet(uri)
        uri = shared_path(spark, "queries")
        # rows that repeat a vec_id have one threshold
        risen = old.join(kth, old["vec_id"] == kth["k_id"], "left").select("vec_id", "v", F.greatest("least", F.coalesce("kth", "least")).alias("least"))
        risen.write.parquet(uri)
        begin, end = end, min(parts, end + end * WAVE)


def _merged(hits: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best hits of each query, with their ranks."""
    by = W.orderBy(F.col("score").desc(), "vec_id")
    if parts > 16:
        some = F.pmod(F.xxhash64("vec_id"), F.lit(int(parts**0.5))).alias("__some")
        first = W.partitionBy("query_id", "__some").orderBy(F.col("score").desc(), "vec_id")
        hits = hits.withColumn("__some", some).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "vec_id", "score")
    return hits.withColumn("rank", F.row_number().over(by.partitionBy("query_id"))).where(F.col("rank") <= k)


def op9_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
