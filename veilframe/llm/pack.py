"""Best-fit packing of documents into fixed-length token sequences.

The instance is a histogram: piece lengths lie in 1..capacity, so however
many documents there are, the plan is made from ``capacity`` counts.

1. Martello-Toth dominance reduction: from the longest piece down, a set of
   at most three pieces that dominates every other set with its longest piece
   is fixed for good, with its multiplicity, and leaves the instance.
2. Best-fit decreasing packs the rest; bins of one residual are kept as
   patterns with multiplicities, so each length splits a few patterns at most.

A plan is a list of patterns; its "slots" say for every length which ranks of
pieces of that length go to which sequence and offset. Their number depends
on the capacity alone, so they may be sent to every task. Ranks come from a
count of lengths per partition summed over partitions.

Defined cases: null or empty text is the end id alone; null doc_id is carried
as null; repeated rows are packed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokenise
from .common import doc_columns, map_arrow, materialise

CAPACITY = 2048
END_ID = 0
#: Parts of texts whose ids a worker keeps (some 60 MB): workers outlive this
#: operator, and in a pipeline the others need the room.
CACHE_PARTS = 300_000
Pattern = tuple[tuple[int, int], ...]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed sets with multiplicities, and the counts that are left."""
    left = {s: n for s, n in counts.items() if n}
    sizes = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def take(items: tuple[int, ...], m: int) -> None:
        pattern: dict[int, int] = {}
        for s in items:
            pattern[s] = pattern.get(s, 0) + 1
        for s, q in pattern.items():
            left[s] -= q * m
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
        fixed.append((tuple(sorted(pattern.items(), reverse=True)), m))

    for w in sorted(left, reverse=True):
        while left.get(w):
            n, room = left[w], capacity - w
            free = lambda s, w=w: left[s] - (s == w)
            small: list[int] = []
            for s in sizes:
                small += [s] * min(3 - len(small), free(s))
                if len(small) == 3:
                    break
            fits = sum(1 for i in range(len(small)) if sum(small[: i + 1]) <= room)
            if not fits:
                take((w,), n)
                continue
            j = next(s for s in reversed(sizes[: bisect.bisect_right(sizes, room)]) if free(s) > 0)
            some = max(1, min(n, left[j] - 3)) if j != w else max(1, (n - 3) // 2)
            if w + j == capacity:
                take((w, j), n // 2 if j == w else min(n, left[j]))
            elif fits == 1:
                take((w, j), some)
            elif fits == 2:
                a, b = _best_pair(sizes, free, room)
                if j >= a + b:
                    take((w, j), some)
                elif a == j and _between(left, sizes, free, a, b) <= 1:
                    take((w, a, b), 1)
                else:
                    break
            else:
                break
    return fixed, left


def _best_pair(sizes: list[int], free, room: int) -> tuple[int, int]:
    """The two pieces of largest sum within ``room`` (larger one first)."""
    best = (0, 0)
    open_ = [s for s in sizes if free(s) > 0]
    hi = len(open_) - 1
    for lo, b in enumerate(open_):
        while hi >= lo and (open_[hi] + b > room or hi == lo and free(b) < 2):
            hi -= 1
        if hi < lo:
            break
        if open_[hi] + b > sum(best):
            best = (open_[hi], b)
    return best


def _between(left, sizes, free, a: int, b: int) -> int:
    """Pieces that stand strictly between a and b in order of length."""
    if a == b:
        return free(a) - 2
    return free(a) - 1 + free(b) - 1 + sum(free(s) for s in sizes[bisect.bisect_right(sizes, b) : bisect.bisect_left(sizes, a)])


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts; patterns with multiplicities."""
    bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, m: int) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append([pattern, m])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                q = capacity // s
                if n // q:
                    put(capacity - q * s, ((s, q),), n // q)
                if n % q:
                    put(capacity - n % q * s, ((s, n % q),), 1)
                break
            room = rooms[at]
            pattern, m = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            q = room // s
            full = min(m, n // q)
            if full:
                put(room - q * s, (*pattern, (s, q)), full)
                m, n = m - full, n - full * q
            if n and m:  # then n < q
                put(room - n * s, (*pattern, (s, n)), 1)
                m, n = m - 1, 0
            if m:
                put(room, pattern, m)
    return [(pattern, m) for room in rooms for pattern, m in bins[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each run of ranks of one length: sequence, offset and pieces a sequence."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern, m in patterns:
        offset = 0
        for s, q in pattern:
            first = rank.get(s, 0)
            rows.append((s, first, base, offset, q))
            rank[s] = first + m * q
            offset += s * q
        base += m
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3], "each": a[:, 4]}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _cutter(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokenise.encoder(tokenizer, CACHE_PARTS), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(docs), 256):
                rows: list[tuple] = []
                for doc, raw in zip(docs[i : i + 256], enc.encode_many(texts.slice(i, 256).to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                    at, stop = 0, len(ids) % capacity or capacity
                    for piece in range(-(-len(ids) // capacity)):
                        own = ids[at:stop]
                        n = len(own)
                        rows.append((doc, piece, at, n, zlib.crc32(own.tobytes()), part, seen[n], *([own.astype(np.int32)] * with_ids)))
                        seen[n] += 1
                        at, stop = stop, stop + capacity
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.list_(pa.int32())] * with_ids)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return cut


def _placer(table: dict[str, np.ndarray]):
    key = table["length"] << 48 | table["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            nth, each = rank - table["first"][at], table["each"][at]
            names = [n for n in batch.schema.names if n != "rank"]
            cols = [batch.column(n) for n in names] + [pa.array(table["sequence"][at] + nth // each), pa.array(table["offset"][at] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    return place


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (and ids),
    sequence_id, offset."""
    rows = doc_columns(docs, id_col, text_col, "text")
    extra = ", ids array<int>" * with_ids
    pieces = materialise(map_arrow(rows, _cutter(tokenizer or tokenise.default_path(), capacity, end_id, with_ids), _PIECES + extra, encodes=True), "pieces")
    # rows of this table: partitions x lengths at most
    per = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = slots(plan(counts, capacity))
    ranked = pieces.join(per.select("part", "length", "before"), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"), *["ids"] * with_ids)
    return map_arrow(ranked, _placer(table), "doc_id long, piece int, start long, length long, ids_crc32 long" + extra + ", sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces packed ``with_ids``."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda x: x["ids"])).alias("ids"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
