"""Token-ID binary files: patched frame-of-reference blocks.

A file holds segments; a segment holds the ids of some consecutive documents:

    "PFR1" | n_docs u32 | n_ids u64 | n_blocks u32 | body_bytes u64
    doc_id i64[n_docs] | null flag u8[n_docs] | n_tokens u32[n_docs]
    block start u64[n_blocks]            offset of each block in the body
    body: per block  minimum u32 | width u8 | exceptions u16
                     packed u64[4 * width]            256 offsets from the minimum
                     position u8[exceptions] | high part u32[exceptions]

The width is the number of bits that hold the ``PERCENTILE`` of a block's
offsets; larger ones keep their low bits in place and their high part in the
exception list. The last block is padded with its own minimum.

One task writes one file under a name of its own; the committed output of
the writing job (a small table) names the files that count, so repeated or
speculative tasks leave no trace in the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokenise
from .common import doc_columns, materialise, open_fs, shared_path

BLOCK = 256
PERCENTILE = 90
END_ID = 2
#: Ids of one segment (a longer document is one segment of its own).
SEGMENT_IDS = 1 << 18
_HEAD = "<4sIQIQ"
_HEAD_BYTES = struct.calcsize(_HEAD)
_BLOCK_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def _bit_width(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(m, 256) values under 2**width as (m, 4 * width) words, 64 values to ``width`` words."""
    v = v.reshape(-1, 64)
    out = np.zeros((len(v), width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1, 4 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(-1, width) if width else np.zeros((len(words) * 4, 0), np.uint64)
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1, BLOCK)


def encode_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    if n_blocks and len(ids) % BLOCK:
        padded[len(ids) :] = ids[-(len(ids) % BLOCK) :].min()
    v = padded.reshape(-1, BLOCK)
    low = v.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    v = v - low[:, None]
    kth = BLOCK * PERCENTILE // 100
    width = _bit_width(np.partition(v, kth, axis=1)[:, kth]) if n_blocks else np.zeros(0, np.int64)
    high = v >> width[:, None].astype(np.uint64)
    row, col = np.nonzero(high)
    n_exc = np.bincount(row, minlength=n_blocks)
    head = np.zeros(n_blocks, _BLOCK_HEAD)
    head["minimum"], head["width"], head["exceptions"] = low, width, n_exc
    sizes = _BLOCK_HEAD.itemsize + 32 * width + 5 * n_exc
    start = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), np.uint8)
    _scatter(body, start, head.view(np.uint8).reshape(n_blocks, _BLOCK_HEAD.itemsize))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            low_bits = v[at] & np.uint64((1 << int(w)) - 1)
            _scatter(body, start[at] + _BLOCK_HEAD.itemsize, _pack(low_bits, int(w)).view(np.uint8))
    first = start + _BLOCK_HEAD.itemsize + 32 * width
    nth = np.arange(len(row)) - (np.cumsum(n_exc) - n_exc)[row]
    body[first[row] + nth] = col
    _scatter(body, first[row] + n_exc[row] + 4 * nth, high[row, col].astype("<u4").view(np.uint8).reshape(-1, 4))
    known = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([struct.pack(_HEAD, b"PFR1", len(doc_ids), len(ids), n_blocks, len(body)), known.tobytes(), null.tobytes(), np.asarray(counts, "<u4").tobytes(), start.astype("<u8").tobytes(), body.tobytes()])


def _scatter(body: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    if rows.size:
        body[at[:, None] + np.arange(rows.shape[1])] = rows


def decode_segment(buf: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a segment."""
    magic, n_docs, n_ids, n_blocks, n_body = struct.unpack_from(_HEAD, buf)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    at = _HEAD_BYTES
    take = lambda dtype, n: np.frombuffer(buf, dtype, n, at)
    known = take("<i8", n_docs)
    at += 8 * n_docs
    null = take("u1", n_docs)
    at += n_docs
    counts = take("<u4", n_docs)
    at += 4 * n_docs
    start = take("<u8", n_blocks).astype(np.int64)
    at += 8 * n_blocks
    body = take("u1", n_body)
    head = body[start[:, None] + np.arange(_BLOCK_HEAD.itemsize)].copy().view(_BLOCK_HEAD).ravel() if n_blocks else np.zeros(0, _BLOCK_HEAD)
    width, n_exc = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    v = np.zeros((n_blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        sel = np.flatnonzero(width == w)
        if w:
            words = body[(start[sel] + _BLOCK_HEAD.itemsize)[:, None] + np.arange(32 * w)].copy().view(np.uint64)
            v[sel] = _unpack(words, int(w))
    row = np.repeat(np.arange(n_blocks), n_exc)
    nth = np.arange(len(row)) - (np.cumsum(n_exc) - n_exc)[row]
    first = start + _BLOCK_HEAD.itemsize + 32 * width
    col = body[first[row] + nth]
    high = body[(first[row] + n_exc[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel() if len(row) else np.zeros(0, "<u4")
    v[row, col] |= high.astype(np.uint64) << width[row].astype(np.uint64)
    v += head["minimum"].astype(np.uint64)[:, None]
    ids = v.ravel()[:n_ids].astype("<u4")
    return [None if z else int(d) for d, z in zip(known, null, strict=True)], counts.astype(np.int64), ids


def read_block(buf: bytes, block: int) -> np.ndarray:
    """Ids of one block of a segment, found through the index of block starts."""
    _, n_docs, n_ids, n_blocks, n_body = struct.unpack_from(_HEAD, buf)
    index = _HEAD_BYTES + 13 * n_docs
    body = index + 8 * n_blocks
    at = body + int(np.frombuffer(buf, "<u8", 1, index + 8 * block)[0])
    head = np.frombuffer(buf, _BLOCK_HEAD, 1, at)[0]
    at += _BLOCK_HEAD.itemsize
    width, n_exc = int(head["width"]), int(head["exceptions"])
    v = _unpack(np.frombuffer(buf, np.uint64, 4 * width, at).reshape(1, -1), width)[0] if width else np.zeros(BLOCK, np.uint64)
    at += 32 * width
    pos = np.frombuffer(buf, "u1", n_exc, at)
    v[pos] |= np.frombuffer(buf, "<u4", n_exc, at + n_exc).astype(np.uint64) << np.uint64(width)
    return (v + np.uint64(head["minimum"]))[: n_ids - block * BLOCK].astype("<u4")


_MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenise.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.pfr"
        end = np.array([end_id], enc.dtype).tobytes()
        docs, total, size, out = 0, 0, 0, None
        held: tuple[list, list, list] = ([], [], [])

        def flush():
            nonlocal docs, total, size, out
            ids = np.frombuffer(b"".join(held[2]), enc.dtype)
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path)
            seg = encode_segment(held[0], np.array(held[1]), ids)
            out.write(seg)
            docs, total, size = docs + len(held[0]), total + len(ids), size + len(seg)
            for x in held:
                x.clear()

        kept = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 128):
                for doc, raw in zip(ids[i : i + 128], enc.encode_many(texts.slice(i, 128).to_pylist()), strict=True):
                    held[0].append(doc)
                    held[1].append(len(raw) // enc.dtype.itemsize + 1)
                    held[2].extend((raw, end))
                    kept += held[1][-1]
                    if kept >= SEGMENT_IDS:
                        flush()
                        kept = 0
        if held[0]:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": docs, "n_ids": total, "n_bytes": size}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    return write


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_col="doc_id", text_col="text") -> DataFrame:
    """Writes all documents in ascending doc_id order (null first, equal ids
    by text) and returns the table of files: part, path, n_docs, n_ids,
    n_bytes. Parts are in order, and so are the documents of each file.
    Null text is empty; an empty table writes nothing."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    rows = doc_columns(docs, id_col, text_col, "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(rows.mapInArrow(_writer(folder, tokenizer or tokenise.default_path(), end_id), _MANIFEST), "token-manifest")


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(uri: str, with_ids: bool):
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(uri)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                with fs.open_input_stream(row["path"]) as f:
                    while head := f.read(_HEAD_BYTES):
                        _, n_docs, _, n_blocks, n_body = struct.unpack(_HEAD, head)
                        doc_ids, counts, ids = decode_segment(head + f.read(13 * n_docs + 8 * n_blocks + n_body))
                        ends = np.cumsum(counts)
                        raw = ids.tobytes()
                        at = ends - counts
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                        cols = [pa.array(doc_ids, pa.int64()), pa.array(at + start), pa.array(counts), pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(schema))
                        start += int(ends[-1])

    return read


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, the ids of every document in the files of a manifest."""
    spark = manifest.sparkSession
    # one row a file: the running sum is over files, not documents
    files = manifest.select("part", "path", (F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids")).alias("start"))
    n = max(1, manifest.count())
    return files.repartitionByRange(n, "part").select("path", "start").mapInArrow(_reader(shared_path(spark, "x"), with_ids), _READ + ", ids array<int>" * with_ids)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs))
