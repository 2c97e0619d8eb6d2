"""Media columns: Matroska files written, parsed and measured.

``parse`` reads variable-length EBML elements (unknown sizes included),
clusters, simple blocks and block groups with any lacing (none, Xiph, EBML,
fixed) and cues into a packet table: track, timestamp, byte range, cluster.
``mux_pcm`` stores bytes losslessly as 8-bit PCM packets.

Defined cases: null or empty content is 64 zero bytes; equal contents give
equal files; other columns are ignored; an empty table gives no rows; for a
damaged file ``parse`` raises ``MediaError`` with its byte position and
``packet_table`` gives one row with that message and no packet.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns

# fixed values of the Matroska and EBML specifications
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE = 0x4282
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469

FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, RATE = 1024, 8, 4, 8000
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Elements of a segment: each of them ends a cluster of unknown size.
_OF_SEGMENT = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
_MAX_DEPTH = 16


class MediaError(ValueError):
    pass


# --- writing ---------------------------------------------------------------
def _size(n: int) -> bytes:
    for width in range(1, 9):
        if n < (1 << 7 * width) - 1:
            return (n | 1 << 7 * width).to_bytes(width, "big")
    raise MediaError("element too large")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and block content for some frames."""
    if len(frames) == 1:
        return 0x00, frames[0]
    n = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, n + b"".join(frames)
    lace = [_size(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1]):  # the last size is what is left
        for width in range(1, 9):
            bias = (1 << 7 * width - 1) - 1
            if -bias <= b - a <= bias:
                lace.append((b - a + bias | 1 << 7 * width).to_bytes(width, "big"))
                break
    return 0x06, n + b"".join(lace) + b"".join(frames)


_HEAD = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_INTRO = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"veilframe") + element(0x5741, b"veilframe")) + element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def mux_pcm(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track that holds ``payload``."""
    parts, cues, place = [_INTRO], [], len(_INTRO)
    block_bytes = FRAME * FRAMES_A_BLOCK
    for at in range(0, len(payload), block_bytes * BLOCKS_A_CLUSTER):
        begin = at * 1000 // RATE
        body = [_uint(CLUSTER_TIMESTAMP, begin)]
        for b in range(at, min(at + block_bytes * BLOCKS_A_CLUSTER, len(payload)), block_bytes):
            stop = min(b + block_bytes, len(payload))
            flag, content = _laced([payload[f : min(f + FRAME, stop)] for f in range(b, stop, FRAME)])
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - begin, 0x80 | flag) + content))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, begin) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, place))))
        parts.append(cluster)
        place += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# --- reading ---------------------------------------------------------------
@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp, start, length, cluster, lacing) of every packet
    packets: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # (byte, timestamp)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (time, track, byte of the cluster)


def vint(buf: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1: unknown size."""
    if at >= len(buf) or not buf[at]:
        raise MediaError(f"no variable-length integer at byte {at}")
    width = 9 - buf[at].bit_length()
    if at + width > len(buf):
        raise MediaError(f"cut off at byte {at}")
    value = int.from_bytes(buf[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def parse(buf: bytes) -> Media:
    media, place = Media(), {"segment": 0, "cluster": -1, "time": 0, "track": {}, "cue": [0, 0, 0]}
    _walk(buf, 0, len(buf), 0, media, place)
    return media


def _number(buf: bytes, at: int, end: int) -> int:
    value = int.from_bytes(buf[at:end], "big")
    if value >= 1 << 63:
        raise MediaError(f"number too large at byte {at}")
    return value


def _float(buf: bytes, at: int, end: int) -> float:
    if end - at not in (0, 4, 8):
        raise MediaError(f"no float of {end - at} bytes at byte {at}")
    return struct.unpack({0: "", 4: ">f", 8: ">d"}[end - at], buf[at:end])[0] if end > at else 0.0


def _walk(buf: bytes, at: int, stop: int, parent: int, media: Media, place: dict, unknown: bool = False, depth: int = 0) -> int:
    """Elements of one parent; the place after it, which for a parent of
    unknown size is where an element begins that it cannot hold."""
    if depth > _MAX_DEPTH:
        raise MediaError(f"elements are nested too deeply at byte {at}")
    while at < stop:
        begin = at
        ident, at = vint(buf, at, True)
        size, at = vint(buf, at)
        if size < 0:
            end = stop
        else:
            end = at + size
            if end > stop:
                raise MediaError(f"element at byte {begin} ends after its parent")
        if unknown and (parent == CLUSTER and ident in _OF_SEGMENT or ident in (SEGMENT, EBML)):
            return begin
        if ident in _MASTERS:
            if ident == SEGMENT:
                place["segment"] = at
            elif ident == CLUSTER:
                place["cluster"], place["time"] = len(media.clusters), 0
                media.clusters.append((begin, 0))
            elif ident == TRACK_ENTRY:
                place["track"] = {}
            elif ident == CUE_POINT:
                place["cue"] = [0, 0, 0]
            end = _walk(buf, at, end, ident, media, place, size < 0, depth + 1)
            if ident == TRACK_ENTRY:
                media.tracks[place["track"].get("number", 0)] = place["track"]
            elif ident == CUE_POSITIONS:
                media.cues.append(tuple(place["cue"]))
        elif ident in (SIMPLE_BLOCK, BLOCK):
            _block(buf, at, end, media, place)
        elif ident == CLUSTER_TIMESTAMP:
            if not media.clusters:
                raise MediaError(f"cluster timestamp outside of a cluster at byte {begin}")
            place["time"] = _number(buf, at, end)
            media.clusters[-1] = (media.clusters[-1][0], place["time"])
        elif ident == CUE_TIME:
            place["cue"][0] = _number(buf, at, end)
        elif ident == CUE_TRACK:
            place["cue"][1] = _number(buf, at, end)
        elif ident == CUE_CLUSTER:
            place["cue"][2] = place["segment"] + _number(buf, at, end)
        elif ident == DOC_TYPE:
            media.doc_type = buf[at:end].decode("ascii", "replace")
        elif ident == TIMESTAMP_SCALE:
            media.scale = _number(buf, at, end)
        elif ident in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH):
            place["track"][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits"}[ident]] = _number(buf, at, end)
        elif ident == CODEC_ID:
            place["track"]["codec"] = buf[at:end].decode("ascii", "replace")
        elif ident == SAMPLING_FREQUENCY:
            place["track"]["rate"] = _float(buf, at, end)
        at = end
    return at


def _block(buf: bytes, at: int, end: int, media: Media, place: dict) -> None:
    buf, begin = buf[:end], at  # nothing is read beyond the block
    track, at = vint(buf, at)
    if track < 0 or at + 3 > end:
        raise MediaError(f"block at byte {begin} has no whole header")
    shift, flags = struct.unpack_from(">hB", buf, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        sizes = [end - at]
    else:
        if at >= end:
            raise MediaError(f"block at byte {begin} has no lace count")
        n = buf[at] + 1
        at += 1
        if lacing == 2:
            if (end - at) % n:
                raise MediaError(f"fixed lacing does not divide the block at byte {at}")
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for i in range(n - 1):
                if lacing == 1:
                    size = 0
                    while True:
                        if at >= end:
                            raise MediaError(f"lace sizes of the block at byte {begin} are cut off")
                        size, at = size + buf[at], at + 1
                        if buf[at - 1] != 255:
                            break
                elif not i:
                    size, at = vint(buf, at)
                    if size < 0:
                        raise MediaError(f"lace of unknown size in the block at byte {begin}")
                else:
                    before = at
                    value, at = vint(buf, at)
                    width = at - before
                    value = (1 << 7 * width) - 1 if value < 0 else value
                    size = sizes[-1] + value - ((1 << 7 * width - 1) - 1)
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise MediaError(f"lace sizes exceed the block that ends at byte {end}")
    when = place["time"] + shift
    for size in sizes:
        media.packets.append((track, when, at, size, place["cluster"], lacing))
        at += size


# --- columns ---------------------------------------------------------------
def _measure(media: Media, payload: np.ndarray) -> str:
    total, squares = int(payload.sum(dtype=np.int64)), int((payload.astype(np.int64) ** 2).sum())
    steps = int(np.abs(np.diff(payload.astype(np.int16))).sum(dtype=np.int64))
    n = len(payload)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={media.packets[-1][1]};mean={total / n:.4f};power={squares / n:.4f};step={steps / max(1, n - 1):.4f}"


_ROWS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _column(with_media: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for i in range(0, len(docs), 256):
                out: list[list] = [[] for _ in range(7 + with_media)]
                for text in texts.slice(i, 256).to_pylist():
                    text = text or b""
                    stored = mux_pcm(text + bytes(-len(text) % 64 if text else 64))
                    media = parse(stored)
                    payload = b"".join([stored[p[2] : p[2] + p[3]] for p in media.packets])
                    row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), _measure(media, np.frombuffer(payload, np.uint8)), *[stored] * with_media)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * with_media]
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media]
                yield pa.RecordBatch.from_arrays([docs.slice(i, 256), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names)

    return rows


def media_column(docs: DataFrame, with_media: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """Texts as Matroska files, read back and measured; ``with_media`` adds the files."""
    return doc_columns(docs, id_col, text_col, "text").mapInArrow(_column(with_media), _ROWS + ", media binary" * with_media)


_PACKETS = "id long, packet int, track long, timestamp long, start long, length long, cluster int, lacing int, error string"


def packet_table(media: DataFrame, id_col="doc_id", media_col="media") -> DataFrame:
    """One row a packet of every Matroska file in a binary column (null: none);
    a damaged file has one row, with ``error`` and nothing else but its id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "packet", "track", "timestamp", "start", "length", "cluster", "lacing", "error"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for ident, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = parse(buf).packets if buf else []
                    cols = [[ident] * len(found), range(len(found)), *zip(*found, strict=True), [None] * len(found)]
                except MediaError as e:
                    found, cols = [e], [[ident], *[[None]] * 7, [str(e)]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return doc_columns(media, id_col, media_col, "media").mapInArrow(rows, _PACKETS)


def op5_matroska(spark, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
