"""Recurring windows of a corpus, found without moving it more than once.

A window is ``length`` consecutive units (words or bytes) of one document. Its
anchor is the smallest hash among its grams of ``gram`` units, so equal
windows have equal anchors at equal places, and only a fraction of positions
are anchors.

    docs --(1)--> anchors by shard --(2)--> marks by document
    docs + marks --(3)--> stretches by shard --(4)--> spans by document
    docs + spans --(5)--> result

(1) every task packs its anchors, one binary row a shard, with short hashes of
what stands before and after each (a window that two places share holds half
of its other units on one side of the anchor at least); an anchor that a task
holds more than ``LOCAL_HOT`` times is marked there and then as flagged,
and one note of it goes to its shard; (2) a shard reports the anchors that
recur with one of their sides, and flags those that a note names or that occur more than ``HOT``
times; (3) for a recurring anchor the units of all its windows go to the
anchor's shard; for a flagged one, every window goes to the shard of its own
hash and a task sends each distinct window once, so no shard meets a group
that grows with the rows that share a passage, only with the number of tasks;
(4) the operator's own method decides exactly, on content; (5) spans are
applied, or passages located (``repeated_passages``). Documents are exchanged once by id, and steps 1, 3 and 5 read that
one exchange.

Rows that share a doc_id are one document, its smallest text; every row with a
null doc_id is a document of its own, and these stand before all others, in
order of text; a null text has no units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, TextBlock, gram_hash, map_arrow, materialise, mix64, partitions, text_blocks

#: Occurrences beyond which an anchor's windows are dealt by their own hashes.
HOT = 10_000
#: Occurrences in one batch of anchors of a task beyond which it does so itself.
LOCAL_HOT = 64
_POS_BITS = 24
_FLUSH_ROWS = 1 << 20
_FLUSH_BYTES = 24 << 20


@dataclass(frozen=True)
class Units:
    """How a text is cut: 'words' or 'bytes', window and gram lengths."""

    kind: str
    length: int
    gram: int
    #: an anchor recurs within one document too, or only in two documents
    within: bool

    def prepare(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """Unit hashes (grams start at each unit) and unit bounds of texts."""
        if self.kind == "words":
            block.words()
            return gram_hash(block.word_hash(), self.gram), block.w_bounds
        return byte_grams(block.data, self.gram), block.bounds

    def bounds(self, block: TextBlock) -> np.ndarray:
        """Unit bounds of texts alone."""
        if self.kind == "bytes":
            return block.bounds
        block.words()
        return block.w_bounds


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, k a multiple of 8."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for part in range(0, k, 8):
        out *= U(0x9E3779B97F4A7C15)
        own = data[part : part + n + 7]
        for shift in range(8):  # unaligned 8-byte words
            view = own[shift:]
            view = view[: len(view) // 8 * 8].view(np.uint64)
            out[shift::8] += view[: len(out[shift::8])]
        out = mix64(out)
    return out


def anchors(units: Units, grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, place of the anchor, first and last window, hash; places count
    from the beginning of the block."""
    size = np.diff(bounds)
    w = units.length - units.gram + 1
    n = len(grams) - w + 1
    if n <= 0 or size.max(initial=0) < units.length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    bits = max(_POS_BITS, int(len(grams)).bit_length())
    low = U((1 << bits) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < w:
        rest = w - span
        key = np.minimum(key[: len(key) - rest], key[rest:])
    per = np.maximum(0, size - units.length + 1)
    doc = np.repeat(np.arange(len(size)), per)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(bounds[:-1], per)
    at = (key[start] & low).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    f = np.flatnonzero(first)
    last = start[np.append(f[1:], len(at)) - 1]
    return doc[f], at[f], start[f], last, grams[at[f]]


def distinct_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by doc_id without those that repeat one."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        keep = np.ones(len(ids), bool)
        keep[1:] = ids[1:] != ids[:-1]
        keep[0] = before is None or ids[0] != before
        before = ids[-1]
        yield batch if keep.all() else batch.filter(pa.array(keep))


_PACK = "shard int, kind int, n long, data binary"


def _planes(column: np.ndarray) -> bytes:
    """The column as differences, byte plane after byte plane."""
    step = np.diff(column, prepend=column[:1] * 0) if column.dtype.kind == "i" else column
    return np.ascontiguousarray(step.view(np.uint8).reshape(len(step), -1).T).tobytes()


def _by_shard(shard: np.ndarray, kind: int, columns: list[np.ndarray], blobs: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """One compressed row a shard: the columns one after the other, then blobs."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1 if blobs is None else 3).compress
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    columns = [c[order] for c in columns]
    cut = np.flatnonzero(shard[1:] != shard[:-1]) + 1
    rows, ids, counts = [], [], []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)]):
        if a == b:
            continue
        parts = [_planes(c[a:b]) for c in columns]
        if blobs is not None:
            parts += [blobs[i] for i in order[a:b].tolist()]
        rows.append(pack(b"".join(parts)))
        ids.append(int(shard[a]))
        counts.append(b - a)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([kind] * len(ids), pa.int32()), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], ["shard", "kind", "n", "data"])


def _unpack(n: int, packed: bytes, types: list[str]) -> tuple[list[np.ndarray], bytes, int]:
    """Columns of a row, its bytes, and where the blobs begin."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(packed)
    out, at = [], 0
    for t in types:
        t = np.dtype(t)
        planes = np.frombuffer(data, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        column = np.ascontiguousarray(planes.T).view(t).ravel()
        out.append(np.cumsum(column, dtype=t) if t.kind == "i" else column)
        at += n * t.itemsize
    return out, data, at


#: 24 bits of an anchor's hash, its sides, document, place and reach. With the
#: shard's own bits, chance agreement stays rare, and all it costs is a stretch
#: that step 4 clears.
_ANCHOR = ["<u4", "u1", "u1", "<i8", "<i4", "u1", "u1"]
_MARK = ["<i8", "<i4", "u1", "u1"]


def _sides(units: Units, grams: np.ndarray, bounds: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Eight bits of the units before and after each anchor, half as many as a
    window has besides it; 0 where the text has fewer."""
    half = (units.length - units.gram + 1) // 2
    assert units.gram <= half <= units.gram + 1  # two grams cover a side
    out = []
    for first, there in ((at - half, at - half >= bounds[doc]), (at + units.gram, at + units.gram + half <= bounds[doc + 1])):
        first = np.where(there, first, 0)
        h = mix64(grams[first] * U(3) + grams[np.minimum(first + half - units.gram, len(grams) - 1)])
        out.append(np.where(there, h % U(255) + U(1), U(0)).astype(np.uint8))
    return out


def _anchor_rows(h: np.ndarray, *more: np.ndarray, most: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: anchors (hash, sides, doc, place, reach) by their shard; a place
    of -1 is the note of an anchor that recurs more than ``most`` times here.
    Kind 1: the flagged marks of its occurrences by the documents' shards. The
    reach of an anchor tells its windows, see ``_reach``."""
    order = np.argsort(h)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(h[order])) + 1])
    count = np.diff(np.append(cut, len(h)))
    often = np.zeros(len(h), bool)  # in order of documents, which packs better
    often[order[np.repeat(count > most, count)]] = True
    if often.any():
        _, _, doc, pos, *reach = (x[often] for x in more)
        yield from _by_shard(_doc_shard(doc, shards), 1, [doc, -1 - pos, *reach])
        note = order[cut[count > most]]
        h = np.concatenate([h[~often], h[note]])
        more = [np.concatenate([x[~often], x[note] if i != 3 else np.full(len(note), -1, x.dtype)]) for i, x in enumerate(more)]
    yield from _by_shard(((h >> U(20)) % U(shards)).astype(np.int32), 0, [((h >> U(32)) & U(0xFFFFFF)).astype(np.uint32), *more])


def _reach(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Units from an anchor's first window to the anchor, and the number of
    its windows (both under 64, as a window has under 64 units)."""
    return [(at - lo).astype(np.uint8), (hi - lo + 1).astype(np.uint8)]


def _anchor_task(units: Units, shards: int, most: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in distinct_docs(batches):
            ids = batch.column(0).to_numpy()
            for block in text_blocks(batch.column(1)):
                grams, bounds = units.prepare(block)
                doc, at, lo, hi, h = anchors(units, grams, bounds)
                if len(doc):
                    held.append((h, *_sides(units, grams, bounds, doc, at), ids[block.first + doc], (at - bounds[doc]).astype(np.int32), *_reach(at, lo, hi)))
                    count += len(doc)
                if count >= _FLUSH_ROWS:
                    yield from _anchor_rows(*(np.concatenate(x) for x in zip(*held, strict=True)), most=most, shards=shards)
                    held, count = [], 0
        if held:
            yield from _anchor_rows(*(np.concatenate(x) for x in zip(*held, strict=True)), most=most, shards=shards)

    return rows


def _per_doc(doc: np.ndarray, values: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """One row a document with its values as binary."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    a = np.concatenate([[0], cut])
    b = np.append(cut, len(doc))
    for i in range(0, len(a), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(doc[a[i : i + 20_000]]), pa.array([values[x:y].tobytes() for x, y in zip(a[i : i + 20_000], b[i : i + 20_000])], pa.binary())], ["m_id", name])


def _mark_task(within: bool, hot: int, shards: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = batch.column("kind").to_numpy() == 1
            if known.any():  # marks that step 1 made
                yield batch.filter(pa.array(known))
                batch = batch.filter(pa.array(~known))
            for shard, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "data")), strict=True):
                (h, *more), _, _ = _unpack(n, data, _ANCHOR)
                held.append((U(shard) << U(32) | h, *more))
        if not held:
            return
        h, before, after, doc, pos, *reach = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.argsort(h)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(h[order])) + 1])
        count = np.diff(np.append(cut, len(h)))
        order = order[np.repeat(count > 1, count)]  # also a note is more than one
        count = count[count > 1]
        if not len(order):
            return
        group = np.repeat(np.arange(len(count)), count)
        before, after, doc, pos, *reach = (x[order] for x in (before, after, doc, pos, *reach))
        noted = np.minimum.reduceat(pos, np.cumsum(count) - count) < 0
        flag = np.repeat(noted | (count > hot), count)
        recurs = np.repeat(noted, count)
        for side in (before, after):
            own = np.flatnonzero(side)
            if not len(own):
                continue
            key = group[own] << 8 | side[own]
            own = own[np.argsort(key)]
            key = np.sort(key)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            n = np.diff(np.append(cut, len(key)))
            again = n > 1 if within else np.minimum.reduceat(doc[own], cut) != np.maximum.reduceat(doc[own], cut)
            recurs[own] |= np.repeat(again, n)
        keep = np.flatnonzero(recurs & (pos >= 0))
        keep = keep[np.lexsort((pos[keep], doc[keep]))]
        # places are not negative: a flagged one is stored as -1 - place
        place = np.where(flag, -1 - pos, pos)[keep].astype("<i4")
        yield from _by_shard(_doc_shard(doc[keep], shards), 0, [doc[keep], place, *(x[keep] for x in reach)])

    return rows


def _doc_shard(doc: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64)) % U(shards)).astype(np.int32)


def _gather_task(name: str, runs: bool):
    """One row a document from the packed rows of its shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        types = ["<i8", "<i4", "<i4"] if runs else _MARK
        for batch in batches:
            for shard, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "data")), strict=True):
                held.setdefault(shard, []).append(_unpack(n, data, types)[0])
        for shard in list(held):
            doc, first, *more = (np.concatenate(x) for x in zip(*held.pop(shard), strict=True))
            yield from _per_doc(doc, first.astype(np.uint64) << U(32) | more[0].astype(np.uint64) if runs else first.astype(np.int64) << 16 | more[0].astype(np.int64) << 8 | more[1], name)

    return rows


def _span_rows(doc: np.ndarray, starts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Window starts of documents as runs (start, windows)."""
    if not len(doc):
        return
    order = np.lexsort((starts, doc))
    doc, starts = doc[order], starts[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (starts[1:] > starts[:-1] + 1)
    at = np.flatnonzero(new)
    last = starts[np.append(at[1:], len(starts)) - 1]
    yield from _by_shard(_doc_shard(doc[at], shards), 0, [doc[at], starts[at].astype("<i4"), (last - starts[at] + 1).astype("<i4")])


def covered(n: int, runs: bytes, length: int) -> np.ndarray:
    """Units of a document of n that its removed windows cover."""
    runs = np.frombuffer(runs, np.uint64)
    start, windows = (runs >> U(32)).astype(np.int64), (runs & U(0xFFFFFFFF)).astype(np.int64)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + windows + length - 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def window_bytes(units: Units, block: TextBlock) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Normal bytes of a block and, for each unit, its start and end there:
    words are joined by one space."""
    if units.kind == "bytes":
        place = np.arange(len(block.data))
        return block.data.tobytes(), place, place + 1
    size = block.w_end - block.w_start
    start = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(start, size) + inner] = block.data[np.repeat(block.w_start, size) + inner]
    return out.tobytes(), start, start + size


class _Firsts:
    """The first window of each hash that a task meets, with its document and
    bytes; of ``most`` hashes, as a window not kept is sent again, no more."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hash
        self.doc, self.at, self.size = (np.zeros(0, np.int64) for _ in range(3))
        self.words = np.zeros(0, np.uint64)  # bytes of all windows, each filled up with zeros

    def _keep(self, text: bytes, key: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        size = end - begin
        n = -(-size // 8)
        self.slot = np.concatenate([self.slot, len(self.doc) + np.arange(len(key))])
        self.key = np.concatenate([self.key, key])
        order = np.argsort(self.key)
        self.key, self.slot = self.key[order], self.slot[order]
        self.at = np.concatenate([self.at, len(self.words) + np.cumsum(n) - n])
        self.doc, self.size = np.concatenate([self.doc, doc]), np.concatenate([self.size, size])
        data = b"".join([text[x:y].ljust(8 * k, b"\0") for x, y, k in zip(begin.tolist(), end.tolist(), n.tolist(), strict=True)])
        self.words = np.concatenate([self.words, np.frombuffer(data, "<u8")])

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether hashes are known, and where."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, self.slot[at]

    def repeated(self, text: bytes, key: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, within: bool) -> np.ndarray:
        """Windows that are equal, byte for byte, to one met before. Where only
        another document's copy decides (not ``within``), all copies in the
        first document count as not met."""
        known, slot = self._find(key)
        new, first = np.unique(key[~known], return_index=True)
        first = np.flatnonzero(~known)[first]
        if len(new) > self.most - len(self.doc):
            met = np.sort(np.argsort(first)[: self.most - len(self.doc)])
            new, first = new[met], first[met]
        if len(new):
            self._keep(text, new, doc[first], begin[first], end[first])
            known, slot = self._find(key)
        known[first] = False
        own = np.flatnonzero(known)
        slot, size = slot[own], (end - begin)[own]
        same = size == self.size[slot]
        if not within:
            same &= self.doc[slot] != doc[own]
        own, slot, size = own[same], slot[same], size[same]
        data = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,)).copy()
        same, open_, k = np.ones(len(own), bool), np.arange(len(own)), 0
        while len(open_):  # eight bytes of all at a time
            left = np.minimum(size[open_] - 8 * k, 8).astype(np.uint64)
            mask = ~U(0) >> (U(64) - U(8) * left)
            same[open_] = (data[begin[own[open_]] + 8 * k] & mask) == self.words[self.at[slot[open_]] + k]
            k += 1
            open_ = open_[same[open_] & (size[open_] > 8 * k)]
        return own[same]


def _stretch_task(units: Units, shards: int):
    """Kind 0: stretches (key, doc, first window, windows, size, bytes).
    Kind 1: windows known to recur earlier in this task (doc, start)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: list[tuple[np.ndarray, ...]] = []
        blobs: list[bytes] = []
        size, firsts = 0, _Firsts()

        def flush():
            nonlocal arrays, blobs, size
            if arrays:
                key, doc, start, windows, n = (np.concatenate(x) for x in zip(*arrays, strict=True))
                shard = ((key >> U(20)) % U(shards)).astype(np.int32)
                yield from _by_shard(shard, 0, [key, doc, start, windows, n], blobs)
            arrays, blobs, size = [], [], 0

        for batch in distinct_docs(batches):
            ids, marks = batch.column(0).to_numpy(), batch.column(2)
            if marks.null_count == len(marks):
                continue
            keep = marks.is_valid()
            batch = batch.filter(keep)
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for block in text_blocks(batch.column(1)):
                bounds = units.bounds(block)
                own = [marks[block.first + i] for i in range(len(block))]
                doc = np.repeat(np.arange(len(own)), [len(x) // 8 for x in own])
                flat = np.frombuffer(b"".join(own), "<i8")
                place, reach, flagged = flat >> 16, flat & 0xFFFF, flat < 0
                at = np.where(flagged, -1 - place, place) + bounds[doc]
                order = np.argsort(at)
                doc, at, reach, flagged = doc[order], at[order], reach[order], flagged[order]
                lo = at - (reach >> 8)
                hi = lo + (reach & 255) - 1
                text, u0, u1 = window_bytes(units, block)
                for hot in (False, True):
                    sel = np.flatnonzero(flagged == hot)
                    if not len(sel):
                        continue
                    d, a, b = doc[sel], lo[sel], hi[sel]
                    key = None if hot else _window_hash(text, u0[at[sel]], u1[at[sel] + units.gram - 1])
                    if hot:  # every window alone, by its own hash
                        n = b - a + 1
                        d = np.repeat(d, n)
                        a = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                        b = a
                        key = _window_hash(text, u0[a], u1[a + units.length - 1])
                        # documents come in order of id, windows in order of place
                        g = firsts.repeated(text, key, ids[block.first + d], u0[a], u1[a + units.length - 1], units.within)
                        if len(g):
                            who = ids[block.first + d[g]]
                            yield from _by_shard(_doc_shard(who, shards), 1, [who, (a[g] - bounds[d[g]]).astype("<i4")])
                        fresh = np.ones(len(a), bool)
                        fresh[g] = False
                        d, a, b, key = d[fresh], a[fresh], b[fresh], key[fresh]
                    begin, end = u0[a], u1[b + units.length - 1]
                    arrays.append((key, ids[block.first + d], (a - bounds[d]).astype("<i4"), (b - a + 1).astype("<i4"), (end - begin).astype("<i4")))
                    blobs += [text[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                    size += int((end - begin).sum()) + 28 * len(a)
                if size >= _FLUSH_BYTES:
                    yield from flush()
        yield from flush()

    return rows


def _window_hash(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    from .common import span_hash

    return span_hash(np.frombuffer(text, np.uint8), begin, end)


@dataclass
class Stretches:
    """What one task of step 4 decides on, ordered by key, document and place."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    text: list[bytes]


def _decide_task(decide: Callable[[Stretches], tuple[np.ndarray, np.ndarray]], shards: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, kind, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "n", "data")), strict=True):
                if kind == 1:
                    (doc, start), _, _ = _unpack(n, data, ["<i8", "<i4"])
                    yield from _span_rows(doc, start.astype(np.int64), shards)
                else:
                    held.setdefault(shard, []).append((n, data))
        for shard in list(held):
            found = decide(_unpacked(held.pop(shard)))
            yield from _span_rows(*found, shards)

    return rows


def _numbered(nulls: DataFrame, least: int) -> DataFrame:
    """Rows (__text, ...) without an id, with numbers just below ``least`` as
    __id, in order of text. Places in partitions are written once, so that no
    later reading numbers the rows in another way."""
    spread = nulls.withColumn("__place", F.monotonically_increasing_id())
    spread = spread.repartitionByRange("__text", "__place").sortWithinPartitions("__text", "__place")
    rows = materialise(spread.withColumn("__place", F.monotonically_increasing_id()), "null-ids")
    part = F.shiftright("__place", 33)  # a place is the partition and the row in it
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())
    at = least - sum(n for _, n in counts)
    if at < -(1 << 63):
        raise ValueError("no numbers are left below the smallest id for the rows without one")
    first = []
    for p, n in counts:
        first.append((p, at))
        at += n
    first = nulls.sparkSession.createDataFrame(first, "__part long, __first long")
    rows = rows.join(F.broadcast(first), part == F.col("__part"))
    return rows.withColumn("__id", F.col("__first") + F.col("__place").bitwiseAND((1 << 33) - 1))


def _unpacked(held: list[tuple[int, bytes]]) -> Stretches:
    """The stretches of some packed rows."""
    arrays, text = [], []
    for n, data in held:
        cols, data, at = _unpack(n, data, ["<u8", "<i8", "<i4", "<i4", "<i4"])
        ends = at + np.cumsum(cols[4], dtype=np.int64)
        text += [data[x:y] for x, y in zip((ends - cols[4]).tolist(), ends.tolist(), strict=True)]
        arrays.append(cols[:4])
    key, doc, start, windows = (np.concatenate(x) for x in zip(*arrays, strict=True))
    order = np.lexsort((start, doc, key))
    return Stretches(key[order], doc[order], start[order], windows[order], [text[i] for i in order.tolist()])


@dataclass
class Passages:
    """Runs of windows that recur, each as it stands in one document, with the
    place where its first window starts first of all."""

    doc: np.ndarray
    first_doc: np.ndarray
    first_start: np.ndarray
    windows: np.ndarray
    text: list[bytes]


_PASSAGE = ["<i8", "<i8", "<i4", "<i4", "<i4"]


def _confirm_task(confirm: Callable[[Stretches], Passages], shards: int):
    """Kind 0: passages by their documents' shards. Kind 1: spans, as from
    ``_decide_task``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, kind, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "n", "data")), strict=True):
                if kind == 1:
                    (doc, start), _, _ = _unpack(n, data, ["<i8", "<i4"])
                    for b in _span_rows(doc, start.astype(np.int64), shards):
                        yield b.set_column(1, "kind", pa.array([1] * b.num_rows, pa.int32()))
                else:
                    held.setdefault(shard, []).append((n, data))
        for shard in list(held):
            p = confirm(_unpacked(held.pop(shard)))
            if len(p.doc):
                size = np.fromiter(map(len, p.text), np.int64, len(p.text))
                yield from _by_shard(_doc_shard(p.doc, shards), 0, [p.doc, p.first_doc, p.first_start.astype("<i4"), p.windows.astype("<i4"), size.astype("<i4")], p.text)

    return rows


_FOUND = "m_id long, spans binary, passages binary"


def _collect_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document with its spans and its packed passages."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for shard, kind, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "n", "data")), strict=True):
            held.setdefault(shard, ([], []))[kind].append((n, data))
    for shard in list(held):
        passages, spans = held.pop(shard)
        by_doc: dict[int, list[bytes]] = {}
        for n, data in spans:
            (doc, first, more), _, _ = _unpack(n, data, ["<i8", "<i4", "<i4"])
            for b in _per_doc(doc, first.astype(np.uint64) << U(32) | more.astype(np.uint64), "spans"):
                for d, x in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
                    by_doc.setdefault(d, [b"", b""])[0] += x
        for n, data in passages:
            cols, data, at = _unpack(n, data, _PASSAGE)
            order = np.argsort(cols[0], kind="stable")
            begin = at + np.cumsum(cols[4], dtype=np.int64) - cols[4]
            doc = cols[0][order]
            cut = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
            for a, b in zip(cut, cut[1:]):
                own = order[a:b]
                head = b"".join(c[own].tobytes() for c in cols[1:])
                blob = b"".join([data[x : x + y] for x, y in zip(begin[own].tolist(), cols[4][own].tolist(), strict=True)])
                by_doc.setdefault(int(doc[a]), [b"", b""])[1] += len(own).to_bytes(4, "little") + head + blob
        ids = list(by_doc)
        for i in range(0, len(ids), 1000):
            part = ids[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *[pa.array([by_doc[d][k] or None for d in part], pa.binary()) for k in (0, 1)]], ["m_id", "spans", "passages"])


def read_passages(packed: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """first_doc, first_start, windows and texts of a document's passages."""
    at = 0
    while at < len(packed):
        n = int.from_bytes(packed[at : at + 4], "little")
        at += 4
        cols = []
        for t in _PASSAGE[1:]:
            cols.append(np.frombuffer(packed, t, n, at))
            at += cols[-1].nbytes
        ends = (at + np.cumsum(cols[3], dtype=np.int64)).tolist()
        yield cols[0], cols[1].astype(np.int64), cols[2].astype(np.int64), [packed[x:y] for x, y in zip([at, *ends], ends)]
        at = ends[-1]


def _stretched(docs: DataFrame, units: Units, id_col: str, text_col: str, keep_columns: bool) -> tuple[DataFrame, DataFrame, int, int | None]:
    """Steps 1 to 3: rows by id, packed stretches by shard, the number of
    shards, and the least id that is not a number given to a null."""
    n = partitions(docs.sparkSession)
    shards = max(n, min(4 * n, 256))  # few partitions take several shards each, for balance
    d = F.col(f"`{id_col}`").cast("long").alias("__id")
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__rest")] if keep_columns else []
    rows = docs.select(d, F.col(f"`{text_col}`").alias("__text"), *rest)
    least, nulls = None, rows.where("__id IS NULL")
    if nulls.limit(1).count():
        least = rows.agg(F.coalesce(F.min("__id"), F.lit(0))).first()[0]
        rows = rows.where("__id IS NOT NULL").union(_numbered(nulls.drop("__id"), least).select(*rows.columns))
    rows = rows.repartition("__id").sortWithinPartitions("__id", "__text")
    slim = rows.select("__id", "__text")
    anchor = map_arrow(slim, _anchor_task(units, shards, LOCAL_HOT), _PACK, bound=False).repartition("shard")
    marks = map_arrow(map_arrow(anchor, _mark_task(units.within, HOT, shards), _PACK, bound=False).repartition("shard"), _gather_task("marks", False), "m_id long, marks binary", bound=False)
    stretch = slim.join(marks, F.col("__id") == F.col("m_id"), "left").sortWithinPartitions("__id", "__text").select("__id", "__text", "marks")
    return rows, map_arrow(stretch, _stretch_task(units, shards), _PACK, bound=False).repartition("shard"), shards, least


def _applied(rows: DataFrame, found: DataFrame, columns: list[str], apply, schema, least: int | None, keep_columns: bool) -> DataFrame:
    out = rows.join(found, F.col("__id") == F.col("m_id"), "left").sortWithinPartitions("__id", "__text")
    out = map_arrow(out.select("__id", "__text", *["__rest"] * keep_columns, *columns), apply, schema, bound=False)
    if least is not None and not keep_columns:
        out = out.withColumn("doc_id", F.when(F.col("doc_id") >= least, F.col("doc_id")))
    return out


def repeated_passages(docs: DataFrame, units: Units, confirm, apply, schema, id_col: str, text_col: str, keep_columns: bool = False) -> DataFrame:
    """Every document goes through ``apply``, in batches (doc_id, text, rest,
    spans, passages): spans are windows to remove that step 3 knows, passages
    what ``confirm`` found to recur in the document."""
    rows, stretch, shards, least = _stretched(docs, units, id_col, text_col, keep_columns)
    found = map_arrow(map_arrow(stretch, _confirm_task(confirm, shards), _PACK, bound=False).repartition("shard"), _collect_task, _FOUND, bound=False)
    return _applied(rows, found, ["spans", "passages"], apply, schema, least, keep_columns)


def repeated_spans(docs: DataFrame, units: Units, decide, apply, schema, id_col: str, text_col: str, keep_columns: bool = False) -> DataFrame:
    """Runs the five steps; ``apply`` maps batches (doc_id, text, rest, spans)
    to rows of ``schema``, where spans are the window starts to remove."""
    rows, stretch, shards, least = _stretched(docs, units, id_col, text_col, keep_columns)
    spans = map_arrow(map_arrow(stretch, _decide_task(decide, shards), _PACK, bound=False).repartition("shard"), _gather_task("spans", True), "m_id long, spans binary", bound=False)
    return _applied(rows, spans, ["spans"], apply, schema, least, keep_columns)
