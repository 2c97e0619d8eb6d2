"""Exact substring dedup with a run-length Burrows-Wheeler index.

A window is 50 consecutive UTF-8 bytes. Stretches that may hold recurring
windows meet in one shard (``passages``), grouped by anchor; equal windows are
in one group. Of every group some documents are indexed, and the stretches of
all larger documents are streamed:

* the index is the Burrows-Wheeler transform of the indexed stretches as runs,
  with suffix-array samples at both ends of every run and, for each run, the
  run and offset that its last-to-first mapping leads to;
* a text is streamed backwards for its matching statistics: the length of the
  longest prefix of what begins at each place that the index holds, as far as
  50. Where the run of the current row has the next byte, the row follows the
  mapping; elsewhere it jumps to the nearer run of that byte, up or down, that
  shares more with the match so far, which the samples tell;
* a statistic of 50 marks the window, as an indexed document is smaller.

First the smallest document of each group is indexed. What is left of the
others, windows that it does not hold, is halved by order of documents: the
smaller half is indexed and the larger half streamed, then each half is
treated alike. So a group of m documents takes log2(m) rounds at most, and a
text of many copies is indexed once; copies among the streamed texts pass
through the index once.

Defined cases: see ``passages``; a text under 50 bytes loses nothing;
repeats within one document stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_blocks
from .passages import Stretches, Units, covered, distinct_docs, repeated_spans

WINDOW = 50
UNITS = Units("bytes", WINDOW, 16, False)
#: Bytes of one index, and of what is streamed through it at once; groups of
#: more are taken alone.
INDEX_BYTES, STREAM_BYTES = 1 << 19, 1 << 21
#: Bytes of the first sort's keys.
_KEY = 7
_MASKS = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(_KEY + 1)], np.uint64)


def _words(data: np.ndarray, more: int = 0) -> np.ndarray:
    """The eight bytes from each place of data and ``more`` zeros after it."""
    padded = np.concatenate([data, np.zeros(more + 8, np.uint8)])
    return np.ndarray((len(data) + more,), "<u8", padded.data, strides=(1,)).copy()


def _keys(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first seven bytes of suffixes, zeros from their ends on, and how
    many those are: in order of suffixes, shorter ones first."""
    n = np.minimum(left, _KEY)
    return words.byteswap() & _MASKS[n] | n.astype(np.uint64)


def _suffix_array(keys: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each as far as the end of its text, which sorts
    before any byte; equal ones in order of place. ``left`` is the number of
    bytes before that end."""
    n = len(keys)
    sa = np.argsort(keys)
    # a suffix is ranked by the first place of those that agree with it so far
    slots, sub, h = np.arange(n), sa, _KEY
    part = keys[sa]
    rank = np.empty(n, np.int64)
    while True:
        new = np.ones(len(sub), bool)
        new[1:] = part[1:] != part[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(sub)))
        rank[sub] = np.repeat(slots[first], size)
        several = np.repeat(size > 1, size)
        slots, sub = slots[several], sub[several]
        ended = left[sub] < h  # equal to their ends
        if ended.any():
            equal = sub[ended]
            sa[slots[ended]] = equal[np.argsort(rank[equal] << 32 | equal)]
            slots, sub = slots[~ended], sub[~ended]
        if not len(sub):
            return sa
        part = rank[sub] << 32 | rank[sub + h]
        order = np.argsort(part)
        sub, part = sub[order], part[order]
        sa[slots] = sub
        h *= 2


@dataclass
class RunLengthIndex:
    words: np.ndarray  # the eight bytes from each place of all texts, a zero after each
    left: np.ndarray  # bytes from each place to the end of its text
    keys: np.ndarray  # the first bytes of all rows
    rows: np.ndarray  # places of all rows (for texts to begin with)
    run_char: np.ndarray  # byte + 1 of each run, 0 where texts begin
    run_len: np.ndarray
    run_start: np.ndarray
    sa_first: np.ndarray  # samples at the first and last row of every run
    sa_last: np.ndarray
    to_run: np.ndarray  # where the first row of a run maps to
    to_off: np.ndarray
    by_char: np.ndarray  # char << 32 | run, sorted

    @staticmethod
    def build(texts: list[bytes]) -> "RunLengthIndex":
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size + 1) - 1
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        left = np.repeat(ends, size + 1) - np.arange(len(data))
        words = _words(data, WINDOW + 8)
        keys = _keys(words[: len(data)], left)
        sa = _suffix_array(keys, left)
        sym = data.astype(np.int16) + 1
        sym[ends] = 0
        bwt = sym[sa - 1]  # before the first text is the end of the last
        start = np.concatenate([[0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1])
        length, char = np.diff(np.append(start, len(bwt))), bwt[start]
        by_char = np.sort(char.astype(np.int64) << 32 | np.arange(len(char)))
        by_run = by_char & 0xFFFFFFFF
        row = np.empty(len(char), np.int64)  # runs in order of char follow one another
        row[by_run] = np.cumsum(length[by_run]) - length[by_run]
        to_run = np.repeat(np.arange(len(char)), length)[row]
        return RunLengthIndex(words, left, keys[sa], sa, char, length, start, sa[start], sa[start + length - 1], to_run, row - start[to_run], by_char)

    def begin(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Whether the index holds the last seven bytes of texts, and a row of them."""
        tails = np.frombuffer(b"".join([t[-_KEY:].rjust(8, b"\0") for t in texts]), ">u8").astype(np.uint64)
        key = tails << np.uint64(8) | np.uint64(_KEY)
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[row] == key) & (np.fromiter(map(len, texts), np.int64, len(texts)) >= _KEY), row

    def common(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the texts at p and q share, up to ``most`` (at p there
        are as many)."""
        agree = lambda x: np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3  # noqa: E731 - equal bytes of eight
        out = agree(self.words[p] ^ self.words[q]).astype(np.int32)
        far = np.flatnonzero((out == 8) & (most > 8))
        if len(far):
            step = np.arange(8, most[far].max(), 8)
            more = agree(self.words[p[far, None] + step] ^ self.words[q[far, None] + step])
            first = np.argmin(more == 8, axis=1)  # 0 too if all agree
            last = more[np.arange(len(far)), first]
            out[far] += np.where(last == 8, 8 * len(step), 8 * first + last).astype(np.int32)
        return np.minimum(np.minimum(out, most), self.left[q])

    def _jump(self, c: np.ndarray, run: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of the next byte c for rows of another one (run, offset,
        place), and the length that is kept (-1: the index lacks c)."""
        m, c = len(c), c.astype(np.int64)
        at = np.searchsorted(self.by_char, c << 32 | run)
        entry = self.by_char[np.minimum(np.concatenate([np.maximum(at - 1, 0), at]), len(self.by_char) - 1)]
        there = entry >> 32 == np.concatenate([c, c])
        there[:m] &= at > 0
        there[m:] &= at < len(self.by_char)
        other = entry & 0xFFFFFFFF
        q = np.concatenate([self.sa_last[other[:m]], self.sa_first[other[m:]]])
        length = self.common(np.concatenate([p, p]), q, np.concatenate([n, n]))
        length[~there] = -1
        down = length[m:] > length[:m]
        pick = np.where(down, other[m:], other[:m])
        return pick, np.where(down, 0, self.run_len[pick] - 1), np.where(down, q[m:], q[:m]), np.maximum(length[:m], length[m:])

    def _step(self, c: np.ndarray, run: np.ndarray, off: np.ndarray, p: np.ndarray, n: np.ndarray, most: int) -> None:
        """One byte c before each text's place, in place."""
        bad, lost = np.flatnonzero(self.run_char[run] != c), ()
        if len(bad):
            run[bad], off[bad], p[bad], n[bad] = self._jump(c[bad], run[bad], p[bad], n[bad])
            lost = bad[n[bad] < 0]
        off += self.to_off[run]
        run[:] = self.to_run[run]
        over = np.flatnonzero(off >= self.run_len[run])
        if len(over):  # the row lies in a later run than the first one's
            at = self.run_start[run[over]] + off[over]
            run[over] = later = np.searchsorted(self.run_start, at, "right") - 1
            off[over] = at - self.run_start[later]
        p -= 1
        n += 1
        np.minimum(n, most, out=n)
        if len(lost):
            run[lost], off[lost], p[lost], n[lost] = 0, 0, self.sa_first[0], 0

    def statistics(self, texts: list[bytes], most: int = WINDOW, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of texts, up to ``most``: (text, place, length),
        backwards, for one place of every text that is long enough at a time.
        A text whose last seven bytes the index holds begins with those; one of
        which no further length can reach ``least`` may be left."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        which = np.argsort(-size, kind="stable")  # those not yet ended come first
        size, texts = size[which], [texts[i] for i in which.tolist()]
        width = int(size[0]) if len(size) else 0
        line = np.zeros((len(texts), width), np.uint8)  # aligned at their ends
        line[np.arange(width)[None, :] >= width - size[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
        line = np.ascontiguousarray(line[:, ::-1].T)
        run, off, n = (np.zeros(len(texts), np.int64) for _ in range(3))
        p = np.full(len(texts), self.sa_first[0])
        known, row = self.begin(texts)
        row = row[known]
        run[known] = first = np.searchsorted(self.run_start, row, "right") - 1
        off[known] = row - self.run_start[first]
        p[known], n[known] = self.rows[row], min(_KEY, most)
        slow = np.flatnonzero(~known)
        for back in range(min(_KEY, width)):
            slow = slow[size[slow] > back]
            if len(slow):
                own = [x[slow] for x in (run, off, p, n)]
                self._step(line[back, slow].astype(np.int16) + 1, *own, most)
                run[slow], off[slow], p[slow], n[slow] = own
                yield which[slow], size[slow] - 1 - back, own[3]
        yield which[known], size[known] - _KEY, n[known]
        lives = np.searchsorted(-size, -np.arange(width), "left")
        for back in range(_KEY, width):
            if least and back % 4 == 0:
                # a place adds one byte at most to the length at the place after it
                open_ = np.flatnonzero((size > back) & (n + size - back >= least))
                if len(open_) < 0.95 * len(n):
                    which, size, run, off, p, n = (x[open_] for x in (which, size, run, off, p, n))
                    line = line[:, open_]
                    lives = np.searchsorted(-size, -np.arange(width), "left")
            m = lives[back]
            if not m:
                return
            self._step(line[back, :m].astype(np.int16) + 1, run[:m], off[:m], p[:m], n[:m], most)
            yield which[:m], size[:m] - 1 - back, n[:m]

    def matches(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of all windows that the index holds."""
        which, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for text, place, length in self.statistics(texts, least=WINDOW):
            hit = length >= WINDOW
            which.append(text[hit])
            where.append(place[hit])
        return np.concatenate(which), np.concatenate(where)


def _streamed(index: RunLengthIndex, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Matches of all texts; those that are equal pass through the index once."""
    numbers: dict[bytes, int] = {}
    number = np.array([numbers.setdefault(t, len(numbers)) for t in texts], np.int64)
    which, where = index.matches(list(numbers))
    order = np.argsort(which, kind="stable")
    which, where = which[order], where[order]
    first = np.searchsorted(which, np.arange(len(numbers) + 1))
    n = np.diff(first)[number]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[number], n)
    return np.repeat(np.arange(len(texts)), n), where[at]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _mark(s: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of windows that a smaller document holds too."""
    docs_out, starts_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    group, doc, start, text = np.cumsum(_heads(s.key)), s.doc, s.start.astype(np.int64), np.array(s.text, object)
    first = True
    while True:
        # rows are in order of group, document and place
        head = _heads(group)
        rank = np.cumsum(_heads(group, doc))
        group = np.cumsum(head) - 1
        cut = np.flatnonzero(head)
        rank -= rank[cut][group] if len(cut) else 0
        docs = np.maximum.reduceat(rank, cut) + 1 if len(cut) else cut
        several = docs[group] > 1
        group, rank, doc, start, text = (x[several] for x in (group, rank, doc, start, text))
        if not len(group):
            return np.concatenate(docs_out), np.concatenate(starts_out)
        lower = rank == 0 if first else rank < (docs[group] + 1) // 2
        size = np.fromiter(map(len, text), np.int64, len(text)) + 1
        low, high = (np.concatenate([[0], np.cumsum(np.where(x, size, 0))]) for x in (lower, ~lower))
        cut = np.append(np.flatnonzero(_heads(group)), len(group))
        left: list[tuple] = [] if first else [(2 * group[lower], doc[lower], start[lower], text[lower])]
        x = 0
        while x < len(cut) - 1:
            a = cut[x]
            x = max(x + 1, min(int(np.searchsorted(low[cut], low[a] + INDEX_BYTES, "right")), int(np.searchsorted(high[cut], high[a] + STREAM_BYTES, "right"))) - 1)
            own = np.arange(a, cut[x])
            up = own[~lower[own]]
            streamed = text[up].tolist()
            which, where = _streamed(RunLengthIndex.build(text[own[lower[own]]].tolist()), streamed)
            docs_out.append(doc[up][which])
            starts_out.append(start[up][which] + where)
            # runs of windows that are left
            per = size[up] - WINDOW
            base = np.cumsum(per) - per
            stays = np.ones(int(per.sum()), bool)
            stays[base[which] + where] = False
            tag = np.repeat(np.arange(len(up)), per)
            new = stays & (_heads(tag) | np.concatenate([[True], ~stays[:-1]]))
            ends = stays & np.concatenate([_heads(tag)[1:] | ~stays[1:], [True]])
            begin, end = np.flatnonzero(new), np.flatnonzero(ends)
            if len(begin):
                i = tag[begin]
                begin, end = begin - base[i], end - base[i]
                rest = np.empty(len(i), object)
                rest[:] = [streamed[k][u : v + WINDOW] for k, u, v in zip(i.tolist(), begin.tolist(), end.tolist(), strict=True)]
                left.append((2 * group[up][i] + 1, doc[up][i], start[up][i] + begin, rest))
        if not left:
            group = group[:0]
            doc, start, text = doc[:0], start[:0], text[:0]
        else:
            group, doc, start, text = (np.concatenate(c) for c in zip(*left, strict=True))
            order = np.lexsort((start, doc, group))
            group, doc, start, text = group[order], doc[order], start[order], text[order]
        first = False


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    spans = batch.column(batch.num_columns - 1)
    for block in text_blocks(batch.column(1)):
        for i in range(len(block)):
            text, parts = block.text(i), spans[block.first + i].as_py()
            if not parts:
                yield len(text), 0, 0, text
                continue
            gone = covered(len(text), parts, WINDOW)
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            yield len(text), int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in distinct_docs(batches):
        cols = list(zip(*[(n, g, r, hashlib.sha256(k).hexdigest()) for n, g, r, k in _kept(batch)], strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in distinct_docs(batches):
        kept = [k.decode("utf-8", "ignore") for _, _, _, k in _kept(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(kept, pa.string())], ["__rest", "__clean"])


def run_length_digest(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return repeated_spans(docs, UNITS, _mark, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col)


def without_long_matches(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` without the bytes of windows that smaller documents hold
    (bytes of a character that was cut apart go with it)."""
    rest = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    schema = T.StructType([T.StructField("__rest", rest), T.StructField("__clean", T.StringType())])
    out = repeated_spans(docs, UNITS, _mark, _texts, schema, id_col, text_col, keep_columns=True)
    return out.select(*[F.col("__clean").alias(c) if c == text_col else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])


def op10_run_length_index(spark, sf_dir: str) -> DataFrame:
    return run_length_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS t FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS m FROM g) WHERE m < doc_id),
s AS (SELECT doc_id, i, CASE WHEN i <= coalesce(lag(i) OVER w + 50, -1) THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run, i FROM s),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY ALL),
k AS (SELECT u.doc_id, a, b, x, coalesce(lag(b) OVER (PARTITION BY u.doc_id ORDER BY a), 0) AS p FROM u JOIN d ON d.doc_id = u.doc_id),
o AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, d.x))) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""
