"""Substring dedup by repeated-phrase automata.

A window is 20 consecutive words.

1. Stretches of text that may hold recurring windows are brought together by
   shard (``passages``). A shard confirms, byte for byte, which windows occur
   more than once, and where each starts first; runs of them are passages.
2. A passage goes, as text and without a place, to every document that holds
   it. Documents are taken in blocks of about a megabyte; the passages of a
   block are compiled into Aho-Corasick automata of ``AUTOMATON_WORDS`` words,
   and all documents of the block, whether they have passages or not, are
   streamed through to locate every occurrence.
3. The first occurrence, in order of doc_id and place, stays; every word that
   another one covers is removed.

A word is a number in an automaton, written as three characters, as the
children of a trie's node are searched one by one.

So the automata are sharded by documents, each document is streamed as often
as its block has automata (one, but for blocks full of repeats), and an
automaton holds what can occur in its documents.

Defined cases: see ``passages``; a text under 20 words loses nothing; the
digest joins kept words by one space; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBlock, gram_hash, text_blocks
from .passages import Passages, Stretches, Units, covered, distinct_docs, read_passages, repeated_passages, window_bytes

WINDOW = 20
UNITS = Units("words", WINDOW, 6, True)
#: Words of one automaton's passages.
AUTOMATON_WORDS = 200_000
#: Automata that a block of documents is streamed through at most; a single
#: text of very many repeats has larger ones instead.
MOST_AUTOMATA = 16


def _block(texts: list[bytes]) -> TextBlock:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    block = TextBlock(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)]), 0)
    block.words()
    return block


def confirm(s: Stretches) -> Passages:
    """Passages of windows that recur among the stretches."""
    block = _block(s.text)
    n_words = np.diff(block.w_bounds)
    assert (n_words == s.windows + WINDOW - 1).all()
    h = gram_hash(block.word_hash(), WINDOW)
    which = np.repeat(np.arange(len(s.text)), s.windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(s.windows) - s.windows, s.windows)
    word = block.w_bounds[which] + offset
    doc, start = s.doc[which], s.start[which].astype(np.int64) + offset
    h = h[word]
    order = np.lexsort((start, doc, h))
    new = np.ones(len(order), bool)
    new[1:] = np.diff(h[order]) != 0
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
    first = _equal(s, block, which, word, first)
    many = np.bincount(first, minlength=len(first))[first] > 1
    # runs of windows whose first places run along with them
    go_on = np.zeros(len(first), bool)
    go_on[1:] = many[1:] & many[:-1] & (which[1:] == which[:-1]) & (first[1:] == first[:-1] + 1) & (which[first[1:]] == which[first[:-1]])
    begin = np.flatnonzero(many & ~go_on)
    count = np.diff(np.append(np.cumsum(many)[begin] - 1, many.sum()))
    a, b = block.w_start[word[begin]], block.w_end[word[begin] + count + WINDOW - 2]
    raw = block.data.tobytes()
    return Passages(doc[begin], doc[first[begin]], start[first[begin]], count, [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])


def _equal(s: Stretches, block: TextBlock, which: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``first`` after a comparison of texts: hashes alone may agree by chance."""
    raw, own = block.data.tobytes(), np.arange(len(first))
    go_on = np.zeros(len(first), bool)
    go_on[1:] = (which[1:] == which[:-1]) & (first[1:] == first[:-1] + 1) & (which[first[1:]] == which[first[:-1]])
    begin = np.flatnonzero(~go_on)
    last = np.append(begin[1:], len(first)) - 1
    pairs = zip(*(x.tolist() for x in (block.w_start[word[begin]], block.w_end[word[last] + WINDOW - 1], block.w_start[word[first[begin]]], block.w_end[word[first[last]] + WINDOW - 1])), strict=True)
    if all(raw[a:b] == raw[c:d] for a, b, c, d in pairs):
        return first
    texts: dict[bytes, int] = {}
    order = np.lexsort((s.start[which].astype(np.int64) + word - block.w_bounds[which], s.doc[which]))
    out = own.copy()
    for i in order.tolist():
        out[i] = texts.setdefault(raw[block.w_start[word[i]] : block.w_end[word[i] + WINDOW - 1]], i)
    return out


_BASE = 128


def _letters(numbers: np.ndarray) -> str:
    """Word numbers as three characters each, of one range for each digit, so
    that words match as wholes."""
    digits = np.stack([numbers // (_BASE * _BASE) + 0x100, numbers // _BASE % _BASE + 0x10000, numbers % _BASE + 0x20000], 1)
    return digits.astype("<u4").tobytes().decode("utf-32-le")


def locate(block: TextBlock, ids: np.ndarray, packed: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and words of all passages in a block of documents that
    start earlier elsewhere, found by automata of the documents' passages."""
    import ahocorasick

    known: dict[bytes, tuple[int, int]] = {}
    for p in packed:
        for first_doc, first_start, _, texts in read_passages(p or b""):
            for t, *place in zip(texts, first_doc.tolist(), first_start.tolist(), strict=True):
                known.setdefault(t, tuple(place))
    out = [np.zeros((0, 3), np.int64)]
    texts, place = list(known), np.array(list(known.values()), np.int64).reshape(-1, 2)
    size = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    limit, i = max(AUTOMATON_WORDS, int(size.sum()) // MOST_AUTOMATA), 0
    if texts:
        hashes = block.word_hash()
        normal, u0, u1 = window_bytes(UNITS, block)
        # one word that no passage has stands after each document
        between = block.w_bounds[1:]
        word = np.insert(np.arange(len(hashes)), between, -1)
        owner = np.repeat(np.arange(len(block)), np.diff(block.w_bounds))
    while i < len(texts):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), limit, "right")))
        own = _block(texts[i:j])
        words, numbers = np.unique(own.word_hash(), return_inverse=True)
        if len(words) >= 0xD700 * _BASE * _BASE:
            raise ValueError("an automaton has too many words")
        phrases = _letters(numbers + 1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        bounds = (3 * own.w_bounds).tolist()
        for k in range(j - i):
            automaton.add_word(phrases[bounds[k] : bounds[k + 1]], k)
        automaton.make_automaton()
        near = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        line = np.insert(np.where(words[near] == hashes, near + 1, 0), between, 0)
        hits = np.array(list(automaton.iter(_letters(line))), np.int64).reshape(-1, 2)
        n = size[hits[:, 1] + i]
        start = word[(hits[:, 0] + 1) // 3 - n]
        a, b = u0[start].tolist(), u1[start + n - 1].tolist()  # hashes alone may agree by chance
        same = np.array([normal[x:y] == texts[i + k] for x, y, k in zip(a, b, hits[:, 1].tolist(), strict=True)], bool)
        text = owner[start]
        local = start - block.w_bounds[text]
        q = hits[:, 1] + i
        late = same & ((ids[text] != place[q, 0]) | (local != place[q, 1]))
        out.append(np.stack([text, local, n], 1)[late])
        i = j
    return tuple(np.concatenate(out).T)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[TextBlock, dict[int, np.ndarray]]]:
    """Blocks of texts with the words that go, for texts that lose some."""
    ids, spans, packed = batch.column(0).to_numpy(), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    for block in text_blocks(batch.column(1)):
        block.words()
        here = slice(block.first, block.first + len(block))
        text, start, n = locate(block, ids[here], packed.slice(block.first, len(block)).to_pylist())
        gone: dict[int, np.ndarray] = {}
        for i, runs in enumerate(spans.slice(block.first, len(block)).to_pylist()):
            if runs:
                gone[i] = covered(int(block.w_bounds[i + 1] - block.w_bounds[i]), runs, WINDOW)
        if len(text):
            step = np.zeros(len(block.w_start) + 1, np.int32)
            at = block.w_bounds[text] + start
            np.add.at(step, at, 1)
            np.add.at(step, at + n, -1)
            hit = np.cumsum(step)[:-1] > 0
            for i in np.unique(text).tolist():
                own = hit[block.w_bounds[i] : block.w_bounds[i + 1]]
                gone[i] = own | gone[i] if i in gone else own
        yield block, gone


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bytes]]]]:
    for batch in distinct_docs(batches):
        out: list[tuple[int, int, bytes]] = []
        for block, gone in _blocks(batch):
            for i in range(len(block)):
                a, b = block.w_bounds[i], block.w_bounds[i + 1]
                words = block.text(i).split()
                if len(words) != b - a:  # another ASCII separator than split()'s: none today
                    words = [block.data[x:y].tobytes() for x, y in zip(block.w_start[a:b], block.w_end[a:b], strict=True)]
                hit = gone.get(i)
                if hit is not None:
                    words = [w for w, h in zip(words, hit.tolist(), strict=True) if not h]
                out.append((int(b - a), 0 if hit is None else int(hit.sum()), b" ".join(words)))
        yield batch, out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, out in _cleaned(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in distinct_docs(batches):
        clean = batch.column(1).to_pylist()
        for block, gone in _blocks(batch):
            for i, hit in gone.items():
                clean[block.first + i] = _without(block, i, hit).decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(clean, pa.string())], ["__rest", "__clean"])


def _without(block: TextBlock, i: int, hit: np.ndarray) -> bytes:
    """Text i without the bytes from the first to the last word of each run of
    covered words; all other bytes stay."""
    a = block.w_bounds[i]
    step = np.diff(hit.astype(np.int8), prepend=0, append=0)
    begin, end = block.w_start[a + np.flatnonzero(step == 1)], block.w_end[a + np.flatnonzero(step == -1) - 1]
    keep = zip([block.bounds[i], *end], [*begin, block.bounds[i + 1]], strict=True)
    return b"".join(block.data[x:y].tobytes() for x, y in keep)


def phrase_digest(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return repeated_passages(docs, UNITS, confirm, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", id_col, text_col)


def without_repeated_phrases(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with repeated passages cut from the texts that lost some words,
    from the first to the last word of each; all else is left as it was."""
    rest = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    schema = T.StructType([T.StructField("__rest", rest), T.StructField("__clean", T.StringType())])
    out = repeated_passages(docs, UNITS, confirm, _texts, schema, id_col, text_col, keep_columns=True)
    return out.select(*[F.col("__clean").alias(c) if c == text_col else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])


def op7_phrase_automata(spark, sf_dir: str) -> DataFrame:
    return phrase_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT u.doc_id, count(*) FILTER (WHERE x.p IS NOT NULL) AS gone, string_agg(u.word, ' ' ORDER BY u.p) FILTER (WHERE x.p IS NULL) AS kept
  FROM u LEFT JOIN x ON x.doc_id = u.doc_id AND x.p = u.p GROUP BY u.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(k.gone, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
