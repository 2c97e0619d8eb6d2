"""Near-duplicate documents by HyperMinHash sketches, bands and exact checks.

1. Every text becomes its set of hashed word shingles; the sketch keeps, for
   each of ``REGISTERS`` hash functions, the smallest hash compressed to its
   count of leading zeros and ``MANTISSA`` bits after the leading one.
2. Equal sets (by a 128-bit set hash and size) are one class, represented by
   its smallest doc_id, so exact copies cost one sketch.
3. Bands of four registers are keys. Every class is compared with the
   smallest class among its keys (stars, one pair a class): the registers give
   a collision-corrected Jaccard estimate, and what may reach the threshold is
   confirmed on the full sets. Links are joined to components, and a second
   round compares each class with the smallest one of another component.
4. In keys that still hold several components, classes outside of the key's
   largest component (strays) are compared with all classes of others. The
   largest one is dealt to blocks of ``BLOCK_ROWS`` and the strays go to each,
   so a key's rows at most double; only confirmed links that join components
   leave a task. A key of more strays than a block is taken apart first: by
   the rarest quarter of each class's shingles, of which two sets of
   similarity 0.75 always share one (prefix filtering), in place of the key.

At similarity 0.75 one band of four agrees with probability 0.32, so a pair
shares none of 32 bands with probability 5e-6. Estimates under ``FLOOR``
(more than six deviations below the threshold) are not confirmed.

Defined cases: a text without words (or null) has an empty set and is linked
with nothing; a null doc_id is linked with nothing and kept; rows that share
a doc_id are one document, its smallest text (null first), and one row of the
result; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U, TextBlock, doc_columns, gram_hash, map_arrow, materialise, mix64, text_blocks

SHINGLE, THRESHOLD = 5, 75
REGISTERS, ROWS_A_BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS_A_BAND
FLOOR = 0.5
BLOCK_ROWS = 1000
#: Strays and shingles of a run that are compared at once.
ROWS_AT_ONCE, STRIP = 256, 1024
#: Rounds of stars before components are compared pair by pair.
STARS = 2
#: Ids that a broadcast may hold (a few MB).
BROADCAST_IDS = 100_000
_SEEDS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64))
_FACTORS = mix64(_SEEDS) | U(1)
#: Chance that two different minima share a compressed register, about.
CHANCE = 2.0**-MANTISSA


def shingle_sets(block: TextBlock, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a block, sorted, and their bounds."""
    block.words(lower=True)
    h, bounds = block.word_hash(), block.w_bounds
    n = np.diff(bounds)
    grams = gram_hash(h, k)
    per = np.maximum(0, n - k + 1)
    doc = np.repeat(np.arange(len(n)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(bounds[:-1], per)
    x = grams[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([gram_hash(h[bounds[i] : bounds[i + 1]], int(n[i]))[0] + U(n[i]) for i in short], np.uint64)
        x, doc = np.concatenate([x, own]), np.concatenate([doc, short])
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[fresh], doc[fresh]
    return x, np.searchsorted(doc, np.arange(len(n) + 1))


def registers(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Compressed registers (sets x REGISTERS) of non-empty sets."""
    low = np.empty((len(starts), REGISTERS), np.uint64)
    for j in range(REGISTERS):
        low[:, j] = np.minimum.reduceat((x ^ _SEEDS[j]) * _FACTORS[j], starts)
    part, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    return (zeros << MANTISSA | np.minimum(((part - 0.5) * 2 ** (MANTISSA + 1)).astype(np.int64), 2**MANTISSA - 1)).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of rows of registers, corrected for chance agreement."""
    return np.maximum(0, ((a == b).mean(-1) - CHANCE) / (1 - CHANCE))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            x, bounds = shingle_sets(block)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            regs: list[bytes | None] = [None] * len(n)
            if len(full):
                starts = bounds[:-1][full]
                s1[full], s2[full] = np.add.reduceat(mix64(x), starts), np.add.reduceat(mix64(~x), starts)
                for i, r in zip(full.tolist(), registers(x, starts), strict=True):
                    regs[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(regs, pa.binary())], ["doc_id", "n", "s1", "s2", "regs"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix64(np.arange(BANDS, dtype=np.uint64) + U(77))
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)  # a band is 4 x 16 bits
            ids = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(mix64(keys ^ salt[None, :]).ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["key", "v"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            keep = pa.array(estimate(ra, rb) >= FLOOR)
            yield batch.select(["a", "b"]).filter(keep)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of (key, block) from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    columns = lambda t: np.stack([t.column(c).to_numpy() for c in ("key", "block")], 1)
    for batch in batches:
        if not batch.num_rows:
            continue
        group = columns(batch)
        if held and (columns(held[-1].slice(held[-1].num_rows - 1))[0] != group[0]).any():
            yield pa.Table.from_batches(held)
            held = []
        other = np.flatnonzero(np.any(group != group[-1], axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _runs(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, comp, stray, home) of each run with several components;
    two strays are compared where the first of them is at home."""
    key, block, comp, mine = (t.column(c).to_numpy() for c in ("key", "block", "comp", "mine"))
    stray = t.column("stray").to_numpy(zero_copy_only=False)
    cut = (np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
    for a, b in zip([0, *cut], [*cut, len(comp)]):
        if (comp[a:b] != comp[a]).any():
            yield a, b, comp[a:b], stray[a:b], mine[a:b] == block[a]


def _compared(i, j, comp: np.ndarray, stray: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Whether rows i and j (i a stray, before j if both are) are a pair here."""
    return (comp[i] != comp[j]) & (~stray[j] | home[i])


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a likely partner of another component in their run."""
    for t in _whole_runs(batches):
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keep = np.zeros(t.num_rows, bool)
        for a, b, comp, stray, home in _runs(t):
            row = np.arange(b - a)
            for i in np.flatnonzero(stray).tolist():
                other = row[_compared(i, row, comp, stray, home) & (~stray | (row > i))]
                other = other[estimate(regs[a + other], regs[a + i]) >= FLOOR]
                keep[a + other] = True
                keep[a + i] |= len(other) > 0
        yield from t.drop_columns(["regs"]).filter(pa.array(keep)).to_batches()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shingle of (v, comp, s)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = part.column("s").to_pylist()
            n = np.array([len(x) // 8 for x in sets])
            cols = [np.repeat(x, n) for x in (part.column("v").to_numpy(), part.column("comp").to_numpy(), n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sets), np.int64)), *map(pa.array, cols)], ["key", "v", "comp", "n"])


def _by_rare_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, v, comp): for each class the rarest of its n shingles, as many as
    leave fewer than a partner must share, with those that only it has left out."""
    rows = map_arrow(members.join(sets.hint("merge"), "v").select("v", "comp", "s"), _tokens, "key long, v long, comp long, n long")
    rows = materialise(rows, "shingles")
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    rank = F.row_number().over(W.partitionBy("v").orderBy("held", "key"))  # one class's shingles
    rows = rows.join(often.hint("merge"), "key").withColumn("rank", rank)
    return rows.where((F.col("rank") <= F.col("n") - F.expr(f"(n * {THRESHOLD} + 99) div 100") + 1) & (F.col("held") > 1)).select("key", "v", "comp")


def _open_keys(own: DataFrame) -> DataFrame:
    """Rows of keys with several components, with the largest of these, the
    number of classes outside of it, and of blocks."""
    per = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    keys = per.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("c"), F.max(F.struct("n", "comp")).alias("top")).where("comps > 1")
    keys = keys.select("key", F.col("top.comp").alias("largest"), (F.col("c") - F.col("top.n")).alias("strays"), F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks"))
    return own.join(keys.hint("merge"), "key")


def _in_blocks(own: DataFrame) -> DataFrame:
    """Rows (key, block, mine, v, comp, stray) of open keys."""
    own = own.withColumn("mine", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("stray", F.col("comp") != F.col("largest"))
    block = F.explode(F.when(F.col("stray"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine")))
    return own.select("key", block.alias("block"), "mine", "v", "comp", "stray")


def _intersections(sets: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of ``rows`` at a time, and the sizes of the intersections of these
    sets with all sets."""
    if len(sets) <= 8:
        out = np.zeros((len(rows), len(sets)), np.int64)
        for k, i in enumerate(rows.tolist()):
            for j, y in enumerate(sets):
                at = np.minimum(np.searchsorted(y, sets[i]), len(y) - 1)
                out[k, j] = (y[at] == sets[i]).sum()
        yield rows, out
        return
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    asked = np.zeros(len(sets), bool)
    asked[rows] = True
    both = np.zeros(len(n), bool)  # shingles of several sets, of rows among them
    both[col[asked[row]]] = True
    both &= n > 1
    row, col = row[both[col]], (np.cumsum(both) - 1)[col[both[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order].astype(np.int32), col[order].astype(np.int32)
    width = int(both.sum())
    for i in range(0, len(rows), ROWS_AT_ONCE):
        part = rows[i : i + ROWS_AT_ONCE]
        out = np.zeros((len(part), len(sets)), np.int64)
        for c in range(0, width, STRIP):  # 0/1 columns in strips; sums stay exact
            a, b = np.searchsorted(col, [c, c + STRIP])
            strip = np.zeros((len(sets), STRIP), np.float32)
            strip[row[a:b], col[a:b] - c] = 1
            out += (strip[part] @ strip.T).astype(np.int64)
        yield part, out


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links between components, a spanning set of each run's."""
    for t in _whole_runs(batches):
        v = t.column("v").to_numpy()
        links: list[tuple[int, int]] = []
        for a, b, comp, stray, home in _runs(t):
            sets = [np.frombuffer(x, np.uint64) for x in t.column("s").slice(a, b - a).to_pylist()]
            size, row = np.array([len(x) for x in sets]), np.arange(b - a)
            root = {c: c for c in comp.tolist()}

            def top(c: int, root=root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for part, inter in _intersections(sets, np.flatnonzero(stray)):
                i = part[:, None]
                fine = 100 * inter >= THRESHOLD * (size[i] + size - inter)
                fine &= _compared(i, row, comp, stray, home) & (~stray | (row > i))
                for k, j in zip(*np.nonzero(fine)):
                    ci, cj = top(int(comp[part[k]])), top(int(comp[j]))
                    if ci != cj:
                        root[max(ci, cj)] = min(ci, cj)
                        links.append((int(v[a + part[k]]), int(v[a + j])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            x, bounds = shingle_sets(block)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["v", "s"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for sa, sb in zip(batch.column("sa"), batch.column("sb"), strict=True):
            a, b = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
            both = np.searchsorted(b, a, "right") - np.searchsorted(b, a, "left")
            inter = int(both.sum())
            keep.append(100 * inter >= THRESHOLD * (len(a) + len(b) - inter))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(v, comp): the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Labels shrink to the smallest neighbour's and then to their label's own
    label; every round is written to the shared folder.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), name)
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), name)
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels["v"] == near["a"]).select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("v").alias("u"), F.col("comp").alias("jump"))
        step = low.join(up, F.col("comp") == F.col("u"), "left").select("v", "old", F.least("comp", F.coalesce("jump", "comp")).alias("comp"))
        step = materialise(step, name)
        labels = step.select("v", "comp")
        if not step.where("comp <> old").limit(1).count():
            return labels


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(v, s): full sets of the documents ``ids`` (v)."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    # a checked number of ids goes to every task; beyond it texts are shuffled
    ids = F.broadcast(ids) if few else ids.hint("merge")
    own = docs.join(ids, F.col("doc_id") == F.col("v"), "left_semi").select("doc_id", "text")
    return materialise(map_arrow(own, _sets, "v long, s binary"), "sets")


class _Confirmed:
    """Tests pairs (a, b) once each, and keeps the sets that it has made."""

    def __init__(self, docs: DataFrame, regs: DataFrame):
        self.docs, self.regs, self.tested, self.sets = docs, regs, None, None

    def sets_for(self, ids: DataFrame) -> DataFrame:
        if self.sets is None:
            self.sets = _sets_of(materialise(ids, "ids"), self.docs)
        else:
            new = materialise(ids.join(self.sets.select("v"), "v", "left_anti"), "ids")
            if new.limit(1).count():
                self.sets = self.sets.union(_sets_of(new, self.docs))
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame | None:
        pairs = pairs.join(self.tested, ["a", "b"], "left_anti") if self.tested is not None else pairs
        ra, rb = (self.regs.select(F.col("v").alias(x), F.col("regs").alias(f"r{x}")).hint("merge") for x in "ab")
        pairs = map_arrow(pairs.join(ra, "a").join(rb, "b").select("a", "b", "ra", "rb"), _likely, "a long, b long")
        pairs = materialise(pairs.distinct(), "pairs")
        if not pairs.limit(1).count():
            return None
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        self.sets_for(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct())
        sa, sb = (self.sets.select(F.col("v").alias(x), F.col("s").alias(f"s{x}")).hint("merge") for x in "ab")
        both = pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb")
        return materialise(map_arrow(both, _confirm, "a long, b long"), "links")


def one_text_an_id(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (doc_id, text, ...), of those that share a doc_id only one with the
    smallest text. Ids alone are looked at first, so texts move only if any
    id stands twice."""
    known = rows.where("doc_id IS NOT NULL")
    twice = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("twice"))
    if not twice.limit(1).count():
        return rows
    twice = materialise(twice, "twice").hint("merge")
    same = F.col("doc_id") == F.col("twice")
    first = known.join(twice, same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("text", *more), F.struct("text")).alias("row")).select("doc_id", "row.*")
    return rows.join(twice, same, "left_anti").union(first)


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = one_text_an_id(doc_columns(docs, id_col, text_col, "text"))
    sketch = materialise(map_arrow(rows, _sketches, "doc_id long, n long, s1 long, s2 long, regs binary"), "sketch")
    known = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(known.groupBy("n", "s1", "s2").agg(F.min_by("regs", "doc_id").alias("regs"), F.min("doc_id").alias("v")), "classes")
    bands = map_arrow(classes.select("v", "regs"), _bands, "key long, v long")
    regs = classes.select("v", "regs")
    often = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    shared = materialise(bands.join(often.hint("merge"), "key", "left_semi"), "bands")

    test = _Confirmed(rows, regs)
    links, labels = None, classes.select("v", F.col("v").alias("comp")).limit(0)
    own = shared.withColumn("comp", F.col("v"))
    for _ in range(STARS):
        # one pair for each document: the smallest centre of its keys that is
        # of another component
        star = own.groupBy("key").agg(F.min(F.struct("comp", "v")).alias("c"), F.max("comp").alias("hi")).where("c.comp <> hi")
        star = star.select("key", F.col("c.comp").alias("a_comp"), F.col("c.v").alias("a"))
        pairs = own.join(star.hint("merge"), "key").where("comp <> a_comp").groupBy("v").agg(F.min("a").alias("a"))
        new = test.links(pairs.select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")))
        if new is None:
            break
        links = new if links is None else links.union(new)
        labels = components(links)
        own = materialise(shared.join(labels.hint("merge"), "v", "left").select("key", "v", F.coalesce("comp", "v").alias("comp")), "own")

    # keys with several components left
    own = materialise(_open_keys(own), "open")
    dense = own.where(F.col("strays") > BLOCK_ROWS)
    blocks = _in_blocks(own.where(F.col("strays") <= BLOCK_ROWS))
    if dense.limit(1).count():
        members = materialise(dense.select("v", "comp").distinct(), "dense")
        blocks = blocks.union(_in_blocks(_open_keys(_by_rare_shingles(members, test.sets_for(members.select("v"))))))
    dealt = lambda df, *cols: df.repartition("key", "block").sortWithinPartitions("key", "block", "v").select("key", "block", "mine", "v", "comp", "stray", *cols)
    left = materialise(map_arrow(dealt(blocks.join(regs.hint("merge"), "v"), "regs"), _partners, "key long, block int, mine int, v long, comp long, stray boolean"), "left")
    if left.limit(1).count():
        sets = test.sets_for(left.select("v").distinct())
        new = materialise(map_arrow(dealt(left.join(sets.hint("merge"), "v"), "s"), _link_runs, "a long, b long"), "links")
        labels = components(new if links is None else links.union(new))

    comp = classes.join(labels, "v", "left").select("n", "s1", "s2", F.coalesce("comp", "v").alias("component"))
    # exact copies of one text meet in one key of this join; skew is split
    out = sketch.join(comp.where("n > 0"), ["n", "s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` of which one per group of near-duplicates is left;
    all rows without an id stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = one_text_an_id(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), whole), "row")
    known = rows.where("doc_id IS NOT NULL")
    kept = near_duplicates(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col).where("kept").select(F.col("doc_id").alias("kept_id"))
    left = known.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").union(rows.where("doc_id IS NULL"))
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_hyperminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(ws, i, i + 4)) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION SELECT doc_id, hash(ws) FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(v, l) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.v),
c AS (SELECT v, min(l) AS l FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.l AS component_id, d.doc_id = c.l AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.v = d.doc_id
"""
