"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: lower-cased words and word
beginnings of 4 and 6 bytes, in 2**18 buckets. The machine

    y = w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)

learns a weight for every term and factors whose products weigh pairs of
terms, so a pair can count for more than its two terms do. ``x_i`` is
``1 / sqrt(log2(2 + terms))`` for every learned term present: many terms are
damped a little, but one insult in a long text still counts.

Fitted on at most ``SAMPLE_DOCS`` labelled documents (a documented bound;
only hashed terms reach the driver). A term has a weight and factors if its
presence depends on the label (chi-squared of ``MIN_CHI2`` or more), or if a
pair that it is in does: among the ``PAIR_TERMS`` terms that most toxic rows
hold, either term of such a pair must tell the label once the other one is
there (``PAIR_CHI2``), so neither needs to tell anything alone. All others
have weight and factors 0. Scoring streams all texts once.

Defined cases: a null or empty text has no terms and scores the bias; without
labels of both kinds all scores are 0; repeated rows score alike; extra
columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, span_hash, text_blocks
from .learned import append_score, held_out, sigmoid, training_rows

BUCKETS, FACTORS, EPOCHS, SEED = 1 << 18, 4, 10, 3
SAMPLE_DOCS, MIN_DOCS, MIN_CHI2 = 16_000, 3, 11.0
PAIR_TERMS, PAIR_DOCS, PAIR_CHI2 = 2048, 8, 30.0
_BEGINNINGS = (4, 6)


def terms(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of all texts of a block, and their bounds."""
    block.words(lower=True)
    n_words = np.diff(block.w_bounds)
    doc = np.repeat(np.arange(len(n_words)), n_words).astype(np.uint64)
    size = block.w_end - block.w_start
    hashed = [block.word_hash()]
    docs = [doc]
    for k in _BEGINNINGS:
        long = size >= k
        start = block.w_start[long]
        hashed.append(span_hash(block.data, start, start + k) + np.uint64(k))
        docs.append(doc[long])
    key = np.unique(np.concatenate(docs) << np.uint64(20) | np.concatenate(hashed) % np.uint64(BUCKETS))
    return (key & np.uint64((1 << 20) - 1)).astype(np.int64), np.searchsorted(key >> np.uint64(20), np.arange(len(n_words) + 1, dtype=np.uint64))


def _sums(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds; empty ranges give 0."""
    total = np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _forward(model: dict, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    used = model["used"][ids]
    kept = np.concatenate([[0], np.cumsum(used)])
    ids, bounds = ids[used], kept[bounds]
    x = 1 / np.sqrt(np.log2(2 + np.diff(bounds)))
    v = model["v"][ids].astype(np.float64)
    s = _sums(v, bounds) * x[:, None]
    pairs = 0.5 * ((s**2) - _sums(v**2, bounds) * x[:, None] ** 2).sum(1)
    return model["w0"] + _sums(model["w"][ids].astype(np.float64), bounds) * x + pairs, s, v, x


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for block in text_blocks(batch.column(0)):
            ids, bounds = terms(block)
            raw = ids.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.array(labels[block.first : block.first + len(block)])], ["x", "label"])


def _telling(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose presence depends on the label."""
    ids, label = np.concatenate(sets), np.repeat(y, [len(s) for s in sets])
    df = np.bincount(ids, minlength=BUCKETS).astype(np.float64)
    a = np.bincount(ids, label, BUCKETS)
    return (df >= MIN_DOCS) & (_chi2(df, a, len(y), y.sum()) >= MIN_CHI2)


def _chi2(df, a, n, pos):
    """Of n rows, ``pos`` of them toxic, df hold a term, a of those toxic."""
    share = pos / np.maximum(n, 1)
    gap = np.maximum(0, np.abs(a - df * share) - 0.5)
    return gap**2 / np.maximum(1e-9, df * (1 - df / np.maximum(n, 1)) * share * (1 - share))


def _telling_in_pairs(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets that tell the label together with another one."""
    out = np.zeros(BUCKETS, bool)
    toxic = np.flatnonzero(y > 0.5)
    held = np.bincount(np.concatenate([sets[i] for i in toxic]), minlength=BUCKETS)
    few = np.argsort(-held, kind="stable")[:PAIR_TERMS]
    few = np.sort(few[held[few] >= PAIR_DOCS])
    place = np.full(BUCKETS, -1)
    place[few] = np.arange(len(few))
    x = np.zeros((len(y), len(few)), bool)
    for i, s in enumerate(sets):
        at = place[s]
        x[i, at[at >= 0]] = True
    in_toxic = x[toxic].astype(np.float32)
    both = in_toxic.T @ in_toxic
    alone = np.diag(both)
    i, j = np.nonzero(np.triu((both >= PAIR_DOCS) & (both * len(toxic) > 1.25 * alone[:, None] * alone[None, :]), 1))
    df, bits = x.sum(0), np.packbits(x, axis=0).T.copy()
    for p in range(0, len(i), 4096):
        a, b = i[p : p + 4096], j[p : p + 4096]
        n = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
        tells = np.minimum(_chi2(n, both[a, b], df[a], alone[a]), _chi2(n, both[a, b], df[b], alone[b])) >= PAIR_CHI2
        out[few[a[tells]]] = out[few[b[tells]]] = True
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col="toxic", modulus: int = 4, remainder: int = 2, sample_docs: int = SAMPLE_DOCS, id_col="doc_id", text_col="text") -> dict | None:
    """The machine, or None without labels of both kinds."""
    got = training_rows(docs, labels, label_col, modulus, remainder, sample_docs, id_col, text_col).mapInArrow(_rows, "x binary, label double").toArrow()
    y = got.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    sets = [np.frombuffer(b, np.int32) for b in got.column("x").to_pylist()]
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), y[i], sets[i].tobytes()))  # however tasks end
    return train([sets[i] for i in order], y[order])


def train(sets: list[np.ndarray], y: np.ndarray) -> dict:
    """The machine from term sets and labels of both kinds."""
    often = _telling(sets, y) | _telling_in_pairs(sets, y)
    sets = [s[often[s]].astype(np.int64) for s in sets]
    rng = np.random.default_rng(SEED)
    model = {"w0": 0.0, "used": often, "w": np.zeros(BUCKETS, np.float32), "v": (0.01 * rng.standard_normal((BUCKETS, FACTORS)) * often[:, None]).astype(np.float32)}
    model["w0"] = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv = np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, FACTORS), 1e-6, np.float32)
    weight = np.where(y > 0.5, min(4.0, ((1 - y.mean()) / y.mean()) ** 0.5), 1.0)
    for _ in range(max(EPOCHS, 40_000 // len(y))):  # few rows are seen more often
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            ids = np.concatenate([sets[i] for i in batch])
            bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in batch])])
            out, s, v, x = _forward(model, ids, bounds)
            d = (sigmoid(out) - y[batch]) * weight[batch]
            model["w0"] -= 0.02 * float(d.mean())
            own = np.repeat(np.arange(len(batch)), np.diff(bounds))
            dx = (d * x)[own]
            used, at = np.unique(ids, return_inverse=True)
            g = np.bincount(at, dx, len(used)) + 2e-3 * model["w"][used]
            gw[used] += g**2
            model["w"][used] -= 0.05 * g / np.sqrt(gw[used])
            dv = dx[:, None] * (s[own] - v * x[own, None])
            g = np.stack([np.bincount(at, dv[:, f], len(used)) for f in range(FACTORS)], 1) + 3e-2 * model["v"][used]
            gv[used] += g**2
            model["v"][used] -= 0.02 * g / np.sqrt(gv[used])
    model["v"][~often] = 0
    return model


def scorer(model: dict | None):
    def score(column: pa.Array) -> np.ndarray:
        if model is None:
            return np.zeros(len(column))
        return np.concatenate([sigmoid(_forward(model, *terms(block))[0]) for block in text_blocks(column)])

    return score


def with_toxicity(docs: DataFrame, model, text_col="text", out_col="score") -> DataFrame:
    return append_score(docs, scorer(model), text_col, out_col)


def op6_factorization_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
