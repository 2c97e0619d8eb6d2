"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is
encoded from its bytes and words; gated attention weights, learned from the
labels of whole documents, say how much each passage counts, and the weighted
representation is scored:

    h = tanh(x W + b)    e = w . (tanh(h V) * sigmoid(h U))
    a = softmax(e) within the document    score = sigmoid(c . sum(a h) + c0)

The model is fitted on at most ``SAMPLE_DOCS`` labelled documents (a
documented bound; only their passage features reach the driver) and has a few
thousand numbers. Scoring streams all texts once.

Defined cases: a null or empty text is one empty passage; without labels all
scores are 0.5; repeated rows score alike; extra columns are carried along
and a column named like the new one is an error of Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, map_arrow, text_blocks
from .learned import Adam, append_score, held_out, sigmoid, training_rows

PASSAGE_WORDS = 48
#: Labelled documents that the model is fitted on, at most.
SAMPLE_DOCS = 6000
BIGRAMS, HIDDEN, GATES, EPOCHS, SEED = 128, 24, 16, 14, 7
_STATS = 10
FEATURES = _STATS + BIGRAMS

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper case, 2 lower case, 3 digit, 4 mark, 5 space
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 4
_CLASS[[32, *range(9, 14)]] = 5


def passages(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block, and the passage bounds of its texts."""
    block.words()
    n_words = np.diff(block.w_bounds)
    per = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    bounds = np.concatenate([[0], np.cumsum(per)])
    total = int(bounds[-1])
    x = np.zeros((total, FEATURES), np.float32)
    n = len(block.w_start)
    if not n:
        return x, bounds
    doc = np.repeat(np.arange(len(n_words)), n_words)
    own = bounds[doc] + (np.arange(n) - block.w_bounds[doc]) // PASSAGE_WORDS
    # bytes belong to the passage of the last word that began before them
    data = block.data
    size = np.diff(np.append(block.w_start, len(data)))
    by = np.repeat(own, size)
    body = data[block.w_start[0] :]
    kinds = np.bincount(by.astype(np.int64) * 6 + _CLASS[body], minlength=total * 6).reshape(total, 6)
    length = np.maximum(1, kinds.sum(1))
    words = np.maximum(1, np.bincount(own, minlength=total))
    x[:, :5] = kinds[:, [1, 2, 3, 4, 5]] / length[:, None]
    h = block.word_hash()
    again = np.zeros(n, bool)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    key = np.sort((h & np.uint64((1 << 40) - 1)) | own.astype(np.uint64) << np.uint64(40))
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    x[:, 5] = np.bincount(own, again, total) / words
    x[:, 6] = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=total) / words
    x[:, 7] = np.bincount(own, block.w_end - block.w_start, total) / words / 12
    marked = _CLASS[data[block.w_end - 1]] == 4
    x[:, 8] = np.bincount(own, marked, total) / words
    x[:, 9] = np.log1p(words) / 4
    pair = (body[1:].astype(np.int64) * 37 + body[:-1]) % BIGRAMS
    x[:, _STATS:] = np.bincount(by[1:] * BIGRAMS + pair, minlength=total * BIGRAMS).reshape(total, BIGRAMS) / length[:, None] * 4
    return x, bounds


def _by_bag(v: np.ndarray, bounds: np.ndarray, f=np.add) -> np.ndarray:
    return f.reduceat(v, bounds[:-1], axis=0)


def _forward(p: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["b"])
    a, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (a * g) @ p["w"]
    bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    e = np.exp(e - _by_bag(e, bounds, np.maximum)[bag])
    alpha = e / _by_bag(e, bounds)[bag]
    z = _by_bag(alpha[:, None] * h, bounds)
    return {"h": h, "a": a, "g": g, "bag": bag, "alpha": alpha, "z": z, "p": sigmoid(z @ p["c"] + p["c0"])}


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(p, x, bounds)
    h, a, g, bag, alpha = f["h"], f["a"], f["g"], f["bag"], f["alpha"]
    ds = (f["p"] - y) * weight / len(y)
    dz = ds[:, None] * p["c"][None, :]
    dalpha = (dz[bag] * h).sum(1)
    de = alpha * (dalpha - _by_bag(alpha * dalpha, bounds)[bag])
    dag = de[:, None] * p["w"][None, :]
    da, dg = dag * g * (1 - a * a), dag * a * g * (1 - g)
    dh = alpha[:, None] * dz[bag] + da @ p["V"].T + dg @ p["U"].T
    dpre = dh * (1 - h * h)
    return {"W": x.T @ dpre + 1e-5 * p["W"], "b": dpre.sum(0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ de, "c": f["z"].T @ ds, "c0": ds.sum(keepdims=True)}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for block in text_blocks(batch.column(0)):
            x, bounds = passages(block)
            x = x.astype(np.float16)
            rows = [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(labels[block.first : block.first + len(block)])], ["x", "label"])


def fit(docs: DataFrame, labels: DataFrame, label_col="quality", modulus: int = 3, remainder: int = 1, sample_docs: int = SAMPLE_DOCS, id_col="doc_id", text_col="text") -> dict[str, np.ndarray] | None:
    """The model, or None without labels of both kinds."""
    rows = map_arrow(training_rows(docs, labels, label_col, modulus, remainder, sample_docs, id_col, text_col), _features, "x binary, label double")
    got = rows.toArrow()
    y = got.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b in got.column("x").to_pylist()]
    order = sorted(range(len(bags)), key=lambda i: (len(bags[i]), y[i], bags[i].tobytes()))  # however tasks end
    return train([bags[i] for i in order], y[order])


def train(bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    """The model from passage features and labels of both kinds."""
    rng = np.random.default_rng(SEED)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
    p = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATES), "U": init(HIDDEN, GATES), "w": init(GATES), "c": init(HIDDEN), "c0": np.zeros(1)}
    mean = np.mean(y)
    weight = np.where(y > 0.5, 0.5 / mean, 0.5 / (1 - mean)) ** 0.5
    adam = Adam(p, 0.01)
    for epoch in range(EPOCHS):
        adam.rate = 0.01 if epoch < EPOCHS * 2 // 3 else 0.002
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            x = np.concatenate([bags[i] for i in batch]).astype(np.float64)
            bounds = np.concatenate([[0], np.cumsum([len(bags[i]) for i in batch])])
            adam.step(_gradients(p, x, bounds, y[batch], weight[batch]))
    return p


def scorer(model: dict[str, np.ndarray] | None):
    def score(column: pa.Array) -> np.ndarray:
        if model is None:
            return np.full(len(column), 0.5)
        return np.concatenate([_forward(model, *passages(block))["p"] for block in text_blocks(column)])

    return score


def with_quality(docs: DataFrame, model, text_col="text", out_col="score") -> DataFrame:
    return append_score(docs, scorer(model), text_col, out_col)


def op4_attention_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_quality(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
