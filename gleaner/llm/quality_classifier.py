"""Quality by a byte-level convolutional network in numpy (operator 6).

``FILTERS`` learned filters of ``WIDTH`` bytes run over overlapping chunks that cover the
whole text. Each chunk is max-pooled per filter; the mean and the maximum over a text's
chunks go through a small dense layer to one probability. A filter is a table of weights
by byte and place, so a convolution is table look-ups.

Training takes at most ``SAMPLE_ROWS`` labelled documents (a documented bound, none with a
held-out id), whole: it pools all chunks of a text as scoring does, which reads every byte.

Defined cases: a null or empty text, or one shorter than a filter, has all features 0 and
gets the network's answer to that; repeated rows score alike; without training rows the
weights stay at their seeded start; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from gleaner.llm.common import in_one_task, label_sample, map_columns, text_id
from gleaner.llm.textarrays import Texts, slices

SAMPLE_ROWS = 3000
EPOCHS = 8
FILTERS, WIDTH, HIDDEN = 12, 6, 16
CHUNK, STRIDE = 512, 448
TRAIN_BATCH = 512  # chunks convolved at once in training
HELD_OUT_OF = 5
THRESHOLD = 0.3


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping chunks of every text: starts, ends, text numbers. An empty text has one."""
    length = np.diff(offsets)
    count = 1 + np.maximum(0, -(-(length - CHUNK) // STRIDE))
    text = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + nth * STRIDE
    return start, np.minimum(start + CHUNK, offsets[text + 1]), text


def start_weights() -> dict[str, np.ndarray]:
    r = np.random.default_rng(7)
    return {
        "conv": r.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
        "w1": r.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": r.normal(0, 0.3, HIDDEN).astype(np.float32),
        "b2": np.full(1, 1.5, np.float32),
    }


def pooled(t: Texts, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk by filter: the largest response (0 at least); and the chunks' text numbers."""
    start, end, text = chunks(t.offsets)
    out = np.zeros((len(start), FILTERS), np.float32)
    n = len(t.data)
    fits = np.flatnonzero(end - start >= WIDTH)
    if len(fits):
        pair = np.zeros(n + 1, np.int64)
        pair[: n - 1] = (t.data[:-1].astype(np.int64) << 8) | t.data[1:]
        edges = np.empty(2 * len(fits), np.int64)
        edges[0::2], edges[1::2] = start[fits], end[fits] - WIDTH + 1
        views = [pair[j : n - WIDTH + 1 + j] for j in range(0, WIDTH, 2)]
        for f in range(FILTERS):
            total = np.empty(n - WIDTH + 2, np.float32)
            total[-1] = 0
            for j, v in enumerate(views):
                two = (conv[2 * j, :, f][:, None] + conv[2 * j + 1, :, f][None, :]).reshape(-1)
                if j == 0:
                    np.take(two, v, out=total[:-1])
                else:
                    total[:-1] += two[v]
            out[fits, f] = np.maximum(0, np.maximum.reduceat(total, edges)[0::2])
    return out, text


def combine(pool: np.ndarray, text: np.ndarray, n: int, m: dict[str, np.ndarray]) -> np.ndarray:
    """The probability of each text from its chunks' features."""
    first = np.searchsorted(text, np.arange(n))
    count = np.bincount(text, minlength=n)[:, None]
    x = np.concatenate([np.add.reduceat(pool, first, axis=0) / count, np.maximum.reduceat(pool, first, axis=0)], axis=1)
    logit = np.maximum(0, x @ m["w1"] + m["b1"]) @ m["w2"] + m["b2"][0]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -35, 35)))


def train(sample: pa.Table) -> bytes:
    m = start_weights()
    order = np.argsort(np.array(sample.column("doc_id").to_pylist(), object), kind="stable")
    y = np.asarray(sample.column("y"), np.float32)[order]
    texts = sample.column("text").combine_chunks().take(pa.array(order))
    taken: list[np.ndarray] = []
    for t in slices(texts):
        start, end, text = chunks(t.offsets)
        first = np.searchsorted(text, np.arange(len(t) + 1))
        for a, b in zip(first[:-1], first[1:]):
            rows = np.full((b - a, CHUNK), 256, np.int16)
            for r, c in enumerate(range(a, b)):
                rows[r, : end[c] - start[c]] = t.data[start[c] : end[c]]
            taken.append(rows)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step, rng = 0, np.random.default_rng(1)
    for _ in range(EPOCHS):
        for group in np.array_split(rng.permutation(len(y)), max(1, -(-len(y) // 48))):
            if len(group) == 0:
                continue
            x = np.concatenate([taken[i] for i in group])
            text = np.repeat(np.arange(len(group)), [len(taken[i]) for i in group])
            grad = gradients(m, x, text, y[group])
            step += 1
            for k, g in grad.items():
                a, b = state[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                m[k] -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return pickle.dumps(m)


def gradients(m: dict[str, np.ndarray], x: np.ndarray, text: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss; through a max-pool only the largest place has a gradient."""
    n, places = len(y), CHUNK - WIDTH + 1
    conv = np.concatenate([m["conv"], np.full((WIDTH, 1, FILTERS), -1e4, np.float32)], axis=1)
    at = np.empty((len(x), FILTERS), np.int64)
    pool = np.empty((len(x), FILTERS), np.float32)
    for a in range(0, len(x), TRAIN_BATCH):
        part = x[a : a + TRAIN_BATCH]
        z = conv[0][part[:, :places]]
        for k in range(1, WIDTH):
            z += conv[k][part[:, k : k + places]]
        at[a : a + TRAIN_BATCH] = z.argmax(axis=1)
        pool[a : a + TRAIN_BATCH] = np.maximum(0, z.max(axis=1))
    first = np.searchsorted(text, np.arange(n))
    count = np.bincount(text, minlength=n)[:, None].astype(np.float32)
    top = np.maximum.reduceat(pool, first, axis=0)
    feats = np.concatenate([np.add.reduceat(pool, first, axis=0) / count, top], axis=1)
    h = np.maximum(0, feats @ m["w1"] + m["b1"])
    p = 1 / (1 + np.exp(-np.clip(h @ m["w2"] + m["b2"][0], -30, 30)))
    d = (p - y) / n
    dh = d[:, None] * m["w2"] * (h > 0)
    dx = dh @ m["w1"].T
    dpool = dx[:, :FILTERS][text] / count[text] + dx[:, FILTERS:][text] * (pool == top[text])
    dpool *= pool > 0
    dconv = np.zeros((WIDTH, 257, FILTERS), np.float32)
    rows = np.arange(len(x))[:, None]
    for k in range(WIDTH):
        np.add.at(dconv[k], (x[rows, at + k], np.arange(FILTERS)[None, :]), dpool)
    return {"conv": dconv[:, :256], "w1": feats.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": d.sum(keepdims=True)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    return pickle.loads(in_one_task(label_sample(docs, labels, label, HELD_OUT_OF, rows), train))


def score_texts(t: Texts, m: dict[str, np.ndarray]) -> np.ndarray:
    pool, text = pooled(t, m["conv"])
    return combine(pool, text, len(t), m)


def score(docs: DataFrame, m: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``quality``, the probability that a text is good."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        parts = [score_texts(t, m) for t in slices(batch.column("text"))]
        return {"quality": pa.array(np.concatenate(parts) if parts else [], pa.float64())}

    return map_columns(docs, run, [StructField("quality", DoubleType())], keep, ["text"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns only."""
    names = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in names.items()], F.col("text"))
    scored = score(renamed, fit(docs, labels), keep=tuple(names.values()))
    return scored.filter(F.col("quality") >= THRESHOLD).select(*[F.col(h).alias(c) for c, h in names.items()])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (text_id() % HELD_OUT_OF == 0).alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"),
    )
