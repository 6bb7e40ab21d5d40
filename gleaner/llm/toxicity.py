"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams (operator 2).

Features of a text: its distinct words, pairs of neighbours and pairs one word apart, each
a 64-bit hash. Training takes at most ``SAMPLE_ROWS`` labelled documents (a documented
bound; none whose id is held out), goes over them ``EPOCHS`` times with per-coordinate
rates, and the L1 term leaves a short list of weights, which tasks carry. Scoring covers
every whole text in one pass without a shuffle.

Defined cases: a null or empty text scores the bias alone; repeated rows score alike; with
no training rows every score is 0.5; an empty table gives no rows; a column of the input
named like a made one gives way.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from gleaner.llm.common import in_one_task, label_sample, map_columns, text_id
from gleaner.llm.textarrays import ALNUM, Texts, grams, keyed, slices

SAMPLE_ROWS = 6000
MIN_TEXTS = 5  # a feature seen in fewer training texts learns nothing
EPOCHS = 8
ALPHA, BETA = 1.0, 1.0
L1_PER_ROW = 0.005  # the L1 term of the mean loss; FTRL's own is this times the rows
HELD_OUT_OF = 5
_STEPS = ((0,), (0, 1), (0, 2))


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word, neighbour pair and skip pair."""
    low = t.lowered()
    start, end, text = low.segments(ALNUM)
    words = low.hashes(start, end)
    who, what = [], []
    for kind, steps in enumerate(_STEPS):
        at, h = grams(words, text, steps)
        who.append(text[at])
        what.append(h + np.uint64(kind))
    return np.concatenate(who), np.concatenate(what)


def ftrl(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Weights by coordinate; ``rows`` are the feature indices of each text (the last: bias)."""
    z, n = np.zeros(size), np.zeros(size)
    l1 = L1_PER_ROW * len(rows)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) * ALPHA / (BETA + np.sqrt(n[i])))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[k]
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return weights(np.arange(size))


def train(sample: pa.Table) -> bytes:
    """Sorted feature hashes with non-zero weights, and the bias."""
    order = np.argsort(np.array(sample.column("doc_id").to_pylist(), object), kind="stable")
    y = np.asarray(sample.column("y"), float)[order]
    column = sample.column("text").combine_chunks().take(pa.array(order))
    who, what = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for t in slices(column):
        a, h = features(t)
        first = np.unique(keyed(a, h), return_index=True)[1]
        who.append(a[first] + t.first)
        what.append(h[first])
    who, what = np.concatenate(who), np.concatenate(what)
    names, index, count = np.unique(what, return_inverse=True, return_counts=True)
    keep = count >= MIN_TEXTS
    place = np.cumsum(keep) - 1
    used = keep[index]
    who, index, names = who[used], place[index[used]], names[keep]
    order = np.argsort(who, kind="stable")
    who, index = who[order], index[order]
    edges = np.searchsorted(who, np.arange(len(y) + 1))
    rows = [np.append(index[a:b], len(names)) for a, b in zip(edges[:-1], edges[1:])]
    w = ftrl(rows, y, len(names) + 1)
    live = np.flatnonzero(w[:-1])
    return pickle.dumps((names[live], w[live], float(w[-1])))


def score_texts(t: Texts, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    names, w, bias = model
    out = np.full(len(t), bias)
    who, what = features(t)
    if len(names) and len(what):
        at = np.minimum(np.searchsorted(names, what), len(names) - 1)
        hit = np.flatnonzero(names[at] == what)
        once = hit[np.unique(keyed(who[hit], what[hit]), return_index=True)[1]]
        np.add.at(out, who[once], w[at[once]])
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    return pickle.loads(in_one_task(label_sample(docs, labels, label, HELD_OUT_OF, rows), train))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``toxicity``, the probability that a text is toxic."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        parts = [score_texts(t, model) for t in slices(batch.column("text"))]
        return {"toxicity": pa.array(np.concatenate(parts) if parts else [], pa.float64())}

    return map_columns(docs, run, [StructField("toxicity", DoubleType())], keep, ["text"])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (text_id() % HELD_OUT_OF == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
