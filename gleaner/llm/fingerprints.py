"""Context-triggered piecewise hashing of documents (operator 5).

A rolling hash over ``ROLL`` bytes ends a chunk wherever it hits the block size's trigger;
each chunk gives one character. A fingerprint is ``size:signature:signature at twice the
size``; the block size doubles from ``LEAST`` with the length of the text and is halved
while the signature is short. Two fingerprints are compared at a block size they share:
1 - edit distance (insertions and deletions) over both lengths, 0 without a common run of
``RUN`` characters, 1 if equal.

The query also needs each document's next one by descending id. Ids are cut at real ids
into ranges of about ``ROWS`` documents; a range's greatest document goes along to the
range above it, so every task finds its last row's neighbour and no order is global.

Defined cases: a null or empty text has the fingerprint ``LEAST::``; texts shorter than
the rolling window are one chunk; equal texts have equal fingerprints; equal ids follow
each other by text; a null id comes last; a single document is its own next; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from gleaner.llm import textarrays
from gleaner.llm.common import map_columns
from gleaner.llm.textarrays import POINT, SLICE_BYTES, Texts, mix, slices

LEAST, LONG, SHORT, ROLL, RUN = 3, 64, 32, 7, 7
ROWS = 2000
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Stands for a null id, before every other id.
NO_ID = -(2**63)


def rolling(t: Texts) -> np.ndarray:
    """For each byte, a 32-bit hash of the ``ROLL`` bytes that end there (0 where fewer stand before it)."""
    n = len(t.data)
    out = np.zeros(n, np.uint32)
    if n >= ROLL:
        with np.errstate(over="ignore"):
            up, down = textarrays._POWERS.get(n + 1)
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(textarrays._BYTE_CODE[t.data] * up[:n], out=prefix[1:])
            t._prefix = prefix
            out[ROLL - 1 :] = mix((prefix[ROLL:] - prefix[:-ROLL]) * down[: n - ROLL + 1]) >> np.uint64(32)
    return out


def signatures(t: Texts) -> list[tuple[int, bytes, bytes]]:
    """(block size, signature, signature at twice the size) of each text."""
    roll = rolling(t)
    cuts: list[tuple[int, np.ndarray, np.ndarray]] = []
    for s, e in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist()):
        n, size = e - s, LEAST
        while size * LONG < n:
            size *= 2
        part = roll[s + ROLL - 1 : e] if n >= ROLL else roll[:0]
        while True:
            at = np.flatnonzero(part % np.uint32(size) == size - 1)
            if len(at) + 1 >= SHORT or size == LEAST:
                break
            size //= 2
        twice = at[part[at] % np.uint32(2 * size) == 2 * size - 1]
        cuts.append((size, at[: LONG - 1] + (s + ROLL), twice[: SHORT - 1] + (s + ROLL)))
    starts, ends, count = [], [], []
    for (size, one, two), s, e in zip(cuts, t.offsets[:-1].tolist(), t.offsets[1:].tolist()):
        for at in (one, two):
            inner = at[at < e]
            if e > s:
                starts.append(np.append(s, inner))
                ends.append(np.append(inner, e))
                count.append(len(inner) + 1)
            else:
                count.append(0)
    if starts:
        chars = _LETTERS[(t.hashes(np.concatenate(starts), np.concatenate(ends)) >> np.uint64(58)).astype(np.int64)].tobytes()
    else:
        chars = b""
    edge = np.concatenate([[0], np.cumsum(count)]).tolist()
    return [(c[0], chars[edge[2 * i] : edge[2 * i + 1]], chars[edge[2 * i + 1] : edge[2 * i + 2]]) for i, c in enumerate(cuts)]


def written(s: tuple[int, bytes, bytes]) -> str:
    return f"{s[0]}:{s[1].decode()}:{s[2].decode()}"


def read(fingerprint: str) -> tuple[int, bytes, bytes]:
    size, one, two = fingerprint.split(":")
    return int(size), one.encode(), two.encode()


def _matrix(rows: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(r) for r in rows])
    m = np.full((len(rows), LONG), pad, np.uint8)
    m[np.arange(LONG)[None, :] < length[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    return m, length


def agreement(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """1 - edit distance / both lengths of each pair; 0 without a common run."""
    a, la = _matrix(one, 255)
    b, lb = _matrix(two, 254)
    # longest common subsequence, a row of 64 places as the bits of a word
    v = np.full(len(a), 2**64 - 1, np.uint64)
    run = np.zeros(len(a), np.int64)
    streak = np.zeros((len(a), LONG), np.uint8)
    with np.errstate(over="ignore"):
        for j in range(LONG):
            same = a == b[:, j : j + 1]
            u = v & np.packbits(same, axis=1, bitorder="little").view(np.uint64)[:, 0]
            v = (v + u) | (v - u)
            moved = np.zeros_like(streak)
            moved[:, 1:] = streak[:, :-1]
            streak = np.where(same, moved + 1, 0).astype(np.uint8)
            np.maximum(run, streak.max(axis=1), out=run)
    common = LONG - np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1, dtype=np.int64)
    need = np.minimum(RUN, np.minimum(la, lb))
    whole = np.maximum(la + lb, 1)
    return np.where((run >= need) & (need > 0), 2 * common / whole, 0.0)


def likeness(one: list[tuple[int, bytes, bytes]], two: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(one))
    pairs: list[tuple[int, bytes, bytes]] = []
    for i, (a, b) in enumerate(zip(one, two)):
        if a == b:
            out[i] = 1.0
        elif a[0] == b[0]:
            pairs += [(i, a[1], b[1]), (i, a[2], b[2])]
        elif a[0] == 2 * b[0]:
            pairs.append((i, a[1], b[2]))
        elif b[0] == 2 * a[0]:
            pairs.append((i, a[2], b[1]))
    for k in range(0, len(pairs), 2048):
        some = pairs[k : k + 2048]
        np.maximum.at(out, [p[0] for p in some], agreement([p[1] for p in some], [p[2] for p in some]))
    return out


def fingerprint(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` of each whole text; no shuffle."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"fingerprint": pa.array([written(s) for t in slices(batch.column("text")) for s in signatures(t)], pa.string())}

    return map_columns(docs, run, [StructField("fingerprint", StringType())], keep, ["text"])


def ranges(ids: DataFrame, rows: int) -> list[int]:
    """Greatest ids of ranges of about ``rows`` documents: real ids, rising, the last the maximum."""
    n, most = ids.agg(F.count("*"), F.max("k")).first()
    if not n:
        return []
    parts = max(1, min(-(-n // rows), 1 << 20))
    inner = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts + 1000)).first()[0] if parts > 1 else []
    return sorted({*inner, most})


def with_next(docs: DataFrame, rows: int = ROWS) -> tuple[DataFrame, int]:
    """(part, is_guard, k, doc_id, text): each range with the document that follows its last."""
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.array(ranges(keyed.select("k"), rows), np.int64)
    n = len(bounds)

    def place(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        k = np.asarray(batch.column("k"))
        part = np.searchsorted(bounds, k, "left")
        guard = np.where(bounds[np.minimum(part, n - 1)] == k, (part + 1) % n, -1)
        return {"part": pa.array(part.astype(np.int32)), "also": pa.array(guard.astype(np.int32))}

    if n == 0:
        placed = keyed.select("k", "doc_id", "text", F.lit(0).alias("part"), F.lit(-1).alias("also"))
    else:
        from pyspark.sql.types import IntegerType

        placed = map_columns(keyed, place, [StructField("part", IntegerType()), StructField("also", IntegerType())], ["k", "doc_id", "text"], ["k"])
    both = F.when(F.col("also") >= 0, F.array(F.struct("part", F.lit(0).alias("is_guard")), F.struct(F.col("also").alias("part"), F.lit(1).alias("is_guard")))).otherwise(
        F.array(F.struct("part", F.lit(0).alias("is_guard")))
    )
    spread = placed.select("k", "doc_id", "text", F.explode(both).alias("p")).select("p.part", "p.is_guard", "k", "doc_id", "text")
    ordered = spread.repartitionById(max(1, n), F.col("part")).sortWithinPartitions("is_guard", F.desc("k"), "text")
    return ordered, n


FIELDS = [
    StructField("n_chars", LongType()),
    StructField("edited_sha256", StringType()),
    StructField("fingerprint", StringType()),
    StructField("edited_fingerprint", StringType()),
    StructField("near_edited", DoubleType()),
    StructField("near_next", DoubleType()),
]


def edited(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Each text but the last with its last third replaced by the beginning of the next; code points."""
    out, chars = [], []
    for one, two in zip(texts[:-1], texts[1:]):
        a = np.flatnonzero(POINT[np.frombuffer(one, np.uint8)])
        n = len(a)
        take = n // 3
        chars.append(n)
        if take == 0:
            out.append(one)
            continue
        b = np.flatnonzero(POINT[np.frombuffer(two, np.uint8)])
        out.append(one[: a[n - take]] + (two[: b[take]] if take < len(b) else two))
    return out, chars


def _texts(raw: list[bytes]) -> list[Texts]:
    """Raw texts in slices of a bounded size."""
    out, at = [], 0
    while at < len(raw):
        to, size = at + 1, len(raw[at])
        while to < len(raw) and size + len(raw[to]) <= SLICE_BYTES:
            size += len(raw[to])
            to += 1
        part = raw[at:to]
        out.append(Texts(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64), at))
        at = to
    return out


def digest(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """The query's columns: fingerprints of each text and its edited form, and their likeness."""
    ordered, _ = with_next(docs, rows)

    def rows_out(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        """Rows for all texts but the last, which is only the neighbour of the one before."""
        new, chars = edited(texts)
        own = [s for t in _texts(texts) for s in signatures(t)]
        other = [s for t in _texts(new) for s in signatures(t)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], id_type),
                pa.array(chars, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string()),
                pa.array([written(s) for s in own[:-1]], pa.string()),
                pa.array([written(s) for s in other], pa.string()),
                pa.array(likeness(own[:-1], other), pa.float64()),
                pa.array(likeness(own[:-1], own[1:]), pa.float64()),
            ],
            names=["doc_id"] + [f.name for f in FIELDS],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size, guarded = 0, False
        for b in batches:
            for i, text, guard in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), b.column("is_guard").to_pylist()):
                if guarded:  # further copies of the neighbour's id
                    break
                guarded = bool(guard)
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > SLICE_BYTES and len(texts) > 1 and not guarded:
                    yield rows_out(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield rows_out(ids, texts)

    id_type = pa.int64()
    out = StructField("doc_id", LongType())
    from pyspark.sql.types import StructType

    return ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "is_guard").mapInArrow(run, StructType([out] + FIELDS))
