"""Whole texts of an Arrow batch as numpy arrays: words, lines and their 64-bit hashes.

A batch is worked through in slices of about ``SLICE_BYTES``; a text is never cut, so one
longer than that makes a slice of its own. Segment hashes are polynomial (prefix sums
modulo 2**64, then mixed), so every word and line costs a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an unsigned 64-bit array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x.astype(np.uint64, copy=False) + np.uint64(seed & (2**64 - 1)) * _GOLDEN + _GOLDEN)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as floats in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def byte_table(chars: str = "", ranges: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """256 booleans: the bytes of ``chars`` and of the inclusive ``ranges``."""
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: Words between white space: [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_table(" ", ((0x09, 0x0D),))
#: Words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
ALNUM = ~byte_table("", ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))
NEWLINE = byte_table("\n")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = hashed(np.arange(256, dtype=np.uint64), 11)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


class _Powers:
    """Powers of the base and of its inverse, grown as longer slices come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
            both = []
            for base in (_BASE, _INVERSE):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            if size > 8 * SLICE_BYTES:  # a very long text: not kept
                return both[0], both[1]
            self.up, self.down = both
        return self.up, self.down


_POWERS = _Powers()


class Texts:
    """Consecutive texts: ``data`` are their bytes, ``offsets`` where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first
        self._prefix: np.ndarray | None = None
        self._lower = False

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @staticmethod
    def of(texts: list[str | None]) -> Texts:
        (one,) = list(slices(pa.array(texts, pa.string()), 1 << 62)) or [Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0)]
        return one

    def lowered(self) -> Texts:
        """The same texts with A-Z lower-cased."""
        return Texts(_LOWER[self.data], self.offsets, self.first)

    def segments(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes in the table, cut at text ends: starts, ends, text numbers."""
        n = len(self.data)
        if n == 0:
            z = np.zeros(0, np.int64)
            return z, z, z
        m = inside[self.data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = m[:-1]
        edges = self.offsets[1:-1]
        before[edges[edges < n]] = False
        start = np.flatnonzero(m & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = m[1:]
        after[edges[edges > 0] - 1] = False
        end = np.flatnonzero(m & ~after) + 1
        return start, end, self.text_of(start)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines between newlines, empty ones too; nothing follows a text's last newline."""
        cut = np.flatnonzero(NEWLINE[self.data])
        full = np.diff(self.offsets) > 0
        start = np.sort(np.concatenate([self.offsets[:-1][full], (cut + 1)[~np.isin(cut + 1, self.offsets[1:])]]))
        end = np.sort(np.concatenate([cut, self.offsets[1:][full & ~np.isin(self.offsets[1:] - 1, cut)]]))
        return start, end, self.text_of(start)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each [start, end)."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            up, down = _POWERS.get(n + 1)
            if self._prefix is None:
                self._prefix = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTE_CODE[self.data] * up[:n], out=self._prefix[1:])
            value = (self._prefix[end] - self._prefix[start]) * down[start]
            return mix(value ^ ((end - start).astype(np.uint64) * _GOLDEN))

    def counts(self, inside: np.ndarray) -> np.ndarray:
        """Bytes of each text that are in the table."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(inside[self.data], out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


#: Bytes that begin a code point.
POINT = ~byte_table("", ((0x80, 0xBF),))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's texts (null: empty) in slices of about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield Texts(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at)
        at = to


def grams(hashes: np.ndarray, text: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ordered tuples of word hashes at the given distances inside one text: first index, hash."""
    reach = steps[-1]
    if len(hashes) <= reach:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[: len(text) - reach] == text[reach:])
    with np.errstate(over="ignore"):
        value = hashes[at]
        for s in steps[1:]:
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[at + s] + np.uint64(s))
    return at, value


def seen_before(keys: np.ndarray) -> np.ndarray:
    """For each key, how many equal ones stand before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    run = np.flatnonzero(new)
    rank = np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
    out = np.empty(len(k), np.int64)
    out[order] = rank
    return out


def keyed(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for a text number and a hash."""
    with np.errstate(over="ignore"):
        return mix(hashes + (text.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
