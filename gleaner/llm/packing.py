"""Packing by Karmarkar-Karp multiway differencing (operator 7).

Each document's ids, closed by id 0, are cut into whole windows of ``WINDOW`` ids and a
rest in near-equal pieces of at most ``PIECE``. Pieces gather in blocks of at least
``BLOCK`` of them. Within a block the differencing method keeps a heap of partial
partitions (one sum per window), and merges the two with the largest spread by adding the
largest sums of one to the smallest of the other. Starting from the least possible number
of windows, that number rises by one as long as a window would exceed the capacity.

Tokenising and packing run where a partition is read: no shuffle, so no key can be hot,
and memory is bounded by a block. A sequence id is the task's partition number and a
counter, so a task that runs again after a lost executor gives the same ids.

Defined cases: a null or empty text is the single id 0; repeated rows are packed each for
itself; a very long text makes whole windows and pieces as any other; an empty table
gives no rows; input columns named like made ones give way.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

WINDOW = 1024
PIECE = 256
BLOCK = 1024
SLACK = (8, 80)  # a block closes when this many ids are missing to whole windows
PARTITION_BITS = 33

#: Fixed value: the string of the vocabulary's one special token.
SPECIAL = "<|endoftext|>"

FIELDS = [StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [
    StructField("sequence_tokens", IntegerType())
]


def encoder(json_path: str | None, ranks_path: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level vocabulary.

    Both files hold one vocabulary; ids come from the rank file's faster reader, and texts
    with the special token's string from the ``tokenizers`` file, which knows that token.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            if not whole:
                whole.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
            return np.asarray(whole[0].encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(fast.encode_to_numpy(text), "<u4")

    return encode


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for ``k`` subsets: the subset of each item, and the subsets' sums."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()] * 1)
    # sets are nodes: 0..n-1 the items, later ones unions of two; -1 is the empty set
    left, right = [], []
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable"):
        heap.append((-int(sizes[i]), int(i), sizes[i : i + 1].astype(np.int64), np.array([i], np.int64)))
    heapq.heapify(heap)
    order = tick = n
    while len(heap) > 1:
        _, _, a, sa = heapq.heappop(heap)
        _, _, b, sb = heapq.heappop(heap)
        # sums are kept in falling order without the empty subsets at the end
        if len(a) + len(b) <= k:
            sums, sets = np.concatenate([a, b]), np.concatenate([sa, sb])
        else:
            both = len(a) + len(b) - k  # the smallest of each meet the other's
            if len(a) < len(b):
                a, sa, b, sb = b, sb, a, sa
            # a padded to k on the right, b padded to k and reversed: largest meet smallest
            full_a = np.zeros(k, np.int64)
            full_a[: len(a)] = a
            full_b = np.zeros(k, np.int64)
            full_b[k - len(b) :] = b[::-1]
            ids_a = np.full(k, -1, np.int64)
            ids_a[: len(sa)] = sa
            ids_b = np.full(k, -1, np.int64)
            ids_b[k - len(sb) :] = sb[::-1]
            meet = np.flatnonzero((ids_a >= 0) & (ids_b >= 0))
            assert len(meet) == both
            sets = np.where(ids_a >= 0, ids_a, ids_b)
            sets[meet] = order + np.arange(len(meet))
            left.append(ids_a[meet])
            right.append(ids_b[meet])
            order += len(meet)
            sums = full_a + full_b
        rank = np.argsort(-sums, kind="stable")
        sums, sets = sums[rank], sets[rank]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        tick += 1
        heapq.heappush(heap, (-spread, tick, sums, sets))
    _, _, sums, sets = heap[0]
    of = np.full(order, -1, np.int64)
    of[sets] = np.arange(len(sets))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        for node in range(order - 1, n - 1, -1):
            of[a[node - n]] = of[b[node - n]] = of[node]
    out = np.zeros(k, np.int64)
    out[: len(sums)] = sums
    return of[:n], out


def windows(sizes: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """The window of each piece and how many windows there are; none exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        of, sums = differencing(sizes, k)
        if sums.max(initial=0) <= capacity:
            return of, k
        k += 1


class Packer:
    """The blocks of one partition. ``ready`` rows: (doc row, start, length, crc, tokens, seq, offset, in seq)."""

    def __init__(self, partition: int, window: int, piece: int, block: int) -> None:
        self.window, self.piece, self.block = window, piece, block
        self.next = partition << PARTITION_BITS
        self.pieces: list[tuple[int, int, int, int, int]] = []
        self.total = 0
        self.ready: list[tuple[int, ...]] = []

    def add(self, row: int, ids: np.ndarray) -> None:
        n = len(ids)
        raw = ids.tobytes()
        whole = n // self.window * self.window
        for s in range(0, whole, self.window):
            self.ready.append((row, s, self.window, zlib.crc32(raw[4 * s : 4 * (s + self.window)]), n, self.next, 0, self.window))
            self.next += 1
        rest = n - whole
        if rest:
            cuts = np.linspace(whole, n, -(-rest // self.piece) + 1).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                self.pieces.append((row, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n))
                self.total += b - a
                missing = -self.total % self.window
                if len(self.pieces) >= self.block and SLACK[0] <= missing <= SLACK[1] or len(self.pieces) >= 2 * self.block:
                    self.close()

    def close(self) -> None:
        if not self.pieces:
            return
        p = np.array(self.pieces, np.int64)
        of, _ = windows(p[:, 2], self.window)
        order = np.lexsort((p[:, 1], p[:, 0], of))
        at, last = 0, -1
        sums = np.bincount(of, weights=p[:, 2]).astype(np.int64)
        for i in order.tolist():
            w = int(of[i])
            if w != last:
                at, last = 0, w
            row, start, length, crc, n = self.pieces[i]
            self.ready.append((row, start, length, crc, n, self.next + w, at, int(sums[w])))
            at += length
        self.next += len(sums)
        self.pieces, self.total = [], 0


def pack(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    piece: int = PIECE,
    block: int = BLOCK,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: ``keep`` columns of its document, then ``FIELDS``."""
    made = {f.name for f in FIELDS}
    kept = [c for c in keep if c.lower() not in made]
    plain = docs.select(*[docs[f"`{c}`"] for c in kept], docs["text"].alias("__text"))
    schema = StructType([docs.schema[c] for c in kept] + FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        packer = Packer(TaskContext.get().partitionId(), window, piece, block)
        waiting: list[pa.Table] = []  # the kept columns of rows with pieces not yet given out
        base = rows = 0

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal base, waiting
            if not packer.ready:
                return
            cols = list(zip(*packer.ready))
            packer.ready = []
            held = pa.concat_tables(waiting)
            took = held.take(pa.array(np.array(cols[0]) - base)).combine_chunks()
            made_cols = [pa.array(c, pa.int64()) for c in cols[1:7]] + [pa.array(cols[7], pa.int32())]
            arrays = [took.column(c).combine_chunks() if took.num_rows else took.column(c) for c in kept]
            arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays + made_cols, names=kept + [f.name for f in FIELDS])
            first = min((p[0] for p in packer.pieces), default=rows)
            waiting, base = [held.slice(first - base)], first

        for b in batches:
            waiting.append(pa.Table.from_batches([b.select(kept)]))
            text = b.column("__text")
            for i in range(len(b)):
                t = text[i].as_py()
                packer.add(rows, np.append(encode(t) if t else np.zeros(0, "<u4"), np.uint32(0)).astype("<u4"))
                rows += 1
                if len(packer.ready) >= 20_000:
                    yield from give()
        packer.close()
        yield from give()

    return plain.mapInArrow(run, schema)
