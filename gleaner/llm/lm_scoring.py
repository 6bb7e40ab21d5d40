"""Scoring texts by a causal self-attention model over subword ids (operator 1).

A text is its words, lower-cased A-Z, each encoded with one space before it, as subword ids and
an end. At each place the query (the last two ids, embedded) attends to two sinks and to the
places before it in a window of ``SPAN`` keys. The value of a place is the id that followed it,
so attention copies; the values of the sinks are next-id distributions counted over all training
texts (after one id, and after two), smoothed by the shorter ones, so each sums to one. Trained
in numpy by gradient ascent: the bilinear form of queries and keys, a bias for each distance,
and the sinks' biases by how often the two ids were counted. Windows overlap: ``STEP``
places are scored in each, every place once, in batches under a causal mask.

Everything counted covers all training texts and the whole vocabulary of ids, and is never held
in one place: texts are dealt to blocks of about ``BLOCK_IDS`` ids, a block sends its distinct
words, pairs and triples of ids once to the buckets that they fall in, a bucket sums them over
all blocks and sends each block the sums of its own, and the block's texts are scored with those.
Blocks and buckets grow in number with the corpus (buckets up to 65,536). Only the counts of
single ids are broadcast. Words are 64-bit hashes.

The attention learns from every window of every training text: a block learns, with the sums that
came back to it, from its own training texts in the order of their hashes, and the results are
averaged by windows. So the weights follow from the table alone, whatever its partitions.

Texts are encoded once and written as ids to the shared folder; all later steps read those.

Defined cases: a null or empty text is the end alone; a null id is held out; repeated rows
count and score each; very long texts are scored whole, window by window; a training set
without words leaves uniform distributions; an empty table gives no rows; columns named
like made ones are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, text_id
from gleaner.llm.textarrays import NOT_SPACE, SLICE_BYTES, Texts, hashed, slices

IDS = 50257
END = 50256  # stands for the end of a text, and before its beginning
SPAN, STEP = 64, 32
WIDTH = 16  # of each of the two embedded ids
EVERY = 1  # all windows are learned from
BUCKETS = 16
RATE = 0.5
BLOCK_IDS = 3_000_000
LEAST_BLOCKS = 16
CHUNK = 1 << 18  # places or keys that are worked on at once: what a task holds beside its block
CACHED = 1 << 20  # words whose ids a task remembers
HELD_OUT_OF = 10
ID_KEYS, WORD_KEYS = 0, 1
#: The word that stands for the end of a text.
END_WORD = hashed(np.array([1], np.uint64), 77)[0]
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Coder:
    """Subword ids of words, each with a space before it; a task remembers the words that it met."""

    def __init__(self, path: str | None) -> None:
        import tiktoken

        ranks, pattern = vocabulary(path)
        self._encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._begins = word_starts(path)
        self._forget()

    def _forget(self) -> None:
        self._word, self._at, self._size, self._flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _meet(self, word: np.ndarray, low: Texts, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes words not met before, all in one call."""
        size = end - start + 1
        step = np.cumsum(size)
        data = low.data[np.maximum(np.repeat(start - 1 - (step - size), size) + np.arange(size.sum()), 0)]
        data[step - size] = 32  # in place of what stands before the word
        ids = np.asarray(self._encode(data.tobytes().decode("utf-8", "replace")), np.int64)
        at = np.flatnonzero(self._begins[ids])
        if len(at) != len(word):  # white space beyond ASCII took a space to itself: one by one
            each = [self._encode(" " + low.data[s:e].tobytes().decode("utf-8", "replace")) for s, e in zip(start.tolist(), end.tolist())]
            ids = np.concatenate([np.asarray(x, np.int64) for x in each])
            many = np.array([len(x) for x in each])
            at = np.cumsum(many) - many
        if len(self._word) > CACHED:
            self._forget()
        words = np.concatenate([self._word, word])
        order = np.argsort(words, kind="stable")  # two ascending runs are merged
        self._word = words[order]
        self._at = np.concatenate([self._at, at + len(self._flat)])[order]
        self._size = np.concatenate([self._size, np.diff(np.append(at, len(ids)))])[order]
        self._flat = np.concatenate([self._flat, ids.astype(np.uint16)])

    def stream(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each as END END ids... END, and where each begins."""
        low = t.lowered()
        start, end, text = low.segments(NOT_SPACE)
        h = low.hashes(start, end)
        word, _ = ascending(h)
        which = places(word, h)
        first = np.empty(len(word), np.int64)
        first[which] = np.arange(len(h))  # any one of equal words
        met = np.searchsorted(self._word, word)
        some = met < len(self._word)
        some[some] = self._word[met[some]] == word[some]
        if not some.all():
            full = len(self._word) > CACHED  # then all of this slice's words are met anew
            fresh = first if full else first[~some]
            self._meet(h[fresh], low, start[fresh], end[fresh])
            met = np.searchsorted(self._word, word)
        known = met[which]
        many = self._size[known]
        edge = np.zeros(len(t) + 1, np.int64)
        np.cumsum(np.bincount(text, weights=many, minlength=len(t)).astype(np.int64) + 3, out=edge[1:])
        out = np.full(edge[-1], END, np.int32)
        at = np.arange(many.sum())
        source = np.repeat(self._at[known] - (np.cumsum(many) - many), many) + at
        out[at + np.repeat(3 * text + 2, many)] = self._flat[source]
        return out, edge


def vocabulary(path: str | None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def word_starts(path: str | None) -> np.ndarray:
    """Which ids begin with a space, so a word."""
    begins = np.zeros(IDS, bool)
    begins[[i for word, i in vocabulary(path)[0].items() if word[:1] == b" "]] = True
    return begins


def encoded(docs: DataFrame, path: str | None) -> DataFrame:
    """(doc_id, held_out, h, ids): each text's stream of ids, 16 bits an id; texts are encoded here only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for t in slices(batch.column("text")):
                ids, edge = coder.stream(t)
                wide = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer((edge * 2).astype(np.int32)), pa.py_buffer(ids.astype(np.uint16))])
                kept = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in ("doc_id", "held_out", "h")], wide], names=["doc_id", "held_out", "h", "ids"])

    return docs.select("doc_id", "held_out", "h", "text").mapInArrow(run, "doc_id long, held_out boolean, h long, ids binary")


def streams(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The column's streams in slices: number of the first, ids, where each begins."""
    for t in slices(column, size):
        yield t.first, t.data.view(np.uint16).astype(np.int32), t.offsets // 2


def excerpts(train: DataFrame, shards: int) -> DataFrame:
    """(block, held_out, h, nth, ids, lead): windows to learn from as rows; block is -1 less the shard, places from ``lead`` count.

    ``score`` does not send windows: blocks learn from their own texts, which hold the same ones."""
    back = SPAN - STEP + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column("h"))
            for at, ids, edge in streams(batch.column("ids")):
                mine = h[at : at + len(edge) - 1]
                many = -(-(np.diff(edge) - 2) // STEP)
                begin = (mine >> 16) % np.minimum(many, EVERY)
                take = -(-(many - begin) // EVERY)
                text = np.repeat(np.arange(len(mine)), take)
                nth = begin[text] + EVERY * (np.arange(len(text)) - np.repeat(np.cumsum(take) - take, take))
                first = edge[text] + 2 + nth * STEP
                low, high = np.maximum(edge[text], first - back), np.minimum(edge[text + 1], first + STEP)
                parts = [ids[a:b].astype(np.uint16).tobytes() for a, b in zip(low.tolist(), high.tolist())]
                columns = [-1 - (mine[text] >> 8) % shards, np.ones(len(text), bool), mine[text], nth, pa.array(parts, pa.binary()), first - low]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "held_out", "h", "nth", "ids", "lead"])

    return train.select("h", "ids").mapInArrow(run, "block long, held_out boolean, h long, nth long, ids binary, lead long")


def id_counts(train: DataFrame) -> np.ndarray:
    """How often each id stands in the training texts, after the two ends at their beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(IDS, np.int64)
        for batch in batches:
            for _, ids, edge in streams(batch.column("ids")):
                n += np.bincount(ids, minlength=IDS)
                n[END] -= 2 * (len(edge) - 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["id", "n"])

    uni = np.zeros(IDS)
    for r in train.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        uni[r["id"]] = r["n"]
    return uni


def pair_keys(pair: np.ndarray) -> np.ndarray:
    """Keys of pairs of ids (16 bits an id), under 16 bits of their hash that choose the bucket."""
    with np.errstate(over="ignore"):
        key = pair * SPREAD
    key &= np.uint64(0xFFFF << 48)
    key |= pair
    key |= np.uint64(0xFFFF << 32)
    return key


def triple_keys(ids: np.ndarray) -> np.ndarray:
    """Keys of the triples that end at each place from the third on, under the 16 bits of their first two ids."""
    wide = ids.astype(np.uint64)
    pair = (wide[:-2] << np.uint64(16)) | wide[1:-1]
    with np.errstate(over="ignore"):
        key = pair * SPREAD
    key &= np.uint64(0xFFFF << 48)
    pair <<= np.uint64(16)
    key |= pair
    key |= wide[2:]
    return key


def counted_places(edge: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Places from just before each stream's ``lead``, the third one at least."""
    counts = np.ones(edge[-1], bool)
    before = np.maximum(lead - 1, 2)
    skipped = np.repeat(edge[:-1], before) + np.arange(before.sum()) - np.repeat(np.cumsum(before) - before, before)
    counts[skipped] = False
    return np.flatnonzero(counts)


def id_keys(ids: np.ndarray, edge: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counted places, and the keys of their pairs, then of their triples."""
    at = counted_places(edge, lead)
    if len(ids) < 3:
        return at, np.zeros(0, np.uint64)
    triples = triple_keys(ids)[at - 2]
    return at, np.concatenate([pair_keys(triples & np.uint64(0xFFFFFFFF)), triples])


def id_words(ids: np.ndarray, edge: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of all words, by their ids, and of an end for each text."""
    start = np.flatnonzero(begins.take(ids))
    text = np.repeat(np.arange(len(edge) - 1), np.diff(np.searchsorted(start, edge)))
    size = np.diff(start, append=len(ids))  # ends of texts are worth nothing
    code = hashed(np.arange(IDS, dtype=np.uint64), 31)
    code[END] = 0
    h = np.zeros(0, np.uint64)
    if len(start):
        nth = np.arange(start[0], len(ids), dtype=np.int32)
        nth -= np.repeat(start.astype(np.int32), size)
        with np.errstate(over="ignore"):
            part = code.take(ids[start[0] :])
            part *= powers(int(size.max())).take(nth)
            h = np.add.reduceat(part, start - start[0])
        h = hashed(h ^ (np.minimum(start + size, edge[text + 1] - 1) - start).astype(np.uint64) * SPREAD, 32)
    return np.concatenate([text, np.arange(len(edge) - 1)]), np.concatenate([h, np.full(len(edge) - 1, END_WORD)])


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2**64."""
    x = np.full(n, 0xD1342543DE82EF95, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def ascending(keys: np.ndarray, kind: str = "quicksort") -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and how many there are of each."""
    k = np.sort(keys, kind=kind)
    at = starts(k)
    return k[at], np.diff(at, append=len(k))


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct one of ascending keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def spots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order and the place of each, equal ones by their places; short keys are sorted with their places below."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = keys << np.uint64(bits)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    place = both & np.uint64((1 << bits) - 1)
    both >>= np.uint64(bits)
    return both, place.view(np.int64)


def distinct(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and how many of each are counted."""
    if counted.all():
        return ascending(keys)
    train, n = ascending(keys[counted])
    u, _ = ascending(np.concatenate([train, ascending(keys[~counted])[0]]), "stable")  # two ascending runs are merged
    out = np.zeros(len(u), np.int64)
    out[np.searchsorted(u, train)] = n
    return u, out


def places(u: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place among the distinct keys, all of which have one: a hash table in two arrays."""
    bits = max(1, int(len(u)).bit_length() + 1)
    shift, mask = np.uint64(64 - bits), (1 << bits) - 1

    def slot(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((x ^ (x >> np.uint64(29))) * SPREAD) >> shift).astype(np.int64)

    table = np.full(1 << bits, -1, np.int32)
    for a in range(0, len(u), CHUNK):
        at = slot(u[a : a + CHUNK])
        left = np.arange(a, a + len(at), dtype=np.int32)
        while len(left):
            free = table[at] < 0
            table[at[free]] = left[free]  # of several the last one stays
            lost = table[at] != left
            left, at = left[lost], (at[lost] + 1) & mask
    out = np.empty(len(keys), np.int32)
    for a in range(0, len(keys), CHUNK):
        key, got = keys[a : a + CHUNK], out[a : a + CHUNK]
        at = slot(key)
        got[:] = table[at]
        open_ = np.flatnonzero(u[got] != key)
        at = at[open_]
        while len(open_):
            at = (at + 1) & mask
            got[open_] = table[at]
            more = u[got[open_]] != key[open_]
            open_, at = open_[more], at[more]
    return out


class Kinds:
    """The distinct pairs and triples of ids in a block's streams, in the order of their keys.

    Places are sorted by their pairs, then by the number of the pair before and their own id, so a
    triple knows its pair and the pair before it. ``order`` merges both kinds of keys.
    """

    def __init__(self, ids: np.ndarray, edge: np.ndarray) -> None:
        wide = np.append(np.uint64(END), ids.astype(np.uint64))
        key = wide[:-1] << np.uint64(16)
        key |= wide[1:]  # the ends between two texts are a pair END END
        key, spot = spots(key)
        start = starts(key)
        keys = pair_keys(key[start])
        order = np.argsort(keys)
        self.pairs = keys[order]
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        pair = np.empty(len(ids), np.int32)  # the pair that ends at a place
        pair[spot] = np.repeat(number, np.diff(start, append=len(key)))
        key = np.append(np.int32(0), pair[:-1]).astype(np.uint64)
        key <<= np.uint64(16)
        key |= wide[1:]
        for begin in (edge[:-1], edge[:-1] + 1):
            key[begin] = len(order) << 16  # no triple ends here: behind all others
        key, spot = spots(key)
        many = len(ids) - 2 * (len(edge) - 1)
        key, self.at = key[:many], spot[:many]
        self.start = starts(key)
        self.many = np.diff(self.start, append=many)
        self.pair = pair[self.at[self.start]]
        self.seen = (key[self.start] >> np.uint64(16)).astype(np.int32)
        self.z = (key[self.start] & np.uint64(0xFFFF)).astype(np.int32)
        xy = self.pairs[self.seen]
        triples = (xy & np.uint64(0xFFFF << 48)) | ((xy & np.uint64(0xFFFFFFFF)) << np.uint64(16)) | self.z.astype(np.uint64)
        self.order = np.argsort(np.concatenate([self.pairs, triples]), kind="stable")  # two ascending runs are merged
        self.triples = triples

    def keys(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All distinct keys in ascending order, and how many of each stand at places that count."""
        n = np.add.reduceat(counts[self.at].astype(np.int64), self.start) if len(self.at) else np.zeros(0, np.int64)
        pairs = np.bincount(self.pair, weights=n, minlength=len(self.pairs)).astype(np.int64)
        return np.concatenate([self.pairs, self.triples])[self.order], np.concatenate([pairs, n])[self.order]

    def values(self, uni: np.ndarray, sums: np.ndarray) -> Iterator[np.ndarray]:
        """``after`` of every distinct triple, of the sums of all distinct keys in ascending order."""
        n = np.empty(len(sums))
        n[self.order] = sums
        pair, triple = n[: len(self.pairs)], n[len(self.pairs) :]
        out = np.empty(len(triple), np.float32), np.empty(len(triple), np.float32), np.empty(len(triple), np.uint8)
        for a in range(0, len(triple), CHUNK):
            part = slice(a, a + CHUNK)
            xy = (self.pairs[self.seen[part]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for to, v in zip(out, after(xy >> 16, xy & 0xFFFF, self.z[part], uni, pair[self.pair[part]], pair[self.seen[part]], triple[part])):
                to[part] = v
        return iter(out)


class Block:
    """A block's streams with its distinct keys: the same when they are sent and when their sums come back.

    Without ``begins`` its words are left out.
    """

    def __init__(self, rows: pa.Table, begins: np.ndarray | None) -> None:
        parts = list(streams(rows.column("ids"), 1 << 62))
        _, self.ids, self.edge = parts[0] if parts else (0, np.zeros(0, np.int32), np.zeros(1, np.int64))
        self.held = np.asarray(rows.column("held_out"), bool)
        if begins is not None:
            self.text, self.words = id_words(self.ids, self.edge, begins)

    def kinds(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Distinct keys of each kind and how often the block's training texts have them."""
        return {ID_KEYS: Kinds(self.ids, self.edge).keys(np.repeat(~self.held, np.diff(self.edge))), WORD_KEYS: distinct(self.words, ~self.held[self.text])}

    def word_counts(self, sums: np.ndarray) -> list[np.ndarray]:
        """How many words each text has, how many of them are counted, and the sum of the counts' logarithms, of the distinct words' sums."""
        which = places(ascending(self.words)[0], self.words)
        each = [None, (sums > 0).astype(float).take(which), np.log10(sums + 0.1).take(which)]
        return [np.bincount(self.text, weights=x, minlength=len(self.held)) for x in each]

    def values(self, uni: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``next_id`` at every place from the third on, of the sums of this block's distinct keys."""
        kinds = Kinds(self.ids, self.edge)
        out = []
        for v in kinds.values(uni, sums):
            each = np.zeros(max(len(self.ids) - 2, 0), v.dtype)
            each[kinds.at - 2] = np.repeat(v, kinds.many)
            out.append(each)
        return tuple(out)


def after(x: np.ndarray, y: np.ndarray, z: np.ndarray, uni: np.ndarray, pair: np.ndarray, seen: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(z | y), P(z | x y) and the bucket of how often x y was counted, of the counts of y z, x y and x y z."""
    one = (uni + 0.5) / (uni.sum() + 0.5 * IDS)
    two = (pair + 10 * one[z]) / (uni[y] + 10)
    seen = np.where((x == END) & (y == END), uni[END], seen)
    three = (triple + 5 * two) / (seen + 5)
    return two.astype(np.float32), three.astype(np.float32), np.minimum(np.log2(seen + 1).astype(np.int64), BUCKETS - 1)


def next_id(ids: np.ndarray, uni: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``after`` at every place from the third on, of the counts at every place."""
    return after(ids[:-2], ids[1:-1], ids[2:], uni, pair[2:], pair[1:-1], triple[2:])  # a pair is counted where its second id stands


def packed() -> pa.Codec:
    return pa.Codec("zstd", 1)


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, so that their equal high bytes stand together, compressed; high bytes that all are 0 are left out."""
    many = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return packed().compress(x.view(np.uint8).reshape(-1, 8).T[:many].tobytes(), asbytes=True) + bytes([many]) + len(x).to_bytes(4, "little")


def unplanes(x: bytes, kind: type) -> np.ndarray:
    many, n = x[-5], int.from_bytes(x[-4:], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :many] = np.frombuffer(packed().decompress(x[:-5], many * n), np.uint8).reshape(many, n).T
    return out.view(kind).ravel()


SENT = "block long, kind int, bucket int, first boolean, keys binary, n binary"
SUMS = "block long, kind int, bucket int, first boolean, sums binary, total long, kinds long"


def sent(blocks: DataFrame, buckets: int, path: str | None) -> DataFrame:
    """Each block's distinct keys and how often its training texts have them, by the bucket they fall in; one piece is its first."""

    begins = np.packbits(word_starts(path))  # made once, small

    def run(rows: pa.Table) -> pa.Table:
        b = Block(rows, np.unpackbits(begins, count=IDS).astype(bool))
        cuts = np.array([(-(-i * 65536 // buckets)) << 48 for i in range(1, buckets)], np.uint64)
        out: list[tuple[int, int, bool, bytes, bytes]] = []
        for kind, (keys, n) in b.kinds().items():
            ends = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
            out += [(kind, i, kind == ID_KEYS and s == 0, planes(keys[s:e]), planes(n[s:e])) for i, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
        block = rows.column("block")[0].as_py()
        names = [f.split()[0] for f in SENT.split(", ")]
        columns = [[block] * len(out), *([r[i] for r in out] for i in range(5))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=names)

    return blocks.groupBy("block").applyInArrow(lambda t: run(t), SENT)


def summed(pieces: DataFrame) -> DataFrame:
    """Each piece's keys summed over all blocks; a bucket's total and number of counted keys go with one piece."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [unplanes(k, np.uint64) for k in rows.column("keys").to_pylist()]
        n = np.concatenate([unplanes(k, np.int64) for k in rows.column("n").to_pylist()])
        every = np.concatenate(keys)
        u, _ = ascending(every)
        which = places(u, every)
        sums = np.bincount(which, weights=n, minlength=len(u)).astype(np.int64)
        each = np.split(sums[which], np.cumsum([len(k) for k in keys])[:-1])
        total, kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        total[0], kinds[0] = sums.sum(), np.count_nonzero(sums)
        columns = [*(rows.column(c) for c in ("block", "kind", "bucket", "first")), pa.array([planes(s) for s in each], pa.binary()), pa.array(total), pa.array(kinds)]
        return pa.table(columns, names=[f.split()[0] for f in SUMS.split(", ")])

    return pieces.groupBy("kind", "bucket").applyInArrow(lambda t: run(t), SUMS)


def joined(right: pa.Table, kind: int) -> np.ndarray:
    """The sums that came back for a block's distinct keys, in the order of the keys."""
    rows = sorted((b, s) for k, b, s in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "sums"))) if k == kind)
    return np.concatenate([unplanes(s, np.int64) for _, s in rows]) if rows else np.zeros(0, np.int64)


def signs() -> np.ndarray:
    """Fixed random signs of each id, as bits: for the last id and for the one before."""
    return np.packbits((hashed(np.arange(IDS * 2 * WIDTH, dtype=np.uint64), 21) >> np.uint64(63)).astype(np.uint8))


def embedding(bits: np.ndarray | None = None) -> np.ndarray:
    """The signs as numbers: a table for the last id and one for the one before."""
    each = np.unpackbits(signs() if bits is None else bits, count=IDS * 2 * WIDTH)
    unit = np.float32(WIDTH**0.5)
    return np.array([-1 / unit, 1 / unit], np.float32).take(each).reshape(2, IDS, WIDTH)


def start_weights() -> dict[str, np.ndarray]:
    form = np.eye(2 * WIDTH, dtype=np.float32) * np.repeat([3.0, 3.0], WIDTH).astype(np.float32)
    return {"form": form, "distance": np.full(SPAN + STEP, -6.0, np.float32), "sinks": np.stack([np.zeros(BUCKETS), np.linspace(0, 3, BUCKETS)]).astype(np.float32)}


#: Place minus key of each scored place and key of a window, as an index of the distances, and which keys are known there.
FAR = np.arange(STEP)[:, None] + (SPAN - STEP + 1) - np.arange(SPAN)[None, :]
CLIPPED = np.clip(FAR, 0, SPAN + STEP - 1)
KNOWN = FAR >= 2


def last_same(ids: np.ndarray) -> np.ndarray:
    """The last place before each one with the same id, else -1."""
    if len(ids) > 1 << 16:
        key, spot = spots(ids.astype(np.uint64))
    else:  # both in 32 bits
        key = np.sort((ids.astype(np.uint32) << np.uint32(16)) | np.arange(len(ids), dtype=np.uint32))
        spot = (key & np.uint32(0xFFFF)).astype(np.int32)
        key >>= np.uint32(16)
    out = np.full(len(ids), -1, np.int32)
    out[spot[1:]] = np.where(key[1:] == key[:-1], spot[:-1], -1)
    return out


class Windows:
    """All windows of a stream of ids: ``STEP`` scored places and ``SPAN`` keys in each, those of the block before and its own.

    A key stands at the place whose id followed it. ``value`` is what ``next_id`` gives; with ``lead`` each
    stream is one window that scores from there.
    """

    def __init__(self, z: np.ndarray, edge: np.ndarray, value: tuple[np.ndarray, np.ndarray, np.ndarray], table: np.ndarray, lead: np.ndarray | None = None) -> None:
        self.z, self.value, self.table = z, value, table.reshape(2 * IDS, WIDTH)
        self.most = float(np.abs(table).max()) ** 2  # of a product of two embedded numbers
        many = -(-(np.diff(edge) - 2) // STEP) if lead is None else np.ones(len(edge) - 1, np.int64)
        self.text = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(many) - many, many)
        self.first = edge[self.text] + 2 + nth * STEP if lead is None else edge[:-1] + lead
        self.low, self.high = edge[self.text], edge[self.text + 1]
        self.hop = 1 if lead is None else 2  # blocks of a window: those of one text share theirs
        self.ready = range(0)
        self.room = np.empty((0, STEP, SPAN), np.float32)

    def keep(self, texts: np.ndarray) -> Windows:
        """Only the windows of these texts (a mask)."""
        kept = texts[self.text]
        self.text, self.first, self.low, self.high = (x[kept] for x in (self.text, self.first, self.low, self.high))
        return self

    def prepare(self, a: int, b: int) -> None:
        """What the batches of windows ``a`` to ``b`` share: their places' ids and values, and the keys that copy an id."""
        first, low = self.first[a:b], self.low[a:b]
        begin, floor = first - STEP, np.maximum(first - STEP, low + 2)
        start = np.append(begin[0], first) if self.hop == 1 else np.stack([begin, first], 1).ravel()
        place = np.clip(start[:, None] + np.arange(STEP), 2, len(self.z) - 1)
        at = place[1 :: self.hop]  # scored places
        self.real = first[:, None] + np.arange(STEP) < self.high[a:b, None]
        self.inside = begin[:, None] + np.arange(STEP) >= low[:, None] + 2  # keys of the block before that are in the text
        self.begins = ~self.inside[:, 0]
        self.rows = np.empty((*place.shape, 2), np.int64)
        self.rows[..., 0], self.rows[..., 1] = self.z.take(place - 1), self.z.take(place - 2)
        self.rows[..., 1] += IDS
        self.values = [v.take(at - 2) for v in self.value]
        self.values[2] = self.values[2].astype(np.int64)
        # of each place the earlier ones with its id, one after the other
        base = max(int(begin[0]), 0)
        last = last_same(self.z[base : int(at[-1, -1]) + 1])
        key = np.where(self.real, last.take(at - base), -1).ravel()
        least = np.repeat((floor - base).astype(np.int32), STEP)
        code = np.arange(0, len(key) * SPAN, SPAN, dtype=np.int32) - np.repeat((begin - base).astype(np.int32), STEP)
        hits = [np.zeros(0, np.int32)]
        while len(key):
            kept = np.flatnonzero(key >= least)
            key, least, code = key.take(kept), least.take(kept), code.take(kept)
            hits.append(code + key)
            key = last.take(key)
        self.hits = np.sort(np.concatenate(hits))
        self.ends = np.searchsorted(self.hits, np.arange(0, (b - a + 1) * STEP * SPAN, STEP * SPAN))
        self.ready = range(a, b)

    def factors(self, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """What distances and sinks multiply; nothing where an exponential may leave its range."""
        if self.most * np.abs(m["form"]).sum() + max(m["distance"].max(), 0) > 60 or np.abs(m["sinks"]).max() > 60:
            return None
        return np.where(KNOWN, np.exp(m["distance"])[CLIPPED], np.float32(0)), np.exp(m["sinks"])

    def batch(self, w: slice, m: dict[str, np.ndarray], learn: bool, factors: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray] | None]:
        """Each place's probability (1 where a window goes beyond its text), and the gradient's sums."""
        start, stop, hop = w.start, min(w.stop, len(self.first)), self.hop
        if start < self.ready.start or stop > self.ready.stop:
            self.prepare(start, min(max(stop, start + STRETCH), len(self.first)))
        n, at = stop - start, slice(start - self.ready.start, stop - self.ready.start)
        if len(self.room) < n:
            self.room = np.empty((n, STEP, SPAN), np.float32)
            self.asked = np.empty((2 * WIDTH, 2 * (n + 1) * STEP + STEP // 2), np.float32)  # rows of no round length: they fall on other lines of the cache
        weight, real, (two, three, bucket) = self.room[:n], self.real[at], (v[at] for v in self.values)
        # blocks of ``STEP`` embedded places; a window's keys are the block before it and its own
        e = self.table.take(self.rows[hop * at.start : hop * at.stop + 2 - hop], axis=0).reshape(-1, STEP, 2 * WIDTH)
        asked = self.asked[:, : e.shape[0] * STEP]
        np.matmul(m["form"], e.reshape(-1, 2 * WIDTH).T, out=asked)
        wide, size = hop * STEP, e.itemsize
        np.matmul(e[1::hop], np.lib.stride_tricks.as_strided(asked, (n, 2 * WIDTH, SPAN), (wide * size, asked.strides[0], size)), out=weight)
        begins = np.flatnonzero(self.begins[at])  # windows that reach back to before their text
        factors = factors or self.factors(m)
        if factors is None:  # less the maximum
            weight += np.where(KNOWN, m["distance"][CLIPPED], np.float32(-1e9))
            weight[begins, :, :STEP] += np.where(self.inside[at][begins], 0, -1e9).astype(np.float32)[:, None, :]
            sink = m["sinks"].take(bucket, axis=1)
            top = np.maximum(sink.max(axis=0), weight.max(axis=2))
            weight -= top[..., None]
            s0, s1 = np.exp(sink - top)
            near = KNOWN.astype(np.float32)
        else:
            near, sinks = factors
            s0, s1 = sinks[0].take(bucket), sinks[1].take(bucket)
        np.exp(weight, out=weight)
        if len(begins):
            weight[begins, :, :STEP] *= self.inside[at][begins][:, None, :]
        low, high = self.ends[at.start], self.ends[at.stop]
        hits = self.hits[low:high] - at.start * STEP * SPAN  # few of the keys
        places_hit = hits // SPAN
        if learn:
            weight *= near
            weight_hit = weight.ravel().take(hits)
            total = (weight.reshape(-1, SPAN) @ np.ones(SPAN, np.float32)).reshape(n, STEP)
        else:
            weight_hit = weight.ravel().take(hits) * near.ravel().take(hits % (STEP * SPAN))
            total = (weight.transpose(1, 0, 2) @ near[..., None])[..., 0].T
        total = total + s0 + s1
        copied = np.bincount(places_hit, weights=weight_hit, minlength=n * STEP).reshape(n, STEP)
        good = s0 * two + s1 * three + copied
        p = np.where(real, good / total, 1.0)
        if not learn:
            return p, real, None
        good = np.maximum(good, 1e-30)
        # share of the outcome (of the few keys that copy it) minus share of the attention, for each key; both over ``share``
        share = real * np.float32(-1 / n) / total
        gain = (total / good).astype(np.float32)
        each = bucket.ravel()
        sinks = np.stack([np.bincount(each, weights=(s * share * (1 - v * gain)).ravel(), minlength=BUCKETS) for s, v in ((s0, two), (s1, three))])
        weight.ravel()[hits] = weight_hit - weight_hit * gain.ravel().take(places_hit)
        far = (share.T[:, None, :] @ weight.transpose(1, 0, 2))[:, 0]
        distance = np.bincount(CLIPPED.ravel(), weights=far.ravel(), minlength=SPAN + STEP)
        pulled = weight @ np.lib.stride_tricks.as_strided(e, (n, SPAN, 2 * WIDTH), (wide * e.strides[1], *e.strides[1:]))
        pulled *= share[..., None]
        form = (e[1::hop].transpose(0, 2, 1) @ pulled).sum(axis=0)
        return p, real, {"form": form, "distance": distance, "sinks": sinks}


STRETCH = 1024  # windows whose places are prepared at once
BATCH = 128  # windows worked on at once: their scores (1 MB) stay in the processor's cache
LEARN_BATCH = 256  # windows of a gradient step


def learn(w: Windows, m: dict[str, np.ndarray], squares: dict[str, np.ndarray]) -> int:
    """One pass of gradient ascent over the windows, with rates by coordinate."""
    n = len(w.first)
    for a in range(0, n, LEARN_BATCH):
        step = range(a, min(a + LEARN_BATCH, n), BATCH)
        factors = w.factors(m)
        parts = [(w.batch(slice(i, min(i + BATCH, step.stop)), m, True, factors)[2], min(BATCH, step.stop - i) / (step.stop - a)) for i in step]
        for name in m:
            g = sum(part[name] * share for part, share in parts)
            squares[name] += g * g
            m[name] += (RATE * g / (np.sqrt(squares[name]) + 1e-6)).astype(np.float32)
    return n


def flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in sorted(m)]).astype(np.float64)


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    like = start_weights()
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(dealt: DataFrame, sums: DataFrame, uni) -> DataFrame:  # noqa: ANN001
    """(weights): each block learns on all windows of its training texts, the results are averaged by windows; one row."""

    bits = signs()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["i", "v", "n"]
        if not len(left) or np.asarray(left.column("held_out"), bool).all():  # nothing to learn from
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.float64(), pa.float64())], names=names)
        m = start_weights()
        squares = {k: np.zeros(v.shape) for k, v in m.items()}
        b = Block(left.take(np.argsort(np.asarray(left.column("h")), kind="stable")), None)  # equal hashes: equal rows
        n = learn(Windows(b.ids, b.edge, b.values(uni.value, joined(right, ID_KEYS)), embedding(bits)).keep(~b.held), m, squares)
        v = flat(m)
        return pa.table([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v * n), pa.array(np.full(len(v), float(n)))], names=names)

    learned = dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(lambda left, right: run(left, right), "i int, v double, n double")
    each = learned.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("weights"))  # about 1,100 numbers


def weights_of(row: list[float] | None) -> dict[str, np.ndarray]:
    """Learned weights; where nothing was learned (no training text), those it would start from."""
    v = flat(start_weights())
    got = np.asarray(row or [], float)
    return unflat(np.where(np.isfinite(got), got, v) if len(got) == len(v) else v)


def score_texts(ids: np.ndarray, edge: np.ndarray, value: tuple[np.ndarray, np.ndarray, np.ndarray], m: dict[str, np.ndarray], table: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a stream."""
    w = Windows(ids, edge, value, table)
    each = np.zeros(len(w.first))
    factors = w.factors(m)
    for a in range(0, len(w.first), BATCH):
        s = slice(a, a + BATCH)
        p, _, _ = w.batch(s, m, False, factors)
        each[s] = np.log(p).sum(axis=1)
    return np.bincount(w.text, weights=each, minlength=len(edge) - 1) / np.log(10)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, train_words long, train_kinds long"


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's columns for every document; trained on those that are not held out."""
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (text_id() % HELD_OUT_OF == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("h")
    )
    coded = cut(encoded(base, path))
    rows, size = coded.agg(F.count("*"), F.sum(F.length("ids"))).first()
    blocks = max(1, min(rows, LEAST_BLOCKS), -(-(size or 0) // (2 * BLOCK_IDS)))
    training = coded.filter(~F.col("held_out"))
    uni = spark.sparkContext.broadcast(id_counts(training))

    dealt = coded.select("doc_id", "held_out", "h", "ids", F.pmod("h", F.lit(blocks)).cast("long").alias("block")).repartition(blocks, "block")
    buckets = min(blocks, 65536)
    sums = summed(sent(dealt, buckets, path)).repartition(blocks, "block")
    learned = train(dealt, sums, uni).select(F.lit(True).alias("first"), "weights")
    come_back = sums.join(F.broadcast(learned), "first", "left")  # one row of about 1,100 numbers

    begins, bits = np.packbits(word_starts(path)), signs()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in RESULT.split(", ")]
        if not len(left):  # a block that no text fell in
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())], names=names)
        b = Block(left, np.unpackbits(begins, count=IDS).astype(bool))
        m = weights_of(right.filter(right.column("first")).column("weights")[0].as_py())
        many = len(left)
        counts = b.word_counts(joined(right, WORD_KEYS))
        words = np.array([k == WORD_KEYS for k in right.column("kind").to_pylist()])
        # what the block's pieces know of N and V goes with its first row
        total, kinds = np.zeros(many, np.int64), np.zeros(many, np.int64)
        total[0], kinds[0] = (int(np.asarray(right.column(c))[words].sum()) for c in ("total", "kinds"))
        counts[1] = counts[1].astype(np.int64)
        del b.text, b.words
        value = b.values(uni.value, joined(right, ID_KEYS))
        columns = [left.column("doc_id"), left.column("held_out"), *counts, score_texts(b.ids, b.edge, value, m, embedding(bits)), total, kinds]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=names)

    out = cut(dealt.groupBy("block").cogroup(come_back.groupBy("block")).applyInArrow(lambda left, right: run(left, right), RESULT))
    n, v = out.agg(F.sum("train_words"), F.sum("train_kinds")).first()
    n, v = int(n or 0), int(v or 0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))).alias("base_score"),
        "score",
    )
