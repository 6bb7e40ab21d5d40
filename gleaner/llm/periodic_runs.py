"""Periodic run detection by a suffix automaton with link-cut access (operator 12).

A run is a stretch of consecutive words with smallest period q that no neighbour extends,
at least ``LEAST`` words and ``TIMES`` periods long. Its method:

* The words of a stretch are put into a suffix automaton, one state a prefix and clones.
* The words are then appended once more, in order: the path from a prefix's state to the
  root is accessed and takes the new end as its colour, as preferred paths of a link-cut
  tree do. Every state has the colour of the last place where its texts ended. The path
  meets segments of one colour each: the longest text of a segment, ``size`` words, ended at
  ``colour`` before and ends at the new place now, so their distance d is a period of the
  last ``size + d`` words, and a square if d <= size. No smaller distance fits them, as the
  colour is the last end.
* A square is extended to its run: to the left ``size`` is the longest already; to the right
  it is a run at the word after which the period breaks.

Recolouring is amortised O(log n) segments a word. The access goes along heavy paths, each
holding its segments as a stack, in place of splay trees: the tree is whole by then, and
what is recoloured is always the upper part of a path.

Only words that can lie in a run reach the automaton. A run holds the same ``REACH`` words at
i and i + q for L - q - REACH + 1 neighbouring places i, so a word that no repeated
``REACH``-gram covers, or only one whose next copy is further than its whole stretch of
repeats allows, is in no run. That is found by sorting hashes of a batch's grams.

Words are compared by 64-bit hashes. Each text is worked on in its own task, by batches of about one
megabyte; nothing is shuffled.

Defined cases: a null or empty text, or one of white space, has no words and no runs (hashes
of the empty string); a null doc_id hashes as the empty text; repeated rows are each worked
on; an empty table gives no rows; very long texts go through whole; in ``collapsed`` extra columns
pass through, in the other functions they are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from gleaner.llm.common import map_columns
from gleaner.llm.textarrays import NOT_SPACE, Texts, keyed, mix, slices

LEAST = 24
TIMES = 3


def reach(least: int, times: int) -> int:
    """Words that every run holds both at i and at i + q for some i: the least L - q."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of ``ids``: links and lengths of the states, the state of each prefix.

    Nearly all states have one way out; it is kept in two lists, further ones in ``more``."""
    link, length, state = [-1], [0], []
    sym, to = [-1], [0]
    more: dict[int, dict[int, int]] = {}
    last = 0
    for c in ids:
        cur = len(length)
        length.append(length[last] + 1)
        sym.append(-1)
        to.append(0)
        link.append(0)
        state.append(cur)
        p, q = last, -1
        while p != -1:
            if sym[p] == c:
                q = to[p]
                break
            if sym[p] == -1:
                sym[p], to[p] = c, cur
            else:
                ways = more.get(p)
                if ways is None:
                    more[p] = {c: cur}
                elif c in ways:
                    q = ways[c]
                    break
                else:
                    ways[c] = cur
            p = link[p]
        if q != -1:
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                sym.append(sym[q])
                to.append(to[q])
                if q in more:
                    more[copy] = dict(more[q])
                while p != -1:
                    if sym[p] == c:
                        if to[p] != q:
                            break
                        to[p] = copy
                    else:
                        ways = more.get(p)
                        if ways is None or ways.get(c) != q:
                            break
                        ways[c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return link, length, state


def heavy_tops(link: list[int], length: list[int]) -> list[int]:
    """For each state the uppermost state of its heavy path; the root has a path of its own."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    weight = [1] * len(link)
    heavy = [0] * len(link)
    for v in reversed(order):
        if v:
            p = link[v]
            weight[p] += weight[v]
            if not heavy[p] or weight[v] > weight[heavy[p]]:
                heavy[p] = v
    top = list(range(len(link)))
    for v in order:
        p = link[v] if v else 0
        if p and heavy[p] == v:
            top[v] = top[p]
    return top


def squares(ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, distance, size): the longest texts that end at ``end`` and ended ``distance`` before, for
    each recoloured segment with distance <= size."""
    link, length, state = automaton(ids)
    top = heavy_tops(link, length)
    paths: dict[int, list[tuple[int, int]]] = {}  # by top: (length of the deepest state, colour), uppermost last
    for end, v in enumerate(state):
        seen = -1  # colour of the uppermost segment of the path below, which may go on in this one
        while v:
            t = top[v]
            deep = length[v]
            stack = paths.get(t)
            if stack is None:
                paths[t] = [(deep, end)]
                seen = -1
            else:
                upper = stack[-1][1]
                size = 0
                while stack and stack[-1][0] <= deep:
                    size, colour = stack.pop()
                    if end - colour <= size and colour != seen:
                        yield end, end - colour, size
                if size < deep and stack and end - stack[-1][1] <= deep and stack[-1][1] != seen:
                    yield end, end - stack[-1][1], deep
                stack.append((deep, end))
                seen = upper
            v = link[t]


def runs_of(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word sequence, by start, then period."""
    n = len(ids)
    found = []
    for end, d, size in squares(ids):
        whole = size + d
        if whole >= least and whole >= times * d and (end + 1 == n or ids[end + 1] != ids[end + 1 - d]):
            found.append((end - whole + 1, whole, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def covered(words: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Which words may lie in a run: a superset, found by sorting the hashes of ``reach`` words."""
    k = reach(least, times)
    n = len(words) - k + 1
    inside = np.zeros(len(words), bool)
    if n <= 0:
        return inside
    gram, width = words, 1
    with np.errstate(over="ignore"):
        while width < k:  # a gram twice as wide of two that may overlap
            step = min(width, k - width)
            gram = mix(gram[: len(gram) - step] * np.uint64(0x9FB21C651E98DF25) + gram[step:] + np.uint64(step))
            width += step
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    key = keyed(text[at], gram[at])
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    here, there = at[order[same]], at[order[same + 1]]  # a gram and its next copy in the same text
    for place in (here, there):
        by = np.argsort(place)
        place, gap = place[by], (there - here)[by]
        while len(place):
            new = np.ones(len(place), bool)
            new[1:] = np.diff(place) != 1
            run = np.cumsum(new) - 1
            many = np.bincount(run)[run]
            keep = gap <= (many + k - 1) // (times - 1)
            if keep.all():
                break
            place, gap = place[keep], gap[keep]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + k, -1)
        inside |= np.cumsum(step[:-1]) > 0
    return inside


def all_runs(words: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """By text number: (start among all words, length, period) of every run."""
    inside = covered(words, text, least, times)
    new = np.ones(len(words) + 1, bool)
    new[1:-1] = (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    edges = np.flatnonzero(new)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if inside[a] and b - a >= least:
            ids = np.unique(words[a:b], return_inverse=True)[1].tolist()
            if got := runs_of(ids, least, times):
                out.setdefault(int(text[a]), []).extend((a + s, length, q) for s, length, q in got)
    return out


def repeated_tail(n: int, h: int) -> np.ndarray | None:
    """The query's edit: the original word at each place, or None for a text that stays as it is."""
    if n == 0 or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


class Worked:
    """The words of a slice's texts (after an edit by ``hashes``), their runs and what is kept."""

    def __init__(self, t: Texts, edits: list[int] | None, least: int = LEAST, times: int = TIMES) -> None:
        self.t = t
        self.start, self.end, self.text = t.segments(NOT_SPACE)
        self.first = np.searchsorted(self.text, np.arange(len(t) + 1))
        self.source = np.arange(len(self.start))
        self.changed = np.zeros(len(t), bool)
        for i in np.flatnonzero(np.array(edits or [], np.int64) % 10 == 0) if edits else ():
            lo, hi = self.first[i], self.first[i + 1]
            if (moved := repeated_tail(int(hi - lo), edits[i])) is not None:
                self.source[lo:hi] = lo + moved
                self.changed[i] = True
        words = t.hashes(self.start, self.end)[self.source] if len(self.start) else np.zeros(0, np.uint64)
        self.runs = all_runs(words, self.text, least, times)
        self.kept = np.ones(len(self.source), bool)
        for i, got in self.runs.items():
            for s, length, q in got:
                self.kept[s + q : s + length] = False
            self.changed[i] = True
        # every text's words with one space between them: word bytes, and the first byte after a word that is not the last
        keep = NOT_SPACE[t.data]
        gaps = self.end[:-1][self.text[:-1] == self.text[1:]]
        keep[gaps] = True
        data = t.data.copy()
        data[gaps] = 32
        self._plain = data[keep].tobytes()
        total = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        self._at = total[t.offsets]
        self._raw = t.data.tobytes() if self.changed.any() else b""

    def local(self, i: int) -> list[tuple[int, int, int]]:
        """Runs of text ``i``, places counted from its first word."""
        return [(s - int(self.first[i]), length, q) for s, length, q in self.runs.get(i, [])]

    def joined(self, i: int) -> bytes:
        """The kept words of text ``i``, joined by one space."""
        if not self.changed[i]:
            return self._plain[self._at[i] : self._at[i + 1]]
        lo, hi = self.first[i], self.first[i + 1]
        which = self.source[lo:hi][self.kept[lo:hi]]
        return b" ".join([self._raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)])


_RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """A row per run: doc_id, start (word), length, period (words)."""

    def fn(b: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for t in slices(b.column(0)):
            w = Worked(t, None, least, times)
            out += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in w.local(i)] for i in range(len(t))]
        return {"runs": pa.array(out, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))}

    got = map_columns(docs, fn, [StructField("runs", ArrayType(_RUN))], ["doc_id"], ["text"])
    return got.select("doc_id", F.inline("runs"))


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with every run cut to its first period; texts without a run stay as they are."""

    def fn(b: pa.RecordBatch) -> dict[str, pa.Array]:
        old = b.column(0).to_pylist()
        out = []
        for t in slices(b.column(0)):
            w = Worked(t, None, least, times)
            out += [w.joined(i).decode() if i in w.runs else old[t.first + i] for i in range(len(t))]
        return {"text": pa.array(out, pa.string())}

    return map_columns(docs, fn, [StructField("text", StringType())], docs.columns, ["text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    fields = ["n_runs", "start", "length", "period", "exponent_milli"]

    def fn(b: pa.RecordBatch) -> dict[str, pa.Array]:
        hashes = [zlib.crc32(b"" if d is None else str(d).encode()) for d in b.column(0).to_pylist()]
        rows: list[tuple] = []
        for t in slices(b.column(1)):
            w = Worked(t, hashes[t.first : t.first + len(t)])
            for i in range(len(t)):
                got = w.local(i)
                best = min(got, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if got else (None, None, None)
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in got)
                milli = 1000 * best[1] // best[2] if got else None
                rows.append((len(got), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(w.joined(i)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        made = {n: pa.array(c, pa.int64()) for n, c in zip(fields, columns, strict=False)}
        return made | {n: pa.array(c, pa.string()) for n, c in zip(("runs_sha256", "collapsed_sha256"), columns[5:], strict=True)}

    schema = [StructField(n, LongType()) for n in fields] + [StructField(n, StringType()) for n in ("runs_sha256", "collapsed_sha256")]
    return map_columns(docs, fn, schema, ["doc_id"], ["doc_id", "text"])


#: DuckDB SQL: all pairs of equal words of a text by distance, stretches of neighbouring pairs, the smallest distance of equal stretches.
ORACLE = rf"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
e AS (SELECT rid, doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS edit, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN edit THEN g % n END AS a FROM e),
p AS (SELECT *, CASE WHEN edit THEN 1 + (n - a) // (3 + g % 8) END AS p FROM f),
w AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN edit THEN list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w FROM p),
x AS MATERIALIZED (SELECT rid, n, unnest(w) AS w, unnest(range(n)) AS i FROM w),
m AS (SELECT l.rid, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.rid = r.rid AND l.w = r.w AND r.i > l.i AND {TIMES} * (r.i - l.i) <= l.n),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS z FROM m) GROUP BY rid, q, z HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)),
r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM s GROUP BY ALL),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, i FROM (SELECT rid, unnest(range(start + period, start + length)) AS i FROM r)),
c AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN c USING (rid)
"""
