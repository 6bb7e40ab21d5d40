"""Near-duplicate classes by DartMinHash signatures (operator 3).

A text's elements are its distinct five-word shingles (lower-cased A-Z; a shorter text is
one shingle of all its words), each of weight one however often it occurs: the similarity
that decides does not count repeats either. Hashed darts fall on the plane of an element's
weight and time with density one; a text keeps, for each of ``DARTS`` coordinates, the
earliest dart on its elements, so two texts agree at a coordinate with the probability of
their Jaccard similarity. Darts are thrown in unit cells of time until every coordinate has
one: about k ln k darts whatever the text's length. ``BANDS`` bands of ``ROWS`` coordinates
are joined: a pair at ``SIMILARITY`` shares no bucket with a probability of 1 in 9,000.

Equal texts are one node from the start. In a band's bucket every node is compared with the
bucket's leader, the node that shares most buckets with others (a group's centre); then, in
buckets whose nodes are still in different classes, with a drawn leader of each bucket, in
``LEADER_ROUNDS`` rounds; what is left in different classes is compared with each other.
So a large group gives a few comparisons for each member, not all pairs, and no pair that
shares a bucket is left out unless its two texts are already in one class or cannot be similar: each text has
a sketch of ``PARITY`` bits, a shingle flipping one of them, so two sketches differ in at most
as many bits as the texts have shingles that are not shared, and a pair whose sketches differ
in more than the threshold admits goes before it becomes a row. Comparison is exact: Jaccard
of the distinct shingles, at least ``SIMILARITY``. Classes are the components of these links.

Defined cases: null and empty texts are equal to each other and to nothing else; equal rows
share a class; a class is named by its least doc_id (null only if all are); an empty table
gives no rows; other columns, whatever their names, pass through ``deduplicated``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from gleaner.llm.common import cut, map_columns
from gleaner.llm.textarrays import NOT_SPACE, Texts, grams, hashed, mix, slices

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
DARTS = BANDS * ROWS
PARITY = 1024
#: Poisson(1) counts by a uniform 64-bit number: at least i darts from this number on.
_POISSON = np.array([int(2**64 * p) for p in np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])], np.uint64)
_EMPTY = np.uint64(2**64 - 1)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text numbers (rising), hashes, how often each occurs."""
    low = t.lowered()
    start, end, text = low.segments(NOT_SPACE)
    words = low.hashes(start, end)
    at, h = grams(words, text, tuple(range(WORDS)))
    who = text[at]
    count = np.bincount(text, minlength=len(t))
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        # all words of a short text, each hashed with its place
        few = np.flatnonzero(count[text] < WORDS)
        first = np.searchsorted(text[few], short)
        with np.errstate(over="ignore"):
            each = hashed(words[few] + (few - np.searchsorted(text, text[few])).astype(np.uint64), 5)
            extra = mix(np.add.reduceat(each, first))
        who, h = np.concatenate([who, short]), np.concatenate([h, extra])
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    first = np.flatnonzero(new)
    return who[first], h[first], np.diff(np.append(first, len(h)))


def signatures(t: Texts, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Text by coordinate: the earliest dart (its time and identity); all ones without words.

    ``found``: the texts' shingles, where they are known already."""
    n = len(t)
    who, h, _ = shingles(t) if found is None else found
    cell = hashed(h, 3)
    total = np.bincount(who, minlength=n)
    out = np.full(n * DARTS, _EMPTY, np.uint64)
    since = np.zeros(n, np.int64)
    until = np.where(total > 0, np.ceil(DARTS * (np.log(DARTS) + 2) / np.maximum(total, 1)), 0).astype(np.int64)
    while len(who):
        span = (until - since)[who]
        time = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(since[who], span)
        spot = hashed(np.repeat(cell, span) ^ (time.astype(np.uint64) << np.uint64(20)), 9)
        darts = np.searchsorted(_POISSON, spot, "right")
        hit = np.flatnonzero(darts)
        many = darts[hit]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        source = np.repeat(hit, many)
        value = hashed(spot[source] + nth.astype(np.uint64), 17)
        place = (value & np.uint64(0xFFFFFF)) % np.uint64(DARTS)
        stamp = (time[source].astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24))
        text = np.repeat(who, span)[source]
        np.minimum.at(out, text * DARTS + place.astype(np.int64), stamp)
        bare = (out.reshape(n, DARTS) == _EMPTY).any(axis=1) & (total > 0)
        more = bare[who]
        who, cell = who[more], cell[more]
        since, until = until, 2 * until + 1
    return out.reshape(n, DARTS)


def parities(n: int, who: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Text by 64-bit word of its sketch: each distinct shingle flips one bit."""
    bit = hashed(h, 31) & np.uint64(PARITY - 1)
    out = np.zeros(n * (PARITY // 64), np.uint64)
    np.bitwise_xor.at(out, who * (PARITY // 64) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def buckets(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text by band: a 64-bit bucket; which texts have words; sketches; distinct shingles."""
    found = shingles(t)
    s = signatures(t, found)
    who, h, _ = found
    has = s[:, 0] != _EMPTY
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(t), axis=0)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + s[:, r::ROWS])
    return key.view(np.int64), has, parities(len(t), who, h), np.bincount(who, minlength=len(t))


def node(text: Column | None = None) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text") if text is None else text, F.lit(""))))


def signed(docs: DataFrame) -> DataFrame:
    """(node, doc_id, buckets, sketch, n): one row for each distinct text, with its least id."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lists, sketches, sizes = [], [], []
        for t in slices(batch.column("text")):
            key, has, sketch, n = buckets(t)
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)), pa.array(key[has].reshape(-1))))
            sketches.append(pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * (PARITY // 64)), pa.array(sketch)))
            sizes.append(pa.array(n.astype(np.int64)))
        none = pa.array([], pa.list_(pa.int64()))
        return {
            "buckets": pa.concat_arrays(lists) if lists else none,
            "sketch": pa.concat_arrays(sketches) if sketches else none,
            "n": pa.concat_arrays(sizes) if sizes else pa.array([], pa.int64()),
        }

    base = docs.select(node().alias("node"), "doc_id", "text")
    made = [StructField("buckets", ArrayType(LongType())), StructField("sketch", ArrayType(LongType())), StructField("n", LongType())]
    each = map_columns(base, run, made, ["node", "doc_id"], ["text"])
    return each.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c.name).alias(c.name) for c in made])


def may_match(threshold: float = SIMILARITY) -> Column:
    """Whether texts with sketches ka, kb and na, nb shingles can have that similarity.

    With d shingles not shared, the union is (na + nb + d) / 2, so the similarity is at least
    the threshold only where d <= (na + nb) * (1 - threshold) / (1 + threshold).
    """
    differ = sum((F.bit_count(F.get("ka", F.lit(i)).bitwiseXOR(F.get("kb", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    return (differ * (1 + threshold) <= (F.col("na") + F.col("nb")) * (1 - threshold) + 1e-6) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-6)


def possible(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches do not rule them out."""
    one, two = (sig.select(F.col("node").alias(c), F.col("sketch").alias("k" + c), F.col("n").alias("n" + c)) for c in "ab")
    return cut(pairs.join(one, "a").join(two, "b").filter(may_match()).select("a", "b"))


#: Bits of the set that lets only wanted texts through to the comparison; 1 MB at most.
FILTER_BITS = 1 << 23


def bits_of(nodes: DataFrame) -> np.ndarray:
    """A set of the nodes' hashes in FILTER_BITS bits, aggregated in pieces of 4 KB."""
    h = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)) + 1
    rows = nodes.groupBy(F.bitmap_bucket_number(h).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] = part
    return out


def similar(pairs: DataFrame, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose distinct shingles have at least that Jaccard similarity."""

    def own(batch: pa.RecordBatch) -> tuple[dict[str, pa.Array], pa.Array]:
        at = np.asarray(batch.column("bit"), np.int64)
        asked = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        out: list[bytes | None] = [None] * len(batch)
        places = np.flatnonzero(asked)
        for t in slices(batch.column("text").filter(pa.array(asked))):
            who, h, _ = shingles(t)
            edge = np.searchsorted(who, np.arange(len(t) + 1))
            for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                out[places[t.first + i]] = h[a:b].tobytes()
        return {"sh": pa.array(out, pa.binary())}, pa.array(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def get(name: bytes, raw: pa.BinaryScalar) -> np.ndarray:
            if name not in known:
                known[name] = np.frombuffer(raw.as_py(), np.uint64)
                if len(known) > 32:
                    known.popitem(last=False)
            return known[name]

        for batch in batches:
            a, b, sa, sb = (batch.column(c) for c in ("a", "b", "sa", "sb"))
            keep = []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
                one, two = get(x, sa[i]), np.frombuffer(sb[i].as_py(), np.uint64)
                small, large = (one, two) if len(one) <= len(two) else (two, one)
                same = 0
                if len(small) and len(small) >= threshold * len(large):
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    same = int((large[at] == small).sum())
                keep.append(same >= threshold * (len(one) + len(two) - same) and same > 0)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    bits = bits_of(wanted)
    texts = docs.select(node().alias("node"), "text").withColumn("bit", F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)))
    made = map_columns(texts, own, [StructField("sh", BinaryType())], ["node"], ["bit", "text"])
    sets = cut(made.groupBy("node").agg(F.first("sh").alias("sh")).join(wanted, "node", "left_semi"))
    one, two = (sets.select(F.col("node").alias(k), F.col("sh").alias("s" + k)) for k in "ab")
    return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): for every node with a link, the least node it is connected to.

    Each round takes the least label around, then jumps to that label's own label, so long
    paths shorten by half; tables are cut so that no round repeats the ones before.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
    while not label.isEmpty():
        near = both.join(label.withColumnsRenamed({"node": "v", "comp": "c"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        least = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        root = label.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = cut(least.join(root, "comp", "left").select("node", "was", F.least("comp", F.coalesce("root", "comp")).alias("comp")))
        if new.filter(F.col("was") != F.col("comp")).isEmpty():
            return new.select("node", "comp")
        label = new.select("node", "comp")
    return label


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, doc_id) of all distinct texts, and (node, comp) of those with a link."""
    sig = cut(signed(docs))
    placed = sig.select("node", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    members = cut(placed.join(shared, "bucket"))
    popular = members.groupBy("node").agg(F.sum("size").alias("shares"))
    ranked = members.join(popular, "node")
    leader = ranked.groupBy("bucket").agg(F.max(F.struct("shares", "node")).alias("top")).select("bucket", F.col("top.node").alias("a"))
    stars = cut(members.join(leader, "bucket").filter(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct())
    links = similar(possible(stars, sig), docs)
    comp = components(links)
    # further leaders, another in each bucket and round, for buckets that hold several classes yet
    for turn in range(LEADER_ROUNDS):
        open_members = cut(unsettled(members, comp))
        if open_members.isEmpty():
            return sig.select("node", "doc_id"), comp
        luck = F.xxhash64(F.lit(turn), F.col("bucket"), F.col("node"))
        lead = open_members.groupBy("bucket").agg(F.max_by(F.struct("node", "comp"), luck).alias("l")).select("bucket", F.col("l.node").alias("a"), F.col("l.comp").alias("ca"))
        tried = cut(open_members.join(lead, "bucket").filter(F.col("comp") != F.col("ca")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
        links = cut(links.union(similar(possible(tried, sig), docs)))
        comp = components(links)
    # what is left is compared in full: nodes of one bucket that are in different classes
    left = cut(unsettled(members, comp).join(sig.select("node", "buckets", "sketch", "n"), "node"))
    more = cut(open_pairs(left).select("a", "b"))
    if not more.isEmpty():
        found = similar(more, docs)
        if not found.isEmpty():
            comp = components(links.union(found))
    return sig.select("node", "doc_id"), comp


LEADER_ROUNDS = 1
#: Open texts of a bucket in a block of the last comparison: a task's tests of one key are its square at most, about.
BLOCK = 256


def open_pairs(left: DataFrame, size: int = BLOCK) -> DataFrame:
    """The pairs (a, b) of different classes in a bucket that the sketches admit, each from the least bucket it shares.

    A bucket's nodes are dealt to blocks of about ``size`` by hash, and block meets block under a
    key of its own, so no bucket's pairs are tested in one task.
    """
    many = left.groupBy("bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = left.join(many, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    row = F.struct("node", "comp", "buckets", "sketch", "n")
    x = dealt.select("bucket", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), row.alias("x"))
    y = dealt.select("bucket", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), row.alias("y"))
    x, y = (d.select("bucket", "i", "j", *[F.col(f"{c}.{f}").alias(k + n) for f, k in (("node", ""), ("comp", "c"), ("buckets", "l"), ("sketch", "k"), ("n", "n"))]) for d, c, n in ((x, "x", "a"), (y, "y", "b")))
    once = F.array_min(F.array_intersect("la", "lb")) == F.col("bucket")
    found = x.join(y, ["bucket", "i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & (F.col("ca") != F.col("cb")) & may_match() & once)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bucket", "i", "j")


def unsettled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(bucket, node, comp) of the buckets whose nodes are in more than one class."""
    now = members.select("bucket", "node").join(comp, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    several = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(F.col("lo") != F.col("hi")).select("bucket")
    return now.join(several, "bucket", "left_semi")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): one row per document; the class is named by its least doc_id."""
    nodes, comp = classes(docs)
    named = nodes.join(comp, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    of = named.select("node", "comp").join(least, "comp").select("node", "class_id")
    return docs.select("doc_id", node().alias("node")).join(of, "node").select("doc_id", "class_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id, with its own columns only."""
    nodes, comp = classes(docs)
    in_class = nodes.join(comp, "node")
    first = in_class.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("one")).select(F.col("one.node").alias("node"))
    gone = comp.select("node").join(first, "node", "left_anti")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    one = docs.select(node().alias("__node"), F.col("doc_id").alias("__id"), row.alias("d")).groupBy("__node").agg(F.min_by("d", F.struct("__id")).alias("d"))
    return one.join(gone, one["__node"] == gone["node"], "left_anti").select(*[F.col(f"d.c{i}").alias(c) for i, c in enumerate(docs.columns)])
