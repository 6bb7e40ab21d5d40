"""Benchmark decontamination (operator 11), in DataFrame operations only.

Every benchmark item gives its windows of ``N`` consecutive normalised words (an item of
fewer words is one window). Windows are hashed, and the hash set is broadcast: its size is
measured first, and a set above ``SET_BYTES`` is dealt by hash into parts below it, each
with its own scan of the texts. A text's words are an array made once; the scan generates
one row per place, hashes the words that begin there inside the same code-generated stage,
and probes the set, so no place leaves the task that reads it unless its hash is in the set.
Hits are verified by the words themselves. One row per text (its word count) goes through
the scan besides, so texts without hits need no second pass; only verified hits and those
rows are shuffled, by a row number, after hits of one text are combined in their task.

``spans`` gives stretches of hit words, ``decontaminated`` removes them or whole documents.

Defined cases: a null or empty text, or one without words, has no hits; items without words
have no windows; equal item_ids are one item, and a null item_id marks words without being
counted or listed; repeated documents are scanned each for itself; an empty table of
documents gives no rows, an empty benchmark no hits; other columns are not read, and
``decontaminated`` passes them through whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

N = 10
#: The largest hash set, with its words, that is broadcast at once.
SET_BYTES = 64 << 20
#: What a row of the set takes besides its words.
ROW_BYTES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in a text that still has its capitals, with what stands before it; last what follows all words.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++|\z)"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SPLIT), "")


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(h, size, gram, items): each distinct window, and the items that hold it."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    first = w.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    gram = F.slice("w", F.col("at"), F.col("size"))
    return (
        first.select("item", "size", gram.alias("gram"))
        .groupBy("size", "gram")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("hs", _word_hashes(F.col("gram")))
        .select(_hash(F.col("hs"), F.lit(0), n).alias("h"), "size", "gram", "items")
    )


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _hash(hs: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from place ``at``, of the words' hashes; places past the end add nothing to it."""
    return F.xxhash64(*[F.get(hs, at + j) for j in range(size)])


def _probes(base: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per place and window size with the window's hash, and per text one row at -1 without."""
    places = base.withColumn("at", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)))
    inside = lambda s: (F.col("at") >= 0) & (F.col("at") + s <= F.size("w"))
    one = lambda s: F.when(inside(s), _hash(F.col("hs"), F.col("at"), s))
    if len(sizes) <= 1:
        s = sizes[0] if sizes else 0
        return places.withColumn("size", F.lit(s)).withColumn("h", one(s) if s else F.lit(None).cast("long"))
    probe = F.array(*[F.struct(F.lit(s).alias("size"), one(s).alias("h")) for s in sizes])
    flat = places.withColumn("probe", F.explode(F.when(F.col("at") < 0, F.slice(probe, 1, 1)).otherwise(probe)))
    return flat.select(*places.columns, F.col("probe.size").alias("size"), F.col("probe.h").alias("h"))


def hits(docs: DataFrame, benchmark: DataFrame, carry: list[str], n: int = N, set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per document: ``doc`` (struct of ``carry``), n_words, ``spots`` (at, size; in order), ``items``."""
    grams = windows(benchmark, n)
    width = F.sum(F.lit(ROW_BYTES) + F.octet_length(F.concat_ws(" ", "gram")) + F.octet_length(F.concat_ws(" ", "items")))
    measured = grams.groupBy("size").agg(width.alias("b")).collect()  # a row per window size: n at most
    sizes = sorted(r["size"] for r in measured)
    parts = max(1, -(-sum(r["b"] for r in measured) // set_bytes))
    kept = F.struct(*[F.col(f"`{c}`") for c in carry])
    base = docs.select(kept.alias("doc"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("rid"))
    if parts > 1:  # several scans: row numbers must be the same in each
        base = cut(base)
        grams = cut(grams)
    base = base.select("rid", "doc", words(F.col("text")).alias("w")).withColumn("hs", _word_hashes(F.col("w")))

    def scan(part: int) -> DataFrame:
        own = (F.col("at") < 0) if part == 0 else F.lit(False)
        mine = grams if parts == 1 else grams.filter(F.pmod(F.col("h"), F.lit(parts)) == part)
        g = F.broadcast(mine.select(F.col("h").alias("gh"), "gram", "items"))
        gram = F.slice("w", F.col("at") + 1, F.col("size"))
        same = (gram <= F.col("gram")) & (gram >= F.col("gram"))  # an equality would become a key, made at every place
        got = _probes(base, sizes).join(g, (F.col("h") == F.col("gh")) & same, "left").filter(F.col("gh").isNotNull() | own)
        return got.select(
            "rid",
            F.when(own, F.col("doc")).alias("doc"),
            F.when(own, F.size("w")).cast("long").alias("n_words"),
            F.when(F.col("gh").isNotNull(), F.struct("at", "size")).alias("spot"),
            "items",
        )

    found = reduce(DataFrame.unionByName, [scan(k) for k in range(parts)])
    return found.groupBy("rid").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("spot")).alias("spots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def stretches(spots: Column, n: int = N) -> Column:
    """Array of (start, end) of the words that ordered spots cover, each stretch once.

    Of the spots at one place the longest counts; a spot then reaches at most ``n`` places
    back, so whether a stretch begins or ends at it is told from ``n`` neighbours.
    """
    longest = F.filter(spots, lambda x, j: F.get(spots, j + 1).isNull() | (F.get(spots, j + 1)["at"] != x["at"]))

    def ends(s: Column) -> Column:
        reach = lambda j: F.greatest(*[F.get(s, j - k)["at"] + F.get(s, j - k)["size"] for k in range(n)], F.lit(0))
        begins = F.filter(s, lambda x, j: (j == 0) | (reach(j - 1) < x["at"]))
        marked = F.transform(s, lambda x, j: F.struct((F.get(s, j + 1).isNull() | (reach(j) < F.get(s, j + 1)["at"])).alias("last"), reach(j).alias("end")))
        closes = F.filter(marked, lambda x: x["last"])
        return F.zip_with(begins, closes, lambda b, c: F.struct(b["at"].alias("start"), c["end"].alias("end")))

    # a one-element transform names the filtered array, so that it is made once a row
    return F.get(F.transform(F.array(longest), ends), F.lit(0))


def spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Stretches of hit words: doc_id, start and end (words, end outside)."""
    h = hits(docs, benchmark, ["doc_id"], n).select("doc.doc_id", F.explode(stretches(F.col("spots"), n)).alias("s"))
    return h.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def _n_hit(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = N) -> DataFrame:
    """``docs`` without hit words (``remove="spans"``) or without documents that have any
    (``remove="documents"``). A removed word takes what stands between it and the word before along;
    all other characters stay as they are. Columns are those of ``docs``."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    h = hits(docs, benchmark, docs.columns, n)
    if remove == "documents":
        return h.filter(F.size("spots") == 0).select("doc.*")
    found = h.select("doc", stretches(F.col("spots"), n).alias("found"), F.regexp_extract_all(F.col("doc")["text"], F.lit(_PIECE), F.lit(0)).alias("pieces"))
    # between the stretches: from the end of the one before to the start of the next
    borders = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col("found"))
    gaps = F.transform(borders, lambda s, j: F.struct(s["end"].alias("start"), F.coalesce(F.get("found", j)["start"], F.size("pieces")).alias("end")))
    left = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice("pieces", g["start"] + 1, F.greatest(g["end"] - g["start"], F.lit(0))))), "")
    text = F.when(F.size("found") == 0, F.col("doc")["text"]).otherwise(left)
    return found.select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    h = hits(docs, benchmark, ["doc_id"])
    return h.select(
        "doc.doc_id",
        "n_words",
        _n_hit(stretches(F.col("spots"))).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spots") > 0).alias("contaminated"),
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL: every window of every text compared with every item's, words counted singly.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item_id, w[p + 1:p + s] AS gram FROM (SELECT *, least({N}, len(w)) AS s, unnest(range(0, len(w) - least({N}, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
p AS (SELECT rid, s, p, w[p + 1:p + s] AS gram FROM (SELECT rid, w, s, unnest(range(0, greatest(len(w) - s + 1, 0))) AS p FROM d, (SELECT DISTINCT len(gram) AS s FROM g))),
m AS MATERIALIZED (SELECT rid, p, s, item_id FROM p JOIN g USING (gram)),
n AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(p, p + s)) AS word FROM m) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""
