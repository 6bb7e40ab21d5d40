"""Decontamination, periodic runs and centroid clusters against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import centroid_clusters, decontamination, periodic_runs
from tests.llm.test_operators import CLASHING, ODD, SCHEMA, SF001

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for c in [*CLASHING, "at", "size", "items", "spots", "q", "runs", "text_2"]:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- decontamination


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def leaks(docs, items, n=10):
    """Rows as the query gives them, and the hit words, by comparing every window."""
    out, hit_words = [], []
    for doc_id, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for item, item_text in items:
            b = alnum(item_text)
            s = min(n, len(b))
            grams = {tuple(b[i : i + s]) for i in range(len(b) - s + 1)} if s else set()
            at = [i for i in range(len(w) - s + 1) if s and tuple(w[i : i + s]) in grams]
            hit.update(i + j for i in at for j in range(s))
            if at and item is not None:
                found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
        hit_words.append(hit)
    return out, hit_words


ITEMS = [
    (1, "The first text, of a few words. The FIRST text"),
    (1, "The first text, of a few words. The FIRST text"),
    (2, "cc by"),
    (3, None),
    (4, ""),
    (5, " .,- "),
    (None, "without an id"),
    (70, "seven one two three four five six seven one two three four"),
    (8, "a"),
    (9, "nothing of this stands anywhere in those documents for sure my friend"),
]


def test_leaks_against_brute_force(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit("own")).withColumn("gram", F.lit("own"))
    got = sorted(map(tuple, decontamination.digest(odd, items).collect()), key=repr)
    want, _ = leaks([(r[0], r[1]) for r in ODD], ITEMS)
    assert got == sorted(want, key=repr)


def test_leaks_in_random_texts_with_small_hash_sets(spark):
    r = random.Random(3)
    vocabulary = "ab ba c d Éa".split()
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(60)))) for i in range(60)]
    items = [(i, "-".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 7, 9, 12])))) for i in range(2, 40)]
    want, hit = leaks(docs, items, 4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for set_bytes in (1 << 20, 700):  # one broadcast set, and several scans
        h = decontamination.hits(d, b, ["doc_id"], 4, set_bytes)
        got = {r["doc_id"]: (r["n_words"], r["items"], [tuple(x) for x in r["s"]]) for r in h.select("doc.doc_id", "n_words", "items", decontamination.stretches(F.col("spots"), 4).alias("s")).collect()}
        for (doc_id, n_words, n_hit, n_items, digest, _), words in zip(want, hit, strict=True):
            mine = got[doc_id]
            assert mine[0] == n_words and len(mine[1]) == n_items and sha(",".join(mine[1])) == digest
            assert {i for a, z in mine[2] for i in range(a, z)} == words and sum(z - a for a, z in mine[2]) == n_hit
            assert all(x[1] < y[0] for x, y in zip(mine[2], mine[2][1:], strict=False))  # whole stretches, in order
    spans = decontamination.spans(d, b, 4).collect()
    assert sorted((s["doc_id"], s["start"], s["end"]) for s in spans) == sorted((k, *x) for k, v in got.items() for x in v[2])


def test_removal(spark, odd):
    docs = [(1, "Keep this. One, two;  THREE four! And (that).\n"), (2, "one two three four"), (3, "no"), (4, None), (5, "  ..")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tags", F.create_map(F.lit("k"), F.lit("v")))
    b = spark.createDataFrame([(0, "one two three four")], "item_id long, text string")
    left = decontamination.decontaminated(d, b)
    assert left.columns == d.columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: "Keep this! And (that).\n", 2: "", 3: "no", 4: None, 5: "  .."}
    assert sorted(r["doc_id"] for r in decontamination.decontaminated(d, b, "documents").collect()) == [3, 4, 5]
    with pytest.raises(ValueError, match="remove"):
        decontamination.decontaminated(d, b, "all")
    same = decontamination.decontaminated(odd, spark.createDataFrame([], "item_id long, text string"))
    assert same.columns == odd.columns and sorted(map(repr, same.collect())) == sorted(map(repr, odd.collect()))


def test_leaks_empty(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.digest(empty, none).count() == 0
    got = decontamination.digest(odd, none).collect()
    assert len(got) == len(ODD) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in got)
    assert {r["items_sha256"] for r in got} == {sha("")}


# ---- periodic runs


def brute_runs(w, least, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


sequence = st.one_of(
    st.lists(st.integers(0, 2), max_size=90),
    st.tuples(st.lists(st.integers(0, 5), max_size=9), st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 9), st.lists(st.integers(0, 5), max_size=9)).map(lambda x: x[0] + x[1] * x[2] + x[3]),
)


@settings(max_examples=400, deadline=None)
@given(sequence, st.sampled_from([(24, 3), (4, 2), (6, 3), (12, 2), (9, 4), (1, 2)]))
def test_runs_against_brute_force(w, limits):
    want = brute_runs(w, *limits)
    assert periodic_runs.runs_of(w, *limits) == want
    # the same through the search for words that can lie in a run, among other texts
    words = np.array([9, 9, *w, 9], np.uint64)
    text = np.array([0, 0, *[1] * len(w), 2], np.int64)
    got = periodic_runs.all_runs(words, text, *limits).get(1, [])
    assert sorted([(s - 2, n, q) for s, n, q in got], key=lambda r: (r[0], r[2])) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_automaton_and_squares(w):
    link, length, state = periodic_runs.automaton(w)
    # a state's texts: lengths above its link's, ending where its prefix ends; each distinct text once
    assert sum(length[v] - length[link[v]] for v in range(1, len(link))) == len({tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
    assert [length[v] for v in state] == list(range(1, len(w) + 1))
    got = set(periodic_runs.squares(w))
    want = set()
    for end in range(len(w)):
        last = {}  # last earlier end of each text that ends here
        for size in range(1, end + 2):
            t = w[end - size + 1 : end + 1]
            for e in range(end - 1, size - 2, -1):
                if w[e - size + 1 : e + 1] == t:
                    last[size] = e
                    break
        for size, e in last.items():
            if last.get(size + 1) != e and end - e <= size:
                want.add((end, end - e, size))
    assert got == want


def digest_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(w, 24, 3)
    best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[0] if found else (None, None, None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(kept))


def test_runs_query_against_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, periodic_runs.digest(some).collect()), key=repr) == sorted([digest_row(*r) for r in rows], key=repr)
    want = [digest_row(r[0], r[1]) for r in ODD if r[0] != 8]
    got = [tuple(r) for r in periodic_runs.digest(odd).collect()]
    assert sorted([r for r in got if r[0] != 8], key=repr) == sorted(want, key=repr)
    (long,) = [r for r in got if r[0] == 8]
    assert long[1] >= 1 and long[3] >= 24
    assert periodic_runs.digest(empty).count() == 0


def test_runs_and_collapse(spark, odd):
    text = "start  here " + "a b c " * 10 + "\nend"
    d = spark.createDataFrame([(1, text), (2, "x  y"), (3, None), (4, "z " * 30)], "doc_id long, text string")
    assert sorted(map(tuple, periodic_runs.runs(d).collect())) == [(1, 2, 30, 3), (4, 0, 30, 1)]
    assert sorted(map(tuple, periodic_runs.collapsed(d).collect())) == [(1, "start here a b c end"), (2, "x  y"), (3, None), (4, "z")]
    assert periodic_runs.collapsed(odd).columns == odd.columns
    assert periodic_runs.collapsed(odd).count() == len(ODD)


# ---- centroid clusters


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), c in zip(kept, of, strict=True) if c == i] for i in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    best = [nearest(v) for _, v in kept]
    whole = [sum(d for d, c in best if c == i) for i in range(len(centroids))]
    return [(i, c, d, whole[c], sum(whole), sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, best, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, q string, cluster string, distance string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "own", "own", "own") for i, v in rows], VECTORS).repartition(parts)


def test_clusters_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding").collect()]
    odd = [(None, rows[0][1]), (rows[1][0], rows[1][1]), (rows[2][0], rows[3][1]), (-1, None), (-2, [0.5] * 63), (-3, [0.5] * 65), (-4, [0.1] * 63 + [None]), (-5, [0.1] * 63 + [float("nan")]), (-6, [float("-inf")] + [0.0] * 63), (-7, []), (-8, [0.25] * 64), (-8, [0.25] * 64)]
    want = sorted(brute_clusters(rows + odd), key=repr)
    for parts in (1, 5):
        assert sorted(map(tuple, centroid_clusters.digest(vectors(spark, rows + odd, parts)).collect()), key=repr) == want


def test_few_far_and_no_vectors(spark):
    assert centroid_clusters.digest(vectors(spark, [])).collect() == []
    two = [(1, [1.0] * 64), (2, [-1.0] * 64), (3, [1.0] * 64)]
    assert sorted(map(tuple, centroid_clusters.digest(vectors(spark, two)).collect())) == sorted(brute_clusters(two))
    far = [(i, [3e38 if i % 2 else -3e38] * 64) for i in range(9)]
    got = centroid_clusters.digest(vectors(spark, far)).collect()
    assert len(got) == 9 and all(r["distance"] >= 0 for r in got)
    q = centroid_clusters.quantized(vectors(spark, far)).first()["q"]
    assert {abs(x) for x in q} == {centroid_clusters.BOUND}


def test_language_model_scores_follow_from_the_table_alone(spark):
    from gleaner.llm import lm_scoring

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = [{r["doc_id"]: (r["score"], r["base_score"]) for r in lm_scoring.score(docs.repartition(n, "text") if n > 1 else docs.coalesce(1)).collect()} for n in (1, 3, 8)]
    for other in got[1:]:
        assert got[0].keys() == other.keys()
        for k, (score, base) in got[0].items():
            assert abs(score - other[k][0]) < 1e-3 + 1e-6 * abs(score) and abs(base - other[k][1]) < 1e-6 * (1 + abs(base))
