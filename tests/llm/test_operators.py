"""Operators against brute force on small inputs, and the defined odd cases of each."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import fingerprints, html_template, licenses, lm_scoring, mixing, near_duplicates, packing, quality_classifier, quality_rules, toxicity
from gleaner.llm.textarrays import ALNUM, NOT_SPACE, Texts, slices

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Every odd case at once: nulls, empty texts, ties, repeated rows, white space only, a very long word and text.
ODD = [
    (1, "The first text, of a few words.\nThe first text.", "en", "src0", 10, "x"),
    (1, "The first text, of a few words.\nThe first text.", "en", "src0", 10, "x"),
    (1, "Another text with the same id", None, "src0", None, None),
    (None, "text without an id", "en", None, 3, "y"),
    (None, None, None, None, None, None),
    (4, None, "de", "src1", 0, ""),
    (5, "", "de", "src1", 0, ""),
    (6, " \t\r\n \x0b\x0c", "fr", "src2", 6, "z"),
    (7, "é" * 30000, "fr", "src2", 30000, "z"),
    (8, "one two three four five six seven " * 9000, "en", "src2", 5, "z"),
    (9, "a", "en", "src3", 1, "z"),
    (-3, "Released under the MIT License. CC BY-NC 4.0 and cc by nc <|endoftext|> \x85 \U0001f600", "en", "src3", 1, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
#: Names that operators also make or use.
CLASHING = ["score", "Quality", "fail_bits", "part", "node", "block", "tokens", "start", "budget", "h", "word", "d", "rid"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (8, None, 1), (None, 1, 1), (9, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\r\x0bé.A9\U0001f600", max_size=30), max_size=8))
def test_segments_are_those_of_the_patterns(texts):
    column = pa.array(texts, pa.string())
    for size in (1, 7, 1 << 20):
        got, lines, alnum, hashes = [], [], [], {}
        for t in slices(column, size):
            raw = t.data.tobytes()
            for table, to in ((NOT_SPACE, got), (ALNUM, alnum)):
                s, e, w = t.segments(table)
                to += [(t.first + k, raw[a:b].decode()) for a, b, k in zip(s, e, w)]
            s, e, w = t.lines()
            lines += [(t.first + k, raw[a:b].decode()) for a, b, k in zip(s, e, w)]
            for (k, x), h in zip([(k, raw[a:b]) for a, b, k in zip(s, e, w)], t.hashes(s, e).tolist()):
                assert hashes.setdefault(x, h) == h
        assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]
        assert alnum == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
        assert [x for x in lines if x[1]] == [(i, x) for i, t in enumerate(texts) for x in t.split("\n") if x]
        assert len(set(hashes.values())) == len(hashes)


# --- quality rules -------------------------------------------------------------------


def brute_rules(t):
    t = t or ""
    w = words(t)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    rep = {p + d for p in range(len(w) - 2) if seen[tuple(w[p : p + 3])] > 1 for d in range(3)}
    before, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in before
            before.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep))


def test_rules_match_brute_force(spark, odd, docs):
    for df in (odd, docs):
        want = collections.Counter((r["doc_id"], *brute_rules(r["text"])) for r in df.select("doc_id", "text").collect())
        rows = quality_rules.digest(df).collect()
        assert collections.Counter(tuple(r)[:6] for r in rows) == want
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert r["kept"] == (r["fail_bits"] == 0)


def test_rule_ablation(docs):
    led = quality_rules.ledger(docs).collect()
    bits = list(quality_rules.RULES)
    failed = [{b for i, b in enumerate(bits) if r["fail_bits"] >> i & 1} for r in led]
    got = {r["rule"]: (r["fails"], r["fails_alone"]) for r in quality_rules.ablation(quality_rules.ledger(docs), "v1").collect()}
    assert got == {b: (sum(b in f for f in failed), sum(f == {b} for f in failed)) for b in bits}


# --- classifiers ---------------------------------------------------------------------


@pytest.mark.parametrize("make,label", [(toxicity.digest, "toxic"), (quality_classifier.digest, "quality")])
def test_classifiers_on_held_out_rows(spark, make, label):
    d, lab = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rows = make(d, lab).join(lab.select("doc_id", label), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) > 0.93 * len(held)
    good = [r["score"] for r in held if r[label] == 1]
    bad = [r["score"] for r in held if r[label] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.85


@pytest.mark.parametrize("make", [toxicity.digest, quality_classifier.digest])
def test_classifiers_odd_cases(spark, odd, empty, labels, make):
    rows = make(odd, labels).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in ODD)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    none = labels.filter("doc_id = -99")
    assert len(make(odd, none).collect()) == len(ODD)
    assert make(empty, labels).count() == 0
    kept = quality_classifier.keep_good(odd, labels)
    assert kept.columns == odd.columns


def test_convolution_covers_every_byte():
    m = quality_classifier.start_weights()
    t = Texts.of(["x" * 1000 + "needle" + "x" * 700, "", "abc", "q" * 512])
    pool, text = quality_classifier.pooled(t, m["conv"])
    raw = t.data[t.offsets[0] : t.offsets[1]].astype(int)
    w = quality_classifier.WIDTH
    full = sum(m["conv"][k][raw[k : len(raw) - w + 1 + k]] for k in range(w))
    assert np.allclose(pool[text == 0].max(axis=0), np.maximum(0, full.max(axis=0)), atol=1e-5)
    assert not pool[text == 1].any() and not pool[text == 2].any()


def test_training_reads_every_chunk():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(448 * 40))
    models = set()
    for middle in ("", "ZQ" * 150):
        at = 448 * 4 + 100
        sample = [(1, text[:at] + middle + text[at + len(middle) :], 1), (2, text, 0), (3, "short text", 0)]
        models.add(quality_classifier.train(pa.table({"doc_id": [r[0] for r in sample], "text": [r[1] for r in sample], "y": [r[2] for r in sample]})))
    assert len(models) == 2


# --- near-duplicates -----------------------------------------------------------------


def shingle_set(t):
    w = words((t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or same and same >= 0.8 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return groups.values()


@pytest.fixture(scope="module")
def near(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id < 80").collect()]
    rng = np.random.default_rng(3)
    base = rows[7][1].split(" ")
    for k in range(60):  # a centre and copies that are closer to it than to each other
        w = list(base)
        for p in rng.choice(len(w), max(1, len(w) // 60), replace=False):
            w[p] = f"changed{k}x{p}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, rows[9][1]) for k in range(20)] + [(3000, "four words only here"), (3001, "FOUR words only here"), (3002, ""), (3003, None)]
    return rows


def test_classes_match_brute_force(spark, near):
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.digest(df).collect()}
    assert got == {i: min(x for x, _ in g) for g in brute_classes(near) for i, _ in g}
    kept = near_duplicates.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_signature_agreement_is_the_similarity():
    rng = np.random.default_rng(0)
    w = [f"w{x}" for x in rng.integers(0, 10**6, 3000)]
    other = list(w)
    for p in range(0, 3000, 60):
        other[p] = "z"
    s = near_duplicates.signatures(Texts.of([" ".join(w), " ".join(other), "other words stand in this text here"]))
    a, b = shingle_set(" ".join(w)), shingle_set(" ".join(other))
    assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.12
    assert (s[0] == s[2]).sum() == 0


def test_pasted_texts_are_one_class(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    rows = [(10 * i + k, " ".join([t] * k)) for i, t in enumerate(texts) for k in (1, 2, 4, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates.digest(df).collect()} == {i: i // 10 * 10 + 1 for i, _ in rows}


def test_near_duplicates_odd_cases(odd, empty):
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in near_duplicates.digest(odd).collect())
    assert got[(1, 1)] == 3 and got[(4, 4)] == 1 and got[(5, 4)] == 1 and got[(None, 4)] == 1
    kept = near_duplicates.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({(r[1] or "") for r in ODD})
    assert near_duplicates.digest(empty).count() == 0 and near_duplicates.deduplicated(empty).count() == 0


# --- mixing --------------------------------------------------------------------------


def water(budget, caps, weights):
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, mid * w) for c, w in zip(caps, weights)) < budget:
            lo = mid
        else:
            hi = mid
    return [min(c, hi * w) for c, w in zip(caps, weights)]


def test_budgets_match_water_filling(spark):
    rng = np.random.default_rng(1)
    leaves = [(f"domain{a}", lang, f"s{c}", int(rng.integers(1, 5000)), 3) for a in range(3) for lang in ("en", "de", "xx") for c in range(4)]
    t = spark.createDataFrame(leaves, "domain string, language string, leaf_source string, leaf_tokens long, leaf_docs long")
    weights = {"domain": {"domain0": 5.0}, "language": {"en": 4.0, "de": 2.0}, "leaf_source": {"s1": 3.0}}
    got = {tuple(r)[:3]: r["budget"] for r in mixing.budgets(t, 1.2, 2, weights).collect()}
    cap = {x[:3]: 2.0 * x[3] for x in leaves}
    total = 1.2 * sum(x[3] for x in leaves)
    doms = sorted({x[0] for x in leaves})
    under = lambda *p: sum(v for k, v in cap.items() if k[: len(p)] == p)
    for d, bd in zip(doms, water(total, [under(d) for d in doms], [weights["domain"].get(d, 1.0) for d in doms])):
        langs = ["en", "de", "xx"]
        for lang, bl in zip(langs, water(bd, [under(d, x) for x in langs], [weights["language"].get(x, 1.0) for x in langs])):
            ss = [f"s{c}" for c in range(4)]
            for s, b in zip(ss, water(bl, [cap[d, lang, x] for x in ss], [weights["leaf_source"].get(x, 1.0) for x in ss])):
                assert math.isclose(got[d, lang, s], b, rel_tol=1e-6, abs_tol=1e-3)


def test_mixing_takes_prefixes_of_epochs(docs):
    rows = mixing.digest(docs).collect()
    tokens = {r["doc_id"]: len(words(r["text"])) + 1 for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        assert r["tokens"] == tokens[r["doc_id"]]
        by[r["doc_id"]].append(r["epoch"])
    assert all(sorted(e) == list(range(len(e))) and len(e) <= mixing.MAX_EPOCHS for e in by.values())
    longest = max(tokens.values())
    assert abs(sum(r["tokens"] for r in rows) - mixing.SHARE * sum(tokens.values())) < 80 * longest
    assert sorted(map(tuple, mixing.digest(docs).collect())) == sorted(map(tuple, rows))


def test_mixing_odd_cases(odd, empty):
    m = mixing.mixed(odd)
    assert m.columns == odd.columns and m.count() > 0
    assert mixing.mixed(empty).count() == 0


# --- fingerprints --------------------------------------------------------------------


def test_fingerprints_and_neighbours(spark, odd, docs, empty):
    for df, rows in ((docs, None), (odd, None)):
        got = fingerprints.digest(df, rows=3).collect()
        src = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
        src = sorted(src, key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
        want = collections.Counter()
        for (i, t), (_, u) in zip(src, src[1:] + src[:1]):
            k = len(t) // 3
            want[i, len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()] += 1
        assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        by = collections.defaultdict(set)
        for r, in zip(got):
            by[r["doc_id"], r["n_chars"]].add(r["fingerprint"])
    whole = fingerprints.fingerprint(docs)
    assert whole.count() == docs.count()
    assert fingerprints.digest(empty).count() == 0
    one = spark.createDataFrame([(1, "abc def ghi")], "doc_id long, text string")
    assert fingerprints.digest(one).first()["near_next"] == 1.0


def test_agreement_is_common_subsequence():
    rng = np.random.default_rng(0)
    pairs = []
    for _ in range(40):
        a = bytes(rng.integers(65, 75, rng.integers(0, 65)).astype(np.uint8))
        b = a[5:40] + bytes(rng.integers(65, 75, rng.integers(0, 25)).astype(np.uint8))
        pairs.append((a, b))
    got = fingerprints.agreement([p[0] for p in pairs], [p[1] for p in pairs])
    for (a, b), g in zip(pairs, got):
        row = [0] * (len(b) + 1)
        run = [0] * (len(b) + 1)
        best = 0
        for x in a:
            new, fresh = [0], [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[j], row[j] + (x == y)))
                fresh.append(run[j] + 1 if x == y else 0)
            row, run = new, fresh
            best = max(best, *run)
        need = min(7, len(a), len(b))
        assert math.isclose(g, 2 * row[-1] / max(1, len(a) + len(b)) if need and best >= need else 0.0)


def test_fingerprint_of_a_local_change():
    rng = np.random.default_rng(5)
    t = " ".join(f"w{x}" for x in rng.integers(0, 10**5, 900))
    u = t[:2000] + "changed here" + t[2000:]
    v = " ".join(f"w{x}" for x in rng.integers(0, 10**5, 900))
    a, b, c = fingerprints.signatures(Texts.of([t, u, v]))
    assert fingerprints.likeness([a, a, a], [a, b, c])[0] == 1 and fingerprints.likeness([a], [b])[0] > 0.8 and fingerprints.likeness([a], [c])[0] < 0.3
    assert fingerprints.read(fingerprints.written(a)) == a


# --- packing -------------------------------------------------------------------------


def test_pieces_hold_every_id_once(odd, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        ids = [tok.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in rows]
        got = packing.pack(df).collect()
        want, have = collections.Counter(), collections.Counter()
        by = collections.defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
            have[r["doc_id"], r["doc_tokens"]] += r["length"]
        for r, i in zip(rows, ids):
            want[r["doc_id"], len(i)] += len(i)
        assert have == want
        raw = {(r["doc_id"], len(i)): np.array(i, "<u4").tobytes() for r, i in zip(rows, ids)}
        if df is docs:
            assert all(zlib.crc32(raw[r["doc_id"], r["doc_tokens"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in got)
        for places in by.values():
            at = 0
            for o, n in sorted(places):
                assert o == at and n > 0
                at += n
            assert at <= 1024


def test_differencing_and_rising_windows():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 257, 1000)
    of, k = packing.windows(sizes)
    sums = np.bincount(of, weights=sizes, minlength=k)
    assert sums.max() <= 1024 and k <= math.ceil(sizes.sum() / 1024) + 1 and sums.max() - sums.min() < 200
    of, k = packing.windows(np.array([700, 700, 700]))
    assert k == 3 and sorted(of) == [0, 1, 2]
    two, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums) == [14, 16]


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


# --- licenses ------------------------------------------------------------------------


def test_licenses_match_brute_force(spark, odd, docs, empty):
    extra = spark.createDataFrame(
        [
            (90, "x under the mit license under the MIT-license, y. Apache License, Version 2 apache license version 2"),
            (91, licenses.NOTICES[0][0]),
            (92, licenses.NOTICES[0][0].replace("free of charge", "free of any charge")),
            (93, "apache license version"),
        ],
        "doc_id long, text string",
    )
    for df in (odd, docs, extra):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOW))
            at = [(p, lab) for ph, lab in licenses.PHRASES for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split()]
            starts = [p for p, _ in at]
            want[r["doc_id"], len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))] += 1
        rows = licenses.digest(df).collect()
        assert collections.Counter(tuple(r)[:6] for r in rows) == want
        assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r["labels"] for r in licenses.digest(extra).collect()}
    assert found[91] == found[92] == "mit" and found[93] == ""
    assert licenses.digest(empty).count() == 0


# --- page templates ------------------------------------------------------------------


def page(i, body, host="h.example"):
    return (i, f"https://u@{host}:80/p/{i}", f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>x='</p>'</script></head><body>{body}</body></html>")


def test_main_text(spark):
    rows = [page(i, f"<nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head {i}</h1><p><b>Bo</b>ld &amp; a&nbsp;b<br>next<p>two {i}</article><footer>end</footer>") for i in range(4)]
    rows += [page(10 + i, f"<div id=top>Fixed words</div><div><p>Long own text of page {i} with words.</p><p>More {i}</p></div><section class='comments'>c</section>", "i.example") for i in range(5)]
    rows += [(20, None, "<p>open <b>tag <i x='"), (21, "nonsense", None), (22, None, ""), (23, "https://j.example", "<![foo[x]]><p>b</p><![%x;[y]]><!-- open"), (23, "https://j.example", "<p>b</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = collections.defaultdict(list)
    for r in html_template.extract(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[0] == ["Head 0 Bold & a b next two 0"]
    assert got[12] == ["Long own text of page 2 with words. More 2"]
    assert got[21] == [""] and got[22] == [""] and got[23] == ["b", "b"] and got[20] == ["open tag"]
    assert html_template.extract(df.filter("page_id < 0")).count() == 0


def test_equivalence_classes(spark):
    rows = [page(i, f"<ul>{'<li>a</li>' * i}</ul><p>own {i}</p><p>fixed</p>") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    occ = {(r["token"], r["is_tag"]): r for r in html_template.occurrences(df).collect()}
    li = [r for r in occ.values() if r["is_tag"] and r["total"] == 15]
    assert len(li) == 1 and li[0]["pages"] == 5
    t = html_template.templates(df).first()
    assert len(t["texts"]) >= 1 and len(t["tags"]) >= 4


def test_template_texts_inside_the_article(spark):
    rows = [page(i, f"<article><h1>Head {i}</h1><p>You may <b>also</b> like</p><p>Own {i} <b>bold</b> also</p></article>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_template.extract(df).collect()} == {i: f"Head {i} Own {i} bold also" for i in range(4)}
    near = [page(i, f"<article><h1>Head {i}</h1><p>One passage of many words</p><p>Another one</p></article>") for i in range(4)]
    df = spark.createDataFrame(near, "page_id long, url string, html string")
    assert {r["text"] for r in html_template.extract(df).collect()} == {f"Head {i} One passage of many words Another one" for i in range(4)}


def test_copies_and_null_pages_on_a_host(spark):
    copy = page(0, "<div>Top</div><div><p>A text with words.</p><p>And another</p></div>")
    rows = [copy] * 4 + [page(i, f"<div>Unlike {i}</div><p>Page {i}</p>") for i in (5, 6)]
    # three of eleven pages share a passage, one page is null and one empty
    rows += [page(10 + i, f"<div>{'<p>Passage one</p><p>Passage two</p>' if i < 3 else ''}<p>Long own words {i}</p></div>", "i.example") for i in range(11)]
    rows += [(30, "http://i.example", None), (31, "http://i.example", "")]
    # each page another, with the template's texts alone
    rows += [page(40 + i, f"<!-- {i} --><div><p>All fixed</p></div>", "j.example") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract(df).collect()}
    assert got[0] == "Top A text with words. And another"
    assert got[10] == "Passage one Passage two Long own words 0" and got[20] == "Long own words 10" and got[30] == got[31] == ""
    assert got[40] == "All fixed"


def test_words_of_class_and_id():
    text = lambda body: html_template.main_text(f"<body>{body}</body>", frozenset(), frozenset())
    for wrapper in ("layout with-sidebar", "no-sidebar", "has-comments", "search-page", "social-science", "sidebar", "page search"):
        assert text(f"<div class='{wrapper}'><article><p>One</p><section id='related-work'>Two</section><p class='notice-of-intent'>Three</article></div>") == "One Two Three"
    assert text("<main><div id=search><article>One</article></div></main>") == "One"
    assert text("<article>One<div class='x ad'>Ad</div><section class='comments'><article>C</article></section></article>") == "One"
    assert text("<div hidden><article>No</article></div><aside><article>No</article></aside><article class='comment'>No</article><article>One</article>") == "One"


# --- language model ------------------------------------------------------------------


def test_base_score_matches_brute_force(odd, empty):
    rows = lm_scoring.score(odd).collect()
    src = [(r[0], words((r[1] or "").translate(LOW)) + ["\0"]) for r in ODD]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, t in src if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 3)) for i, t in src)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert lm_scoring.score(empty).count() == 0


def id_streams(texts):
    """Streams of ids one after the other, each with its ends, and where each begins."""
    end = lm_scoring.END
    parts = [[end, end, *t, end] for t in texts]
    return np.array(sum(parts, []), np.int32), np.cumsum([0, *map(len, parts)])


@pytest.fixture(scope="module")
def small_model():
    """Windows of any streams, with the counts of a small corpus."""
    rng = np.random.default_rng(0)
    corpus = [rng.integers(0, 50, n).tolist() for n in (300, 1, 0, 200)]
    ids, edge = id_streams(corpus)
    _, keys = lm_scoring.id_keys(ids, edge, np.full(len(corpus), 2))
    n = collections.Counter(keys.tolist())
    uni = np.bincount(ids, minlength=lm_scoring.IDS).astype(float)
    uni[lm_scoring.END] -= 2 * len(corpus)
    table = lm_scoring.embedding()

    def windows(z, edge, lead=None):
        at, keys = lm_scoring.id_keys(z, edge, np.full(len(edge) - 1, 2) if lead is None else lead)
        found = np.array([n[k] for k in keys.tolist()], float)
        pair, triple = np.zeros(len(z)), np.zeros(len(z))
        pair[at], triple[at] = found[: len(at)], found[len(at) :]
        return lm_scoring.Windows(z, edge, lm_scoring.next_id(z, uni, pair, triple), table, lead)

    return windows


def test_counted_ids_are_a_distribution():
    """P(z | y) and P(z | x y) sum to one over the whole vocabulary, by a plain loop over the corpus."""
    rng = np.random.default_rng(3)
    corpus = [rng.integers(0, 6, 40).tolist(), [5], []]
    ids, edge = id_streams(corpus)
    at, keys = lm_scoring.id_keys(ids, edge, np.full(3, 2))
    n = collections.Counter(keys.tolist())
    pair, triple = np.zeros(len(ids)), np.zeros(len(ids))
    pair[at], triple[at] = np.split(np.array([n[k] for k in keys.tolist()], float), 2)
    uni = np.bincount(ids, minlength=lm_scoring.IDS).astype(float)
    uni[lm_scoring.END] -= 6
    two, three, _ = lm_scoring.next_id(ids, uni, pair, triple)
    plain = [[lm_scoring.END] * 2 + t + [lm_scoring.END] for t in corpus]
    one = (uni + 0.5) / (uni.sum() + 0.5 * lm_scoring.IDS)
    for i in at.tolist():
        x, y, z = ids[i - 2 : i + 1].tolist()
        after_y = collections.Counter(t[k] for t in plain for k in range(2, len(t)) if t[k - 1] == y)
        after = collections.Counter(t[k] for t in plain for k in range(2, len(t)) if t[k - 2 : k] == [x, y])
        want_two = (after_y[z] + 10 * one[z]) / (sum(after_y.values()) + 10)
        assert math.isclose(two[i - 2], want_two, rel_tol=1e-5)
        assert math.isclose(three[i - 2], (after[z] + 5 * want_two) / (sum(after.values()) + 5), rel_tol=1e-5)


def test_next_ids_are_a_distribution(small_model):
    m = lm_scoring.start_weights()
    z = np.concatenate([[lm_scoring.END] * 2, np.tile([5, 9, 7], 30)]).astype(np.int32)
    for at in (2, 40, len(z) - 1):
        total = 0.0
        many = 997  # streams in one call
        for low in range(0, lm_scoring.IDS, many):
            last = np.arange(low, min(low + many, lm_scoring.IDS))
            x = np.tile(z[: at + 1], (len(last), 1))
            x[:, at] = last
            edge = np.arange(len(last) + 1) * (at + 1)
            w = small_model(x.ravel(), edge)
            p, real, _ = w.batch(slice(0, len(w.first)), m, False)
            each = np.zeros(len(edge) - 1)
            ends = np.flatnonzero(np.append(np.diff(w.text) > 0, True))
            each[w.text[ends]] = [p[k][real[k]][-1] for k in ends.tolist()]
            total += each.sum()
        assert math.isclose(total, 1.0, rel_tol=1e-3)


def test_later_ids_change_nothing_before(small_model):
    m = lm_scoring.start_weights()
    z = np.concatenate([[lm_scoring.END] * 2, np.random.default_rng(1).integers(1, 50, 150)]).astype(np.int32)
    other = z.copy()
    other[100:] = 3

    def each(x):
        w = small_model(x, np.array([0, len(x)]))
        p, real, _ = w.batch(slice(0, len(w.first)), m, False)
        return p[real]

    a, b = each(z), each(other)
    assert len(a) == len(z) - 2 and np.allclose(a[:97], b[:97]) and not np.allclose(a[98:], b[98:])


def test_gradient_is_of_the_log_likelihood(small_model):
    m = lm_scoring.start_weights()
    z = np.concatenate([[lm_scoring.END] * 2, np.tile([5, 9, 7, 11], 20)]).astype(np.int32)
    w = small_model(z, np.array([0, len(z)]))
    every = slice(0, len(w.first))
    _, _, g = w.batch(every, m, True)

    def total(x):
        return np.log(w.batch(every, x, False)[0].astype(float)).sum() / len(w.first)

    for name, index in (("form", (2, 2)), ("distance", (5,)), ("sinks", (1, 3))):
        up = {k: v.astype(float).copy() for k, v in m.items()}
        down = {k: v.astype(float).copy() for k, v in m.items()}
        up[name][index] += 1e-3
        down[name][index] -= 1e-3
        assert math.isclose((total(up) - total(down)) / 2e-3, g[name][index], rel_tol=0.05, abs_tol=2e-3)


def test_excerpts_are_the_windows_of_their_texts(spark, small_model):
    """Every training text gives a window at least, and each scores as it does in its whole text."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n).tolist() for n in (0, 3, 33, 700, 1500)]
    rows = [(7 + 70_000 * i, bytearray(id_streams([t])[0].astype(np.uint16).tobytes())) for i, t in enumerate(texts)]
    got = lm_scoring.excerpts(spark.createDataFrame(rows, "h long, ids binary"), 3).collect()
    m = lm_scoring.start_weights()
    whole = {}
    for (h, _), t in zip(rows, texts):
        w = small_model(*id_streams([t]))
        p, real, _ = w.batch(slice(0, len(w.first)), m, False)
        whole[h] = [p[k][real[k]] for k in range(len(p))]
    assert {r["h"] for r in got} == set(whole) and all(-3 <= r["block"] <= -1 for r in got)
    for h, each in whole.items():
        nth = sorted(r["nth"] for r in got if r["h"] == h)
        assert nth == list(range(nth[0], len(each), lm_scoring.EVERY)) and nth[0] < lm_scoring.EVERY
    for r in got:
        z = np.frombuffer(bytes(r["ids"]), np.uint16).astype(np.int32)
        w = small_model(z, np.array([0, len(z)]), np.array([r["lead"]]))
        p, real, _ = w.batch(slice(0, 1), m, False)
        assert np.allclose(p[0][real[0]], whole[r["h"]][r["nth"]], rtol=1e-4)


def test_ids_hold_the_words_of_their_texts():
    """Words found by their ids are those of the text, white space of other kinds inside words included."""
    texts = ["Ab  cd\n\tef", "", " x\u00a0 \u00a0y \u2003 z's ", "ab CD ef ab", "\u00e9\u00c9 1234567 ...!"]
    coder, begins = lm_scoring.Coder(None), lm_scoring.word_starts(None)
    ids, edge = coder.stream(Texts.of(texts))
    text, h = lm_scoring.id_words(ids, edge, begins)
    want = [words(t.translate(LOW)) + ["\0"] for t in texts]
    assert np.bincount(text).tolist() == [len(w) for w in want]
    order = np.argsort(text[: -len(texts)], kind="stable")
    named = collections.defaultdict(set)
    for x, y in zip([w for t in want for w in t[:-1]], h[: -len(texts)][order].tolist()):
        named[x].add(y)
    assert all(len(v) == 1 for v in named.values()) and len({next(iter(v)) for v in named.values()}) == len(named)
    again, _ = coder.stream(Texts.of(texts))
    assert (again == ids).all()


def test_model_beats_word_counts(spark):
    rows = lm_scoring.score(spark.read.parquet(f"{SF01}/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_parity_sketch_never_rules_out_a_similar_pair(spark):
    rng = random.Random(5)
    texts = []
    for size in (6, 30, 150, 900):
        w = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for edits in (0, 1, 2, 3, 5, 9, 20, 60):
            v = list(w)
            for i in rng.sample(range(size), min(edits, size)):
                v[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    t = Texts.of(texts)
    who, h, _ = near_duplicates.shingles(t)
    sets = [set(h[who == i].tolist()) for i in range(len(texts))]
    sketch = near_duplicates.parities(len(t), who, h).reshape(len(t), -1)
    rows = [(i, j, sketch[i].tolist(), sketch[j].tolist(), len(sets[i]), len(sets[j])) for i in range(len(texts)) for j in range(i)]
    df = spark.createDataFrame(rows, "a int, b int, ka array<long>, kb array<long>, na long, nb long")
    passed = {(r["a"], r["b"]) for r in df.filter(near_duplicates.may_match()).collect()}
    similar = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert similar and similar <= passed and len(passed) < len(rows) / 2


def test_open_pairs_of_a_bucket_are_spread(spark):
    rows = [(bytes([i]), bytes([i % 20]), b, [1, 2], [0] * (near_duplicates.PARITY // 64), 9) for i in range(40) for b in (1, 2)]
    left = spark.createDataFrame(rows, "node binary, comp binary, bucket long, buckets array<long>, sketch array<long>, n long")
    got = near_duplicates.open_pairs(left, 8).collect()
    assert sorted((r["a"][0], r["b"][0]) for r in got) == [(i, j) for i in range(40) for j in range(i + 1, 40) if i % 20 != j % 20]
    assert {r["bucket"] for r in got} == {1}
    keys = collections.Counter((r["i"], r["j"]) for r in got)
    assert len(keys) > 5 and max(keys.values()) < len(got) / 4


def test_attention_learns_from_every_window(spark):
    """The weights are those of a plain pass over all windows of all training texts, with all counts."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (400, 3, 900, 0, 650, 120)]
    ids, edge = lm_scoring.Coder(None).stream(Texts.of(texts))
    each = [ids[a:b] for a, b in zip(edge, edge[1:])]
    held = [False, False, True, False, False, True]
    rows = [(7, i, held[i], 1000 - i, bytearray(x.astype(np.uint16).tobytes())) for i, x in enumerate(each)]
    dealt = spark.createDataFrame(rows, "block long, doc_id long, held_out boolean, h long, ids binary")
    mine = [each[i] for i in range(len(each)) if not held[i]][::-1]  # by hash
    z, cut = np.concatenate(mine), np.cumsum([0, *map(len, mine)])
    uni = np.bincount(z, minlength=lm_scoring.IDS).astype(float)
    uni[lm_scoring.END] -= 2 * len(mine)
    at, keys = lm_scoring.id_keys(z, cut, np.full(len(mine), 2))
    n = collections.Counter(keys.tolist())
    pair, triple = np.zeros(len(z)), np.zeros(len(z))
    pair[at], triple[at] = np.split(np.array([n[k] for k in keys.tolist()], float), 2)
    w = lm_scoring.Windows(z, cut, lm_scoring.next_id(z, uni, pair, triple), lm_scoring.embedding())
    assert len(w.first) == sum(-(-(len(x) - 2) // lm_scoring.STEP) for x in mine)
    m = lm_scoring.start_weights()
    lm_scoring.learn(w, m, {k: np.zeros(v.shape) for k, v in m.items()})
    sums = lm_scoring.summed(lm_scoring.sent(dealt, 3, None))
    got = lm_scoring.train(dealt, sums, spark.sparkContext.broadcast(uni)).first()["weights"]
    assert np.allclose(got, lm_scoring.flat(m), rtol=1e-3, atol=1e-3)


def test_windows_match_a_plain_loop(small_model):
    """Each place's probability by a loop over its keys, for weights that exponentials hold and for those they do not."""
    rng = np.random.default_rng(8)
    ids, edge = id_streams([rng.integers(1, 9, n).tolist() for n in (150, 0, 1, 40, 64)])
    w = small_model(ids, edge)
    start = lm_scoring.start_weights()
    mixed = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in start.items()}
    table, two, three, bucket = lm_scoring.embedding(), *w.value
    e = [np.concatenate([table[0][ids[j]], table[1][ids[j - 1]]]).astype(float) for j in range(len(ids))]
    for m, range_holds in ((start, True), (mixed, True), ({k: v * 20 for k, v in mixed.items()}, False)):
        assert (w.factors(m) is not None) == range_holds
        p, real, _ = w.batch(slice(0, len(w.first)), m, False)
        assert real.sum() == len(ids) - 2 * (len(edge) - 1)
        for k, first in enumerate(w.first.tolist()):
            for i in range(first, min(first + lm_scoring.STEP, int(edge[w.text[k] + 1]))):
                keys = range(max(first - lm_scoring.SPAN + lm_scoring.STEP - 1, int(edge[w.text[k]]) + 1), i - 1)
                logs = [e[i - 1] @ m["form"].astype(float) @ e[j] + m["distance"][i - j] for j in keys]
                sinks = m["sinks"][:, bucket[i - 2]].astype(float)
                top = max([*logs, *sinks])
                each = [math.exp(x - top) for x in logs]
                good = math.exp(sinks[0] - top) * two[i - 2] + math.exp(sinks[1] - top) * three[i - 2] + sum(x for x, j in zip(each, keys) if ids[j + 1] == ids[i])
                assert math.isclose(p[k, i - first], good / (sum(each) + np.exp(sinks - top).sum()), rel_tol=2e-3)


def test_distinct_keys_by_sorted_places():
    """Kinds give the keys, counts and values that single places have, whether sorted with their places or not."""
    rng = np.random.default_rng(9)
    ids, edge = id_streams([rng.integers(0, 30, n).tolist() for n in (400, 0, 1, 300)])
    counted = np.repeat([True, True, False, True], np.diff(edge))
    at, keys = lm_scoring.id_keys(ids, edge, np.full(4, 2))
    n = collections.Counter(keys[np.tile(counted[at], 2)].tolist())
    kinds = lm_scoring.Kinds(ids, edge)
    u, got = kinds.keys(counted)
    assert u.tolist() == sorted(set(keys.tolist())) and got.tolist() == [n[k] for k in u.tolist()]
    uni = np.bincount(ids, minlength=lm_scoring.IDS).astype(float)
    pair, triple = np.zeros(len(ids)), np.zeros(len(ids))
    pair[at], triple[at] = np.split(np.array([n[k] for k in keys.tolist()], float), 2)
    for v, want in zip(kinds.values(uni, got), lm_scoring.next_id(ids, uni, pair, triple)):
        assert np.allclose(np.repeat(v, kinds.many)[np.argsort(kinds.at)], want[at - 2])
    wide = rng.integers(0, 5, 50).astype(np.uint64) << np.uint64(60)
    for k in (wide, wide >> np.uint64(60), wide[:0]):
        order = np.argsort(k, kind="stable")
        key, spot = lm_scoring.spots(k)
        assert (key == k[order]).all() and (spot == order).all()


def test_packed_numbers_come_back():
    for x in ([], [0, 0], [1, 255], [0, 2**63 - 1, 7], list(range(1000, 3000))):
        a = np.array(x, np.int64)
        assert (lm_scoring.unplanes(lm_scoring.planes(a), np.int64) == a).all()
        b = a.astype(np.uint64) * np.uint64(2)
        assert (lm_scoring.unplanes(lm_scoring.planes(b), np.uint64) == b).all()
