"""Page templates: markup that only looks like it, depth, attributes, salted joins, classes by real occurrence vectors."""

import collections
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from gleaner.llm import html_template

NONE = frozenset()
main = lambda page: html_template.main_text(page, NONE, NONE)


@pytest.mark.parametrize(
    "before",
    [
        "<script>if (a<b) run();</script>",
        '<script>var s="<!--";</script>',
        "<script>x = '<p ' + \"it's\";</script>",
        "<style>/* <!-- */ p{content:'<'}</style>",
        "<script><!-- if (a</b) --></script>",
        "<textarea><p 'x</textarea>",
        "<title>a <b</title>",
    ],
)
def test_markup_inside_raw_text(spark, before):
    page = f"<html><head>{before}</head><body>{before}<article><p>Kept</p>{before}<p>too</p></article></body></html>"
    assert main(page) == "Kept too"
    df = spark.createDataFrame([(i, "http://h.example", page + " " * i) for i in range(4)], "page_id long, url string, html string")
    assert {r["text"] for r in html_template.extract(df).collect()} == {"Kept too"}


def test_deep_markup_in_linear_time_and_memory():
    page = "<article>" + "<b>x " * 100_000 + "<div>y" * 20_000
    tracemalloc.start()
    t = time.time()
    text = main(page)
    took, peak = time.time() - t, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.count("x") == 100_000 and text.count("y") == 20_000
    assert took < 20 and peak < 400e6  # traced; untraced about a fifth of the time
    assert main("<article>" + "<div>" * 50_000 + "a" + "</div>" * 50_000 + "<p>b") == "a b"


def test_attributes_that_only_look_alike():
    for attr in ("data-class='ad'", "data-role=alert", "data-id=comments", "aria-hidden=false", "title='class=ad'", "xclass=ad", "class=text class=ad", "data-hidden"):
        assert main(f"<article><p>One</p><p {attr}>Two</p></article>") == "One Two", attr
    for attr in ("class='ad'", "CLASS=ad", "role='alert'", "id=comments", "hidden", "style='display: none'", "aria-hidden='true'", "x='y'class=ad"):
        assert main(f"<article><p>One</p><p {attr}>Two</p></article>") == "One", attr


def test_header_of_the_page_and_of_the_article():
    assert main("<header><h1>Site</h1></header><article><header><h1>Title</h1><nav>n</nav></header><p>Body</p><footer>f</footer></article>") == "Title Body"


def rows(n=40):
    out = [(i, "http://big.example/x", f"<body><div class=top>Top words</div><div><p>Own text {i} of this page.</p><p>You may also like</p></div><p>Foot</p></body>") for i in range(n)]
    out += [(1000 + i, f"http://h{i % 5}.example", f"<body><p>Fixed</p><div><p>Long own words {i}</p></div></body>") for i in range(20)]
    return out + [(2000, None, None), (2001, "nonsense", "<p>a")]


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    want = sorted(map(tuple, html_template.extract(df).collect()), key=repr)
    assert any(r[0] == 7 and r[2] == "Own text 7 of this page." for r in want)  # boilerplate has no tag or word of its own
    for hot in (1, 10_000):
        monkeypatch.setattr(html_template, "HOT_HOSTS", hot)
        assert sorted(map(tuple, html_template.extract(df, broadcast_bytes=0).collect()), key=repr) == want


def test_classes_against_real_vectors(spark):
    pages = rows(12)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    hosts = collections.defaultdict(dict)
    for _, url, html in pages:
        h = (url or "").partition("://")[2].partition("/")[0]
        hosts[h][html or ""] = html_template.Scan(html or "")
    want = {}
    for h, scans in hosts.items():
        vectors = collections.defaultdict(lambda: [0] * len(scans))  # noqa: B023
        for k, scan in enumerate(scans.values()):
            for t in scan.tags:
                vectors[t, True][k] += 1
            for t, _ in html_template.blocks(scan):
                vectors[t, False][k] += 1
        classes = collections.defaultdict(list)
        for t, v in vectors.items():
            classes[tuple(v)].append(t)
        valid = [ts for v, ts in classes.items() if sum(c > 0 for c in v) >= max(3, 0.5 * len(scans)) and len(ts) >= 2]
        if valid:
            want[h] = ({t for ts in valid for t, tag in ts if tag}, {t for ts in valid for t, tag in ts if not tag})
    got = {r["host"]: (set(r["tags"]), set(r["texts"])) for r in html_template.templates(df).collect()}
    assert got == want and "big.example" in got
