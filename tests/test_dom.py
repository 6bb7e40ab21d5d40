"""Tree building rules and the interval invariants of the node array."""

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.sources.htmltree import parse_html


def tags(d):
    return [(t, d["parent"][i]) for i, t in enumerate(d["tag"])]


def test_implied_structure_and_entities():
    d = parse_html("<title>A &amp; B</title><p>x")
    assert d["tag"][:4] == ["#document", "html", "head", "title"]
    assert "body" in d["tag"]
    assert d["text"].startswith(b"A & B")


def test_unclosed_p_li_and_table_sections():
    d = parse_html("<ul><li>a<li>b</ul><p>1<p>2<table><tr><td>x<td>y</table>")
    t = d["tag"]
    assert t.count("li") == 2 and t.count("p") == 2 and "tbody" in t
    li = [i for i, x in enumerate(t) if x == "li"]
    assert d["parent"][li[0]] == d["parent"][li[1]]
    assert [d["sib"][i] for i in li] == [1, 2] and d["sib_n"][li[0]] == 2


def test_raw_text_void_and_duplicate_attrs():
    d = parse_html('<script>var s="</p><a>";</script><img SRC="a" src="b"><br/><p>t</p>')
    assert "a" not in d["tag"]
    img = d["tag"].index("img")
    assert d["attrs"][img] == {"src": "a"}
    assert d["last"][img] == img


def test_svg_is_not_html_and_truncated_page():
    d = parse_html('<a href="/x"><svg><path d="M"/></svg>t</a><p>cut <b')
    svg = d["tag"].index("svg")
    assert d["is_html"][svg] is False and d["is_html"][d["tag"].index("a")] is True
    assert d["tag"][-1] in ("#text", "p")


@st.composite
def trees(draw, depth=0):
    tag = draw(st.sampled_from(["div", "span", "ul", "li", "p", "section", "b"]))
    kids = draw(st.lists(st.one_of(st.text("ab c", min_size=1, max_size=3), trees(depth + 1) if depth < 3 else st.text("x", min_size=1, max_size=2)), max_size=3))
    return f"<{tag}>" + "".join(kids) + f"</{tag}>"


@settings(max_examples=60, deadline=None)
@given(trees())
def test_interval_invariants(html):
    d = parse_html(html)
    n = len(d["tag"])
    assert d["last"][0] == n - 1
    for i in range(1, n):
        p = d["parent"][i]
        assert p < i <= d["last"][p]
        assert d["last"][i] <= d["last"][p]
        assert d["t0"][p] <= d["t0"][i] <= d["t1"][i] <= d["t1"][p]
    # textContent of every element is the concatenation of its text descendants
    for i in range(n):
        if d["tag"][i][0] != "#":
            txt = b"".join(d["text"][d["t0"][j]:d["t1"][j]] for j in range(i + 1, d["last"][i] + 1) if d["tag"][j] == "#text")
            assert txt == d["text"][d["t0"][i]:d["t1"][i]]


def test_odd_declarations_do_not_end_the_page(make_dom):
    dom = make_dom("<p>a</p><![foo[x]]><p>b</p>", "<![ x", "<![%x;[y]]><p>c</p>", "<!x y><p>d</p>")
    assert [r.text.decode() for r in dom.orderBy("page_id").select("text").collect()] == ["ab", "", "c", "d"]


def outer(d, html, i):
    return html.encode()[d["s0"][i] : d["s1"][i]].decode()


def test_source_of_elements():
    html = "<!doctype html>\n<div id=ü>é\n<p>a<p>b &amp; c</p><img src='x>y'><ul><li>1<li><b>2</b></ul></div>\n<svg><path/></svg>ß"
    d = parse_html(html)
    by = {}
    for i, t in enumerate(d["tag"]):
        by.setdefault(t, []).append(outer(d, html, i))
    assert by["div"] == [html[html.index("<div") : html.index("</div>") + 6]]
    assert by["p"] == ["<p>a", "<p>b &amp; c</p>"] and by["li"] == ["<li>1", "<li><b>2</b>"] and by["b"] == ["<b>2</b>"]
    assert by["img"] == ["<img src='x>y'>"] and by["path"] == ["<path/>"] and by["svg"] == ["<svg><path/></svg>"]
    assert d["text"][d["t0"][d["tag"].index("div")] : d["t1"][d["tag"].index("div")]].decode() == "é\nab & c12"


@settings(max_examples=60, deadline=None)
@given(trees())
def test_source_holds_its_element(html):
    html = "ä\n" + html
    d = parse_html(html)
    for i, t in enumerate(d["tag"]):
        if t[0] != "#" and t not in ("html", "head", "body"):
            assert outer(d, html, i).startswith(f"<{t}>") or (t, outer(d, html, i)) == ("p", "</p>")  # a stray end tag makes a p
            p = d["parent"][i]
            assert p < 1 or d["tag"][p] in ("html", "body") or d["s0"][p] <= d["s0"][i] <= d["s1"][i] <= d["s1"][p]


def test_stored_pages(spark, make_dom, tmp_path):
    from gleaner.operators import extract as X
    from gleaner.sources.dom import explode_nodes, read_dom, write_dom

    dom = make_dom("<ul><li>é1</li><li>2</li></ul>", "")
    write_dom(dom, str(tmp_path / "dom"))
    stored = read_dom(spark, str(tmp_path / "dom"))
    cfg = X.ScrapeConfig.of("//li", [("t", ".")])
    assert sorted(map(tuple, X.extract(stored, cfg).collect())) == sorted(map(tuple, X.extract(dom, cfg).collect())) == [(0, 0, False, "é1"), (0, 1, False, "2")]
    nodes = explode_nodes(stored).filter("tag = 'ul'").collect()
    assert [r.text_content for r in nodes] == ["é12"]
    plan = explode_nodes(stored)._jdf.queryExecution().optimizedPlan().toString()
    gen = [x for x in plan.splitlines() if "Generate" in x]
    assert gen and all("text#" not in x.split("], ")[-1] for x in gen)


def test_row_groups_hold_few_nodes(make_dom, spark, tmp_path):
    """A reader takes up to 4,096 rows of a row group at once: with whole pages as rows, groups are bounded by nodes, not pages."""
    import pyarrow.parquet as pq

    from gleaner.sources.dom import read_dom, write_dom

    table = "<table>" + "<tr><td>a</td><td><a href=/p>b</a></td></tr>" * 100 + "</table>"
    dom = make_dom(*["<p>y"] * 50, *["<p>" + "<b>x</b>" * 30_000] * 3, *[table] * 150).cache()
    write_dom(dom, str(tmp_path / "dom"))
    groups = []
    for path in (tmp_path / "dom").glob("*.parquet"):
        with pq.ParquetFile(path) as f:
            for g in (f.metadata.row_group(i) for i in range(f.metadata.num_row_groups)):
                parent = next(c for c in map(g.column, range(g.num_columns)) if c.path_in_schema.endswith("element.parent"))
                groups.append((g.num_rows, parent.num_values))
    assert sum(r for r, _ in groups) == 203 and sum(n for _, n in groups) == dom.selectExpr("sum(size(nodes))").first()[0] > 270_000
    assert max(n for _, n in groups) < 160_000 and len(groups) > 2, groups
    shown = lambda d: sorted(map(tuple, d.selectExpr("page_id", "url", "md5(text)", "md5(to_json(nodes))").collect()))
    assert shown(read_dom(spark, str(tmp_path / "dom"))) == shown(dom)
    dom.unpersist()


def test_parse_takes_a_batch_in_chunks():
    """A batch has as many pages as the session says; the parser makes the strings of a chunk only."""
    import tracemalloc

    import pyarrow as pa

    from gleaner.sources.dom import _make_parser

    html = ["<p>" + chr(97 + i % 26) * 20_000 for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([f"u{i}" for i in range(1000)]), pa.array(html)], names=["page_id", "url", "html"])
    tracemalloc.start()
    parsed = _make_parser("html", ["url"], 10)(iter([batch]))
    first = next(parsed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6, peak  # the batch has 20 MB of html
    got = pa.Table.from_batches([first, *parsed])
    assert got["page_id"].to_pylist() == [*range(1000)] and got["url"].to_pylist() == batch["url"].to_pylist()
    assert [t.decode() for t in got["text"].to_pylist()] == [h[3:] for h in html]


def test_pages_are_parsed_in_parts_by_their_bytes(spark, tmp_path, monkeypatch):
    from gleaner.plans import queries as Q
    from gleaner.sources.dom import html_parts

    pages = spark.createDataFrame([(i, f"u{i}", "<p>" + "é" * 499 if i else None) for i in range(41)], "page_id long, url string, html string")
    assert html_parts(pages) == 1 and html_parts(pages.filter("html is null")) == 1
    assert html_parts(pages, bytes_per_part=1001) == 40 and html_parts(pages, bytes_per_part=2000) == 21
    few = sorted(map(tuple, Q._stored(spark, str(tmp_path / "few"), "pages", lambda: pages).selectExpr("page_id", "url", "to_json(nodes)").collect()))
    monkeypatch.setattr(Q, "html_parts", lambda p: html_parts(p, bytes_per_part=1001))
    many = Q._stored(spark, str(tmp_path / "many"), "pages", lambda: pages)
    assert len(many.inputFiles()) > 2 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, many.selectExpr("page_id", "url", "to_json(nodes)").collect())) == few and len(few) == 41
