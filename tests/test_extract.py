"""Selection and extraction on inline HTML (situations H1-H12 of FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions.xpath import UnsupportedXPath, XPathSyntaxError
from gleaner.operators import extract as X
from gleaner.plans import presets as P


def rows(df):
    return [tuple(r) for r in df.orderBy("page_id", "original_index").collect()]


def run(dom, main, cols, **kw):
    return rows(X.extract(dom, X.ScrapeConfig.of(main, cols), **kw))


def test_attribute_values_in_order(make_dom):
    dom = make_dom('<div><span class="a" data-x="1">one</span><span class="b" data-x="2">two</span></div>')
    assert run(dom, "//span", [("x", "@data-x"), ("c", "@class")]) == [(0, 0, False, "1", "a"), (0, 1, False, "2", "b")]
    vals = X.select_values(dom, "//span/@data-x").orderBy("value_index").collect()
    assert [r.value for r in vals] == ["1", "2"]


def test_text_node_selection(make_dom):
    dom = make_dom("<p>hello <b>x</b></p>")
    vals = X.select_values(dom, "//p/text()").collect()
    assert [r.value for r in vals] == ["hello "]


def test_scoped_query(make_dom):
    dom = make_dom("<section><i>in</i></section><i>out</i>")
    assert X.select_values(dom, ".//i", within="//section").count() == 1
    assert X.select_values(dom, "//i").count() == 2


def test_malformed_selector_policy(make_dom):
    dom = make_dom("<a href='/x'>x</a>")
    with pytest.raises(XPathSyntaxError):
        X.select_rows(dom, "//a[")
    assert X.select_values(dom, "//[").count() == 0
    assert run(dom, "//[", [("t", ".")]) == []
    with pytest.raises(XPathSyntaxError):
        X.extract(dom, X.ScrapeConfig.of("//[", [("t", ".")]), on_error="raise")
    assert run(dom, "//a", [("t", "//["), ("u", "@href")]) == [(0, 0, False, "", "/x")]
    assert X.count_matches(dom, "//[").first().match_count == 0
    v = X.validate_selector(dom, "]]").first()
    assert (v.match_count, v.error) == (0, "Invalid XPath")


def test_attribute_selectors_count_and_are_valid(make_dom):
    dom = make_dom("<a href='/x'>x</a><a>y</a><a href='/z'>z</a><!-- c -->")
    assert X.count_matches(dom, "//a/@href").first().match_count == 2
    assert tuple(X.validate_selector(dom, "//a/@href").first()) == ("//a/@href", 0, None)
    assert tuple(X.validate_selector(dom, "//a").first()) == ("//a", 3, None)
    assert tuple(X.validate_selector(dom, "//a/text()").first()) == ("//a/text()", 0, None)
    assert X.count_matches(dom, "//a/text()").first().match_count == 3


def test_unsupported_selector_raises(make_dom):
    dom = make_dom("<a>x</a>")
    with pytest.raises(UnsupportedXPath):
        X.extract(dom, X.ScrapeConfig.of("//a[$v]", [("t", ".")]))


def test_column_forms(make_dom):
    dom = make_dom('<div title="  t  "><p> one </p><p>two</p><img alt="i"></div>')
    got = run(dom, "//div", [("dot", "."), ("attr", "@title"), ("str", "string(@title)"), ("miss", "@nope"), ("first", "p")])
    assert got == [(0, 0, False, "one two", "  t  ", "t", "", "one")]


def test_empty_rows_and_indexes(make_dom):
    dom = make_dom('<ul><li class="item" data-v="a">A</li><li class="item" data-v="b">B</li><li class="item" data-v=" "> </li></ul>')
    got = run(dom, "//li[@class='item']", [("t", "."), ("v", "@data-v")])
    assert [(r[1], r[2]) for r in got] == [(0, False), (1, False), (2, True)]
    dom2 = make_dom('<ul><li data-v="x"> </li></ul>')
    assert run(dom2, "//li", [("t", "."), ("v", "@data-v")])[0][2] is False
    assert run(dom2, "//li", [])[0][2] is True
    assert run(dom2, "//table", [("t", ".")]) == []


def test_nbsp_and_bom_trim(make_dom):
    dom = make_dom("<p> ﻿ x  </p><p> </p>")
    got = run(dom, "//p", [("t", ".")])
    assert got == [(0, 0, False, "x"), (0, 1, True, "")]


def test_duplicate_keys_last_wins(make_dom):
    dom = make_dom('<a href="/h" title="T">x</a>')
    res = X.extract(dom, X.ScrapeConfig.of("//a", [("A", "@href", "k"), ("B", "@title", "k"), ("C", ".")]))
    assert res.columns == ["page_id", "original_index", "is_empty", "k", "C"]
    assert rows(res) == [(0, 0, False, "T", "x")]


def test_long_form(make_dom):
    dom = make_dom('<a href="/h">x</a>')
    r = X.extract(dom, X.ScrapeConfig.of("//a", [("Text", "."), ("URL", "@href")]), form="long").first()
    assert dict(r.data) == {"Text": "x", "URL": "/h"}


def test_positions_and_axes(make_dom):
    html = (
        "<table><tr><th>h</th></tr><tr><td>1</td><td><a>a1</a><a>a2</a></td></tr>"
        "<tr><td>2</td><td>z</td></tr></table><dl><dt>T</dt><dd>D</dd><dt>U</dt><dd>E</dd></dl>"
    )
    dom = make_dom(html)
    assert run(dom, "//tr[td]", [("c1", "*[1]"), ("c2", "./td[2]//a[1]"), ("n", "count(td)")]) == [
        (0, 0, False, "1", "a1", "2"), (0, 1, False, "2", "", "2")]
    assert run(dom, "(//td)[3]", [("t", ".")]) == [(0, 0, False, "2")]
    assert run(dom, "//tr[position() > 1 and position() <= 3]", [("t", "td[1]")]) == [(0, 0, False, "1"), (0, 1, False, "2")]
    assert run(dom, "//dt", [("t", "."), ("d", "./following-sibling::dd")]) == [(0, 0, False, "T", "D"), (0, 1, False, "U", "E")]
    assert run(dom, "//tr[last()]", [("t", "td[1]")]) == [(0, 0, False, "2")]


def test_union_document_order_and_functions(make_dom):
    dom = make_dom('<h2 id="b">B</h2><h1 class="c">  A\n  x </h1><a href="https://www.twitter.com/p">t</a>')
    got = run(dom, P.SYSTEM_PRESETS["sys-headings"][1].main_selector,
              [("l", "substring(local-name(), 2)"), ("t", "normalize-space(.)"), ("id", "@id")])
    assert got == [(0, 0, False, "2", "B", "b"), (0, 1, False, "1", "A x", "")]
    soc = rows(P.preset(dom, "sys-social-media-links"))
    assert soc[0][3] == "titter"


def test_dofollow_self_or_descendant_attrs(make_dom):
    dom = make_dom('<a href="/x"><img title="inner"></a><a href="/y" rel="nofollow">n</a>')
    got = rows(P.preset(dom, "sys-dofollow-links"))
    assert got == [(0, 0, True if False else False, "", "/x", "inner", "", "")]


def test_run_presets_single_pass(make_dom):
    dom = make_dom('<h1>T</h1><a href="/a">a</a><a href="http://e.com/x" rel="nofollow">e</a>')
    res = P.run_presets(dom).groupBy("preset_id").count().collect()
    got = {r.preset_id: r["count"] for r in res}
    assert got == {"sys-headings": 1, "sys-dofollow-links": 1, "sys-internal-links": 1,
                   "sys-external-links": 1, "sys-nofollow-links": 1}


def test_row_reference(make_dom):
    dom = make_dom("<ul><li>a</li><li>b</li></ul>")
    assert X.row_selector("//li", 1) == "(//li)[2]"
    r = X.fetch_row(dom, "//li", 1).first()
    assert (r.tag, r.text) == ("li", "b")
    one = X.extract(dom, X.ScrapeConfig.of(X.row_selector("//li", 1), [("t", ".")])).first()
    assert one.t == "b"


def test_display_projection_and_config_edits(make_dom):
    cfg = X.ScrapeConfig.of("//a", [("Name", ".", "k1"), ("Name", "@href")])
    dom = make_dom('<a href="/u">x</a>')
    res = X.extract(dom, cfg)
    disp = X.project_display(res, ["Name", "Name"], cfg)
    assert disp.columns[-2:] == ["Name", "Name#1"]
    assert tuple(disp.first())[-2:] == ("x", "/u")
    cfg2 = X.rename_column(X.add_column(cfg, "  New "), 2, "Newer")
    assert [c.name for c in cfg2.columns] == ["Name", "Name", "Newer"]
    assert X.add_column(cfg, "  ").columns == cfg.columns
    assert len(X.remove_column(cfg2, 0).columns) == 2
    assert X.normalize_config(None, "//x").columns[0].selector == "."
    assert X.normalize_config(X.ScrapeConfig("//a", ())).columns == X.DEFAULT_COLUMNS


def test_status_of_an_unsupported_selector(make_dom):
    dom = make_dom("<p>a</p>")
    row = X.validate_selector(dom, "//p[lang('en')]").first()
    assert row.match_count == 0 and row.error.startswith("Unsupported XPath")
    assert X.validate_selector(dom, "//p[").first().error == "Invalid XPath"
