"""Inference situations (FIXTURES H9-H18): paths, minimisation, ancestors, candidates."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import extract as X
from gleaner.operators import infer as G


@pytest.fixture(scope="module")
def pages(make_dom):
    return make_dom(
        "<div><p>a</p><p id='t'>b</p><p>c</p></div>",                                   # 0: H9
        "<div><ul><li id='t'>x</li><li>y</li></ul></div>",                                # 1: H10
        "<table><thead><tr><th>Name</th><th>Age</th></tr></thead><tbody>"
        "<tr><td id='t'>Al</td><td>3</td></tr><tr><td>Bo</td><td>4</td></tr></tbody></table>",  # 2: H12
        "<ul><li>a</li><li><span id='t'>b</span></li></ul>",                             # 3: H13 li
        "<div class='o'><div><span id='t'>1</span></div></div><div class='o'><div><span>2</span></div></div>",  # 4: H14
        "<section><div class='c' id='t'>A</div><div class='c'>B</div></section><section><div class='c'>C</div></section>",  # 5: H15
        "<div><span id='t'>solo</span></div>",                                             # 6: H16
        "<dl><dt>T</dt><dd id='t'>D</dd><dt>U</dt><dd>E</dd></dl>",                        # 7: H13 dd
    )


def report(pages):
    rows = G.inference_report(pages, "//*[@id='t']").collect()
    return {r.page_id: r for r in rows}


def test_paths_and_minimisation(pages):
    rep = report(pages)
    assert rep[0].path == "/html/body/div/p[2]"
    assert rep[1].minimal in ("/html/body/div/ul/li",)
    assert rep[2].path == "/html/body/table/tbody/tr[1]/td[1]"
    assert rep[2].minimal == "//tr[1]/td"


def test_path_resolves_to_the_node(pages):
    rep = report(pages)
    sel = rep[0].path
    got = X.extract(pages.filter("page_id = 0"), X.ScrapeConfig.of(sel, [("t", ".")])).collect()
    assert [r.t for r in got] == ["b"]


def test_ancestors(pages):
    rep = report(pages)
    assert rep[3].row_ancestor_tag == "li"
    assert rep[7].row_ancestor_tag == "dd"
    assert rep[6].row_ancestor_tag is None and rep[6].repeating_ancestor_tag == "span"
    assert rep[5].repeating_ancestor_tag == "div"


def test_nested_repeated_outer_div(pages):
    g = G.guess_config_for(pages.filter("page_id = 4"), "//span[1]").first()
    base = pages.filter("page_id = 4").select("page_id", "nodes", "text", F.get(X.matched_nodes("//span"), 0).alias("m"))
    G._deep_plans(pages)
    anc = base.select(G.guess_ancestor(F.col("m")).alias("a"), "nodes").select(F.get("nodes", F.col("a"))["attrs"]["class"].alias("c")).first()
    assert anc.c == "o" and g.error is None


def test_table_guess(pages):
    g = G.guess_config_for(pages.filter("page_id = 2"), "//td[@id='t']").first()
    assert [(c.name, c.selector, c.key) for c in g.columns] == [("Name", "*[1]", "col1"), ("Age", "*[2]", "col2")]
    cells = G.quick_scrape(pages.filter("page_id = 2"), "//td[@id='t']").orderBy("original_index", "col_pos").collect()
    assert cells[0].main_selector == "(//table)[1]//tr[td]"
    assert [(c.original_index, c.name, c.value) for c in cells] == [(0, "Name", "Al"), (0, "Age", "3"), (1, "Name", "Bo"), (1, "Age", "4")]


def test_pick_replaces_the_guessed_selector(pages):
    picked = G.pick_and_extract(pages.filter("page_id = 2"), "//td[@id='t']", level=1)
    assert {r.main_selector for r in picked.collect()} == {"/html/body/table/tbody/tr"}


def test_candidates(make_dom):
    deep = make_dom("<div><div><div><div><div><div><div><b id='t'>x</b></div></div></div></div></div></div></div>")
    G._deep_plans(deep)
    b = deep.select("page_id", "nodes", "text", F.get(X.matched_nodes("//b"), 0).alias("m"))
    all10 = b.select(G.selector_candidates(F.col("m")).alias("c")).first().c
    lim3 = b.select(G.selector_candidates(F.col("m"), max_levels=3).alias("c")).first().c
    assert len(all10) == 8 and len(lim3) == 4
    xs = [c.xpath for c in all10]
    assert len(set(xs)) == len(xs) and all(not x.endswith("/body") for x in xs)


def test_default_candidate(make_dom):
    dom = make_dom("<ul><li>a</li><li id='t'>b</li></ul>", "<p id='t'>only</p>")
    rep = {r.page_id: r for r in G.inference_report(dom, "//*[@id='t']").collect()}
    assert rep[0].candidate_matches[rep[0].default_index] >= 2
    assert rep[1].default_index == 0
    none = G.guess_config_for(dom, "//table").collect()
    assert all(r.error == "No elements found for selector" for r in none)
    assert G.guess_config_for(dom, "  ").first().error == "Missing mainSelector"
