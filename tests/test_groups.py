"""Inference over all elements against the literal loops on random trees."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import groups as GR

TAGS = ["div", "p", "ul", "li", "span", "section", "b"]


def random_page(r, n):
    def node(depth):
        tag = r.choice(TAGS)
        inner = "".join(node(depth + 1) for _ in range(r.randrange(4) if depth < 6 and r.random() < 0.7 else 0))
        return f"<{tag}>{inner or 'x'}</{tag}>"

    out = ""
    while out.count("<") < n:
        out += node(0)
    # block elements close an open p; keep the tree as written
    return out.replace("<p>", "<em>").replace("</p>", "</em>")


class Tree:
    """A page's elements from the node array, with the reference's loops written out."""

    def __init__(self, nodes):
        self.n = {x["pre"]: x for x in nodes}
        self.el = [i for i, x in self.n.items() if not x["tag"].startswith("#") and x["depth"] >= 1]

    def chain(self, i):
        out = []
        while i > 0:
            out.append(i)
            i = self.n[i]["parent"]
        return out[::-1]

    def segments(self, i):
        return [(self.n[a]["tag"], self.n[a]["sib"] if self.n[a]["sib_n"] > 1 else None) for a in self.chain(i)]

    def count(self, segs, absolute, html=False):
        if not segs:
            return 0 if html else 1
        hits = 0
        for i in self.el:
            c = self.chain(i)
            if len(c) < len(segs) or (absolute and len(c) != len(segs)) or (html and not self.n[i]["is_html"]):
                continue
            hits += all(self.n[a]["tag"] == t and (k is None or self.n[a]["sib"] == k) for a, (t, k) in zip(c[-len(segs) :], segs, strict=True))
        return hits

    def minimal(self, i):
        segs, selected = self.segments(i), None
        while any(k is not None for _, k in segs):
            selected = self.count(segs, True)
            if selected > 1:
                break
            at = max(j for j, (_, k) in enumerate(segs) if k is not None)
            segs = [*segs[:at], (segs[at][0], None), *segs[at + 1 :]]
        absolute = True
        while selected is not None and segs:
            if self.count(segs[1:], False) != selected:
                break
            segs, absolute = segs[1:], False
        text = ("/" if absolute else "//") + "/".join(t + (f"[{k}]" if k else "") for t, k in segs)
        return ("/", 0) if not segs else (text, self.count(segs, absolute, html=True))

    def sibling_count(self, i):
        return self.n[i]["sib_n"]

    def ancestors(self, i):
        up = self.chain(i)[::-1]
        row = None
        for tag in ("tr", "li", "dt", "dd"):
            near = next((a for a in up if self.n[a]["tag"] == tag), None)
            if near is not None and self.sibling_count(near) > 1:
                row = near
                break
        for a in up[:7]:
            t = self.n[a]["tag"]
            if t not in ("html", "body") and self.sibling_count(a) > 1 and not (t in ("section", "article", "main", "aside", "figure") and self.sibling_count(a) < 3):
                return row, a
        return row, i

    def candidates(self, i):
        out = []
        for a in self.chain(i)[::-1][:11]:
            if self.n[a]["tag"] == "body":
                break
            c = self.minimal(a)
            if c not in out:
                out.append(c)
        return out, next((k for k, c in enumerate(out) if c[1] >= 2), 0)


@pytest.fixture(scope="module")
def dom(make_dom):
    r = random.Random(9)
    return make_dom(*[random_page(r, n) for n in (8, 30, 60, 120)], "", "<table><tr><td>1<td>2<tr><td>3<td><svg><g></g><g></g></svg></table>").cache()


@pytest.fixture(scope="module")
def trees(dom):
    return {x["page_id"]: Tree(x["nodes"]) for x in dom.select("page_id", "nodes").collect()}


def test_every_elements_paths(dom, trees):
    chains = GR.element_chains(dom)
    got = {(x["page_id"], x["pre"]): (x["xpath"], x["matches"]) for x in GR.minimal_paths(chains).collect()}
    assert got == {(p, i): t.minimal(i) for p, t in trees.items() for i in t.el}
    paths = {(x["page_id"], x["pre"]): x["path"] for x in GR.absolute_paths(chains).collect()}
    assert paths == {(p, i): "/" + "/".join(a + (f"[{k}]" if k else "") for a, k in t.segments(i)) for p, t in trees.items() for i in t.el}


def test_every_elements_ancestors_and_candidates(dom, trees):
    chains = GR.element_chains(dom)
    got = {(x["page_id"], x["pre"]): (x["row"], x["repeating"], x["guess"]) for x in GR.ancestors(chains).collect()}
    want = {}
    for p, t in trees.items():
        for i in t.el:
            row, rep = t.ancestors(i)
            want[(p, i)] = (row, rep, rep if row is None else row)
    assert got == want
    some = chains.filter("pre % 3 = 0").select("page_id", "pre")
    rows = GR.candidates(chains, some).collect()
    assert len(rows) == some.count()
    for x in rows:
        assert ([tuple(c) for c in x["candidates"]], x["default_index"]) == trees[x["page_id"]].candidates(x["pre"])


def test_groups_and_plan(dom, trees, spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.analyzer.maxIterations")
    t0 = time.time()
    df = GR.repeating_groups(dom)
    built = time.time() - t0
    rows = df.collect()
    want = {(p, i) for p, t in trees.items() for i in t.el if t.n[i]["sib_n"] > 1 and t.n[i]["sib"] == 1}
    assert {(x["page_id"], x["pre"]) for x in rows} == want and len(rows) == len(want)
    for x in rows:
        t = trees[x["page_id"]]
        row, rep = t.ancestors(x["pre"])
        guess = rep if row is None else row
        assert (x["guess_pre"], x["guess_tag"], x["n"]) == (guess, t.n[guess]["tag"], t.n[x["pre"]]["sib_n"])
        assert (x["main_selector"], x["matches"]) == t.minimal(guess)
    t0 = time.time()
    GR.repeating_groups(dom)
    assert time.time() - t0 < 4.0, built  # once the classes are loaded; 1.6 s alone on the machine
    assert before[1] == spark.conf.get("spark.sql.analyzer.maxIterations")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("nodes#" not in line.split("[", 1)[-1].rsplit(")", 1)[-1] for line in plan.splitlines() if line.strip().startswith("Generate"))


def test_templates_of_every_element(make_dom, spark):
    from gleaner.operators import infer as G
    from gleaner.operators import templates as TP

    dom = make_dom(
        "<form action=x><input type=radio data-b=1 data-a=2><input><select><option selected>1</select><textarea></textarea><button aria-label=l>b</button></form>"
        "<figure><pre>c</pre><img><code>d</code></figure><pre>e</pre><dl><dt>t<dd aria-label=q>d</dl><details><summary>s</summary></details>"
        "<section><p>x</p><h3>H</h3><h2>I</h2></section><aside>none</aside><video></video><blockquote>q</blockquote><ol><li data-x=1>1</ol><header></header>",
        "<table><caption>c</caption><colgroup><col span=2><col></colgroup><tr><th>A<th> <th>C<tr data-r=1><td>1<td>2</table><nav><a href=u>l</a></nav><svg><a></a></svg>",
    )
    G._deep_plans(dom)
    whole = F.transform(F.filter("nodes", lambda n: n["is_html"] & (n["depth"] >= 1)), lambda n: F.struct(n["pre"].alias("pre"), G.guess_columns(n["pre"]).alias("columns")))
    plain = lambda cs: [(c["name"], c["selector"], c["key"]) for c in cs]
    want = {(r["page_id"], r["pre"]): plain(r["columns"]) for r in dom.select("page_id", F.inline(whole)).collect()}
    rows = TP.element_templates(dom).collect()
    assert {(r["page_id"], r["pre"]): plain(r["columns"]) for r in rows} == want and len(rows) == len(want)
    assert len({r["tag"] for r in rows}) > 30
    more = TP.template_rules(spark).unionByName(TP.template_rules(spark, "caption: Words = . | {data}"))
    got = {r["tag"]: plain(r["columns"]) for r in TP.element_templates(dom, more).collect()}
    assert got["caption"] == [("Words", ".", None)] and got["nav"] == [("Text", ".", None), ("ARIA Label", "@aria-label", None), ("Links", "a/@href", None)]


def test_templates_are_made_where_pages_are_read(make_dom, spark, monkeypatch):
    """Rules come to the elements, elements are not sent to the rules; partitions follow the elements; copies of a page's id meet."""
    from gleaner.operators import templates as TP
    from gleaner.sources.dom import parts_of

    dom = make_dom("<ul>" + "<li data-x='1'>a</li>" * 30 + "</ul>", "<p><a href='/x'>b</a></p>")
    monkeypatch.setattr(TP, "parts_of", lambda d: parts_of(d, 10), raising=False)
    got = TP.element_templates(dom)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert got.rdd.getNumPartitions() == parts_of(dom, 10) > 5
    once = sorted((r["page_id"], r["pre"], [tuple(c) for c in r["columns"]]) for r in got.collect())
    twice = sorted((r["page_id"], r["pre"], [tuple(c) for c in r["columns"]]) for r in TP.element_templates(dom.unionByName(dom)).collect())
    assert [(p, i) for p, i, _ in once] == [(p, i) for p, i, _ in twice]
    assert all(sorted(a * 2) == sorted(b) for (_, _, a), (_, _, b) in zip(once, twice))
    bare = TP.element_templates(dom, TP.template_rules(spark, "li: Item = .")).collect()
    assert len(bare) == len(once) and all(bool(r["columns"]) == (r["tag"] == "li") for r in bare)


def test_chains_are_spread_by_elements(make_dom, monkeypatch):
    """A task's rows do not grow with the table: partitions are as many as the nodes ask for."""
    from gleaner.sources.dom import parts_of

    dom = make_dom(*["<table>" + "<tr><td>a</td><td>b</td></tr>" * 20 + "</table>"] * 5)
    few = sorted(map(tuple, GR.repeating_groups(dom).collect()))
    nodes = dom.selectExpr("sum(size(nodes))").first()[0]
    monkeypatch.setattr(GR, "parts_of", lambda d: parts_of(d, 50), raising=False)
    assert GR.element_chains(dom).rdd.getNumPartitions() == -(-nodes // 50)
    assert sorted(map(tuple, GR.repeating_groups(dom).collect())) == few
