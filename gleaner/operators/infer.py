"""Configuration inference (wrapper induction) over every element of every page.

All per-page work is expressed as higher-order functions over the page's ``nodes`` array
(ancestor chains are walked with ``parent`` pointers in ``aggregate``, descendant sets
are the contiguous ``pre+1..last`` ranges), so inference runs inside the scan stage with
no shuffle. The minimal-path step (G3) counts the matches of each candidate path on its
own page with a chain match per element (O(nodes x depth) per count), which keeps the
work per page bounded by the page itself, whatever the number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import js_trim

def _deep_plans(dom: DataFrame) -> None:
    """Inference nests higher-order functions several levels deep; the analyzer resolves one
    lambda level per pass, so allow more passes than the default 100."""
    conf = dom.sparkSession.conf
    if int(conf.get("spark.sql.analyzer.maxIterations", "100")) < 1000:
        conf.set("spark.sql.analyzer.maxIterations", "1000")


def _nodes() -> Column:
    return F.col("nodes")


def _n(i) -> Column:
    return F.get(_nodes(), i)


def _f(i, name: str) -> Column:
    return F.get(_nodes(), i)[name]


def _rng(lo: Column, hi: Column) -> Column:
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _desc(i) -> Column:
    return _rng(i + 1, _f(i, "last"))


def _children(i, pred=None) -> Column:
    def keep(m):
        ok = _f(m, "parent") == i
        return ok & pred(m) if pred is not None else ok

    return F.filter(_desc(i), keep)


def _text(i) -> Column:
    n = _n(i)
    return F.col("text").substr(n["t0"] + 1, n["t1"] - n["t0"]).cast("string")  # bytes of the page's text


def _tag_is(*tags):
    def pred(m):
        t = _f(m, "tag")
        return t == F.lit(tags[0]) if len(tags) == 1 else t.isin(*tags)

    return pred


def _elem(m) -> Column:
    return _f(m, "child") > 0


# --------------------------------------------------------------------------------------
# tables
# --------------------------------------------------------------------------------------
def _table_rows(t) -> Column:
    """``(//table)[k]//tr[td]``: descendant rows having a td child, document order."""
    return F.filter(_desc(t), lambda m: (_f(m, "tag") == "tr") & F.exists(_children(m), lambda c: _f(c, "tag") == "td"))


def table_headers(t, row) -> Column:
    """Header cells (ARRAY<INT>) for ``row`` of table ``t``: the last row of the first
    thead (its th children); else the nearest earlier row of the table having th children;
    else every th of the table."""
    none = F.array().cast("array<int>")
    is_th = _tag_is("th")

    # each step is bound by _let: an expression that stands in a lambda would be evaluated for every element of it
    def of_last(rows: Column) -> Column:
        return F.when(F.size(rows) > 0, _let(F.element_at(rows, -1), lambda r: _children(r, is_th))).otherwise(none)

    thead = F.get(F.filter(_desc(t), _tag_is("thead")), 0)
    in_thead = _let(thead, lambda h: F.when(h.isNotNull(), _let(F.filter(_desc(h), _tag_is("tr")), of_last)).otherwise(none))
    above = F.filter(_desc(t), lambda m: (_f(m, "tag") == "tr") & (m < row) & F.exists(_children(m), is_th))
    every = F.filter(_desc(t), is_th)
    first_of = lambda a, rest: _let(a, lambda x: F.when(F.size(x) > 0, x).otherwise(rest))
    return first_of(in_thead, first_of(_let(above, of_last), every))


def _column_names(headers: Column, ncols: Column) -> Column:
    """The header's text, or ``Column i``, of each column."""
    return F.transform(
        _rng(F.lit(1), ncols),
        lambda i: F.coalesce(F.nullif(js_trim(_text(F.get(headers, i - 1))), F.lit("")), F.concat(F.lit("Column "), i.cast("string"))),
    )


def _page_tables() -> Column:
    """A page's tables: array of (rows, names), names by the first data row's header guess and cells."""
    tables = F.filter(_rng(F.lit(1), F.size(_nodes()) - 1), lambda m: (_f(m, "tag") == "table") & _f(m, "is_html"))

    def named(t, rows):
        first = F.get(rows, 0)
        cells = F.coalesce(F.size(_children(first, _tag_is("th", "td"))), F.lit(0))
        names = _let(table_headers(t, first), lambda hdr: _column_names(hdr, F.greatest(F.size(hdr), cells)))
        return F.struct(rows.alias("rows"), names.alias("names"))

    return F.transform(tables, lambda t: _let(_table_rows(t), lambda rows: named(t, rows)))


def table_config(dom: DataFrame) -> DataFrame:
    """One config per table: ``(page_id, table_index, main_selector, columns
    ARRAY<STRUCT<name, selector, key>>)`` with columns ``*[i]``, keys ``col{i}``, names from
    the header text or ``Column i``."""
    cols = F.transform(
        "t.names",
        lambda name, i: F.struct(
            name.alias("name"),
            F.concat(F.lit("*["), (i + 1).cast("string"), F.lit("]")).alias("selector"),
            F.concat(F.lit("col"), (i + 1).cast("string")).alias("key"),
        ),
    )
    t = dom.select("page_id", F.posexplode(_page_tables()).alias("ti", "t"))
    return t.select(
        "page_id", (F.col("ti") + 1).alias("table_index"),
        F.concat(F.lit("(//table)["), (F.col("ti") + 1).cast("string"), F.lit("]//tr[td]")).alias("main_selector"),
        cols.alias("columns"),
    )


def extract_tables(dom: DataFrame) -> DataFrame:
    """Every table of every page as long-form cells:
    ``(page_id, table_index, original_index, col_index, column_name, value)``.
    Rows are the table's ``tr[td]`` descendants, the header guess uses the first data row,
    a cell is the trimmed text of the row's i-th element child ('' when missing)."""

    def cells(t, r):
        text = lambda kids: F.transform(t["names"], lambda _, i: F.coalesce(js_trim(_text(F.get(kids, i))), F.lit("")))
        return _let(_children(r, _elem), text)

    rows = F.transform(_page_tables(), lambda t: F.struct(t["names"].alias("names"), F.transform(t["rows"], lambda r: cells(t, r)).alias("rows")))
    per_table = dom.select("page_id", F.posexplode(rows).alias("ti", "t"))
    per_row = per_table.select("page_id", "ti", F.col("t.names").alias("names"), F.posexplode("t.rows").alias("original_index", "cells"))
    return per_row.select("page_id", "ti", "original_index", F.posexplode(F.arrays_zip("names", "cells")).alias("i", "c")).select(
        "page_id", (F.col("ti") + 1).cast("int").alias("table_index"), F.col("original_index").cast("int"), (F.col("i") + 1).cast("int").alias("col_index"),
        F.col("c.names").alias("column_name"), F.col("c.cells").alias("value"),
    )


# --------------------------------------------------------------------------------------
# Element paths and their minimisation
# --------------------------------------------------------------------------------------
def _let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it in ``fn`` (no repeated evaluation inside lambdas)."""
    return F.get(F.transform(F.array(value), fn), 0)


def ancestor_chain(m) -> Column:
    """Element ancestors-or-self of ``m`` from ``html`` down to ``m`` (ARRAY<INT>), O(depth)."""
    walk = F.aggregate(
        _rng(F.lit(1), _f(m, "depth")),
        F.struct(m.alias("cur"), F.array().cast("array<int>").alias("arr")),
        lambda acc, _: F.struct(_f(acc["cur"], "parent").alias("cur"), F.concat(F.array(acc["cur"]), acc["arr"]).alias("arr")),
    )
    return walk["arr"]


def path_segments(m) -> Column:
    """``ARRAY<STRUCT<tag, idx>>`` of the absolute path; ``idx`` only when the tag
    repeats among siblings (null otherwise)."""
    return F.transform(
        ancestor_chain(m),
        lambda a: F.struct(_f(a, "tag").alias("tag"), F.when(_f(a, "sib_n") > 1, _f(a, "sib")).alias("idx")),
    )


def _seg_str(s: Column) -> Column:
    return F.concat(s["tag"], F.when(s["idx"].isNotNull(), F.concat(F.lit("["), s["idx"].cast("string"), F.lit("]"))).otherwise(F.lit("")))


def _join(segs: Column) -> Column:
    return F.array_join(F.transform(segs, _seg_str), "/")


def element_path(m) -> Column:
    """Absolute path with indexes only where needed; '' for non-elements."""
    ok = _elem(m) & (_f(m, "depth") >= 1)
    return F.when(ok, F.concat(F.lit("/"), _join(path_segments(m)))).otherwise(F.lit(""))


def _chain_matches(m: Column, segs: Column) -> Column:
    k = F.size(segs)
    walk = F.aggregate(
        _rng(F.lit(1), k),
        F.struct(m.alias("cur"), F.lit(True).alias("ok")),
        lambda acc, j: F.struct(
            _f(acc["cur"], "parent").alias("cur"),
            (acc["ok"] & (_f(acc["cur"], "tag") == F.get(segs, k - j)["tag"])
             & (F.get(segs, k - j)["idx"].isNull() | (_f(acc["cur"], "sib") == F.get(segs, k - j)["idx"]))).alias("ok"),
        ),
    )
    return F.coalesce(walk["ok"], F.lit(False))


def count_path(segs: Column, absolute, html_only: bool = False) -> Column:
    """Number of elements matched by ``/segs`` (absolute) or ``//segs`` (descendant)."""
    k = F.size(segs)
    last_tag = F.element_at(segs, -1)["tag"]
    absolute = F.lit(absolute) if isinstance(absolute, bool) else absolute

    def hit(m):
        depth_ok = F.when(absolute, _f(m, "depth") == k).otherwise(_f(m, "depth") >= k)
        ok = (_f(m, "tag") == last_tag) & depth_ok & _chain_matches(m, segs)
        return ok & _f(m, "is_html") if html_only else ok

    return F.size(F.filter(_rng(F.lit(1), F.size(_nodes()) - 1), hit))


def minimal_path(m) -> Column:
    """G3, the reference's rule exactly: drop the last ``[n]`` while the path matches at
    most one node (remembering the count taken before the last drop); with no index at
    all return the path unchanged; then drop leading segments (``//rest``) while the count
    stays equal. Returns ``STRUCT<xpath, segs, mode>`` with mode 'abs' | 'desc' | 'root'."""
    segs0 = path_segments(m)
    positions = F.reverse(F.filter(_rng(F.lit(0), F.size(segs0) - 1), lambda j: F.get(segs0, j)["idx"].isNotNull()))

    def drop_idx(segs, j):
        return F.transform(segs, lambda s, i: F.when(i == j, F.struct(s["tag"].alias("tag"), F.lit(None).cast("int").alias("idx"))).otherwise(s))

    p1 = F.aggregate(
        positions,
        F.struct(segs0.alias("segs"), F.lit(None).cast("int").alias("sel"), F.lit(False).alias("stop")),
        lambda acc, j: F.when(acc["stop"], acc).otherwise(
            _let(count_path(acc["segs"], True), lambda c: F.when(
                c > 1, F.struct(acc["segs"].alias("segs"), c.alias("sel"), F.lit(True).alias("stop"))
            ).otherwise(F.struct(drop_idx(acc["segs"], j).alias("segs"), c.alias("sel"), F.lit(False).alias("stop"))))
        ),
    )

    def trim(p):
        segs, sel = p["segs"], p["sel"]
        k = F.size(segs)
        p2 = F.aggregate(
            _rng(F.lit(1), k),
            F.struct(F.lit(0).alias("t"), F.lit(False).alias("stop")),
            lambda acc, t: F.when(acc["stop"], acc).otherwise(
                # dropping every segment leaves '/', which matches the document node once
                _let(F.when(t < k, count_path(F.slice(segs, t + 1, k - t), False)).otherwise(F.lit(1)), lambda c: F.when(
                    c == sel, F.struct(t.alias("t"), F.lit(False).alias("stop"))
                ).otherwise(F.struct(acc["t"].alias("t"), F.lit(True).alias("stop"))))
            ),
        )
        t = p2["t"]
        rest = F.slice(segs, t + 1, F.greatest(k - t, F.lit(1)))
        return (
            F.when(sel.isNull(), F.struct(F.concat(F.lit("/"), _join(segs)).alias("xpath"), segs.alias("segs"), F.lit("abs").alias("mode")))
            .when(t == 0, F.struct(F.concat(F.lit("/"), _join(segs)).alias("xpath"), segs.alias("segs"), F.lit("abs").alias("mode")))
            .when(t >= k, F.struct(F.lit("/").alias("xpath"), F.array().cast("array<struct<tag:string,idx:int>>").alias("segs"), F.lit("root").alias("mode")))
            .otherwise(F.struct(F.concat(F.lit("//"), _join(rest)).alias("xpath"), rest.alias("segs"), F.lit("desc").alias("mode")))
        )

    return F.when(_elem(m) & (_f(m, "depth") >= 1), _let(p1, trim))


def matches_of(cand: Column, html_only: bool = True) -> Column:
    """Number of (HTML) elements a minimal-path candidate selects."""
    return F.when(cand["mode"] == "root", F.lit(0)).otherwise(count_path(cand["segs"], cand["mode"] == "abs", html_only))


def selector_candidates(m, max_levels: int = 10) -> Column:
    """Minimal paths of ``m`` and its ancestors below ``body`` (nearest first, at most
    ``max_levels + 1``), de-duplicated in order: ``ARRAY<STRUCT<xpath, segs, mode, n>>``."""
    def below_body(chain):
        stop = F.array_position(F.transform(chain, lambda a: _f(a, "tag")), "body")
        nodes = F.when(stop > 0, F.slice(chain, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(chain)
        return F.slice(nodes, 1, max_levels + 1)

    def distinct(cands):
        return F.filter(cands, lambda c, i: ~F.exists(F.slice(cands, 1, i), lambda d: d["xpath"] == c["xpath"]))

    nodes = _let(F.reverse(ancestor_chain(m)), below_body)
    uniq = _let(F.transform(nodes, lambda a: minimal_path(a)), distinct)
    return F.transform(uniq, lambda c: F.struct(c["xpath"].alias("xpath"), c["segs"].alias("segs"), c["mode"].alias("mode"), matches_of(c).alias("n")))


def default_candidate(cands: Column) -> Column:
    """Index of the first candidate matching at least two elements, else 0."""
    pos = F.array_position(F.transform(cands, lambda c: c["n"] >= 2), True)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(0)).cast("int")


def candidate_at(cands: Column, k) -> Column:
    """The candidate at level ``k`` (broader/narrower); out of range -> null."""
    return F.get(cands, k)


# --------------------------------------------------------------------------------------
# Which ancestor repeats
# --------------------------------------------------------------------------------------
ROW_TAGS = ("tr", "li", "dt", "dd")
BROAD = ("section", "article", "main", "aside", "figure")


def row_ancestor(m) -> Column:
    """The nearest tr, else li, else dt, else dd ancestor-or-self whose parent has more
    than one child of that tag (only the nearest of each tag is considered)."""
    def pick(chain):
        def ok(a):
            return (_f(a, "sib_n") > 1) & (_f(_f(a, "parent"), "child") > 0)

        nearest = [F.get(F.filter(chain, _tag_is(tag)), 0) for tag in ROW_TAGS]
        # nearest of each tag, kept only when repeated; the first tag in priority order wins
        return F.get(F.filter(F.array(*nearest), lambda a: a.isNotNull() & ok(a)), 0)

    return _let(F.reverse(ancestor_chain(m)), pick)


def repeating_ancestor(m, max_levels: int = 6) -> Column:
    """Within ``max_levels`` steps up (self included), the first element other than
    html/body that has same-tag siblings, skipping broad containers with fewer than three;
    falls back to the element itself."""
    chain = F.slice(F.reverse(ancestor_chain(m)), 1, max_levels + 1)

    def ok(a):
        t, n = _f(a, "tag"), _f(a, "sib_n")
        return ~t.isin("html", "body") & (n > 1) & ~(t.isin(*BROAD) & (n < 3))

    return F.coalesce(F.get(F.filter(chain, ok), 0), m)


# --------------------------------------------------------------------------------------
# Column templates and the guessed config
# --------------------------------------------------------------------------------------
_COL_T = "array<struct<name:string,selector:string,key:string>>"


def _cols(*pairs) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("selector"), F.lit(None).cast("string").alias("key")) for n, s in pairs]).cast(_COL_T)


def data_columns_of(a) -> Column:
    """One ``@data-*`` column per data attribute, in attribute order."""
    keys = F.map_keys(F.map_filter(F.coalesce(_f(a, "attrs"), F.create_map().cast("map<string,string>")), lambda k, v: k.startswith("data-")))
    return F.transform(keys, lambda k: F.struct(k.alias("name"), F.concat(F.lit("@"), k).alias("selector"), F.lit(None).cast("string").alias("key"))).cast(_COL_T)


def _nearest(a, tag: str) -> Column:
    return F.get(F.filter(F.reverse(ancestor_chain(a)), _tag_is(tag)), 0)


def _table_columns(a) -> Column:
    """tr template: ``*[i]`` columns named by the row's table headers."""
    def with_headers(hdr):
        n = F.greatest(F.size(hdr), F.size(_children(a, _tag_is("th", "td"))))
        return F.transform(
            _rng(F.lit(1), n),
            lambda i: F.struct(
                F.coalesce(F.nullif(js_trim(_text(F.get(hdr, i - 1))), F.lit("")), F.concat(F.lit("Column "), i.cast("string"))).alias("name"),
                F.concat(F.lit("*["), i.cast("string"), F.lit("]")).alias("selector"),
                F.concat(F.lit("col"), i.cast("string")).alias("key"),
            ),
        )

    hdrs = _let(_nearest(a, "table"), lambda t: F.when(t.isNotNull(), table_headers(t, a)).otherwise(F.array().cast("array<int>")))
    return _let(hdrs, with_headers).cast(_COL_T)


def _table_template(a) -> Column:
    caption = F.exists(_desc(a), _tag_is("caption"))
    ths = F.filter(_desc(a), _tag_is("th"))
    cols = F.filter(_desc(a), _tag_is("col"))
    th_cols = F.transform(ths, lambda t, i: F.struct(
        F.coalesce(F.nullif(js_trim(_text(t)), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string"))).alias("name"),
        F.concat(F.lit(".//tr/td["), (i + 1).cast("string"), F.lit("]")).alias("selector"),
        F.lit(None).cast("string").alias("key"),
    )).cast(_COL_T)
    col_cols = F.transform(cols, lambda c, i: F.struct(
        F.concat(F.lit("Col "), (i + 1).cast("string"), F.lit(" Span")).alias("name"),
        F.concat(F.lit(".//col["), (i + 1).cast("string"), F.lit("]/@span")).alias("selector"),
        F.lit(None).cast("string").alias("key"),
    )).cast(_COL_T)
    return F.concat(
        F.when(caption, _cols(("Caption", "caption"))).otherwise(F.array().cast(_COL_T)),
        th_cols, _cols(("Col Count", "count(col)")), col_cols, data_columns_of(a),
    )


def guess_columns(a) -> Column:
    """The column template for element ``a`` by its tag (plus G12 data columns)."""
    tag = _f(a, "tag")
    d = data_columns_of(a)
    heading = F.get(F.filter(_desc(a), lambda m: _f(m, "tag").isin("h1", "h2", "h3", "h4", "h5", "h6")), 0)
    itype = F.coalesce(F.try_element_at(_f(a, "attrs"), F.lit("type")), F.lit(""))
    parent_tag = _f(_f(a, "parent"), "tag")
    none = F.array().cast(_COL_T)
    # Template column names and selectors per tag.
    return (
        F.when(tag == "tr", _table_columns(a))
        .when(tag == "a", F.concat(_cols(("Anchor text", "."), ("URL", "@href"), ("Rel", "@rel"), ("Target", "@target")), d))
        .when(tag == "img", F.concat(_cols(("Alt Text", "@alt"), ("Source", "@src"), ("Title", "@title")), d))
        .when(tag == "button", F.concat(_cols(("Text", "."), ("Value", "@value"), ("ARIA Label", "@aria-label"), ("Disabled", "@disabled")), d))
        .when(tag == "input", F.concat(
            _cols(("Value", "@value"), ("Placeholder", "@placeholder"), ("Name", "@name"), ("Type", "@type")), d,
            F.when(itype.isin("checkbox", "radio"), _cols(("Checked", "@checked"))).otherwise(none)))
        .when(tag == "textarea", F.concat(_cols(("Value", "."), ("Placeholder", "@placeholder"), ("Name", "@name")), d))
        .when(tag == "select", F.concat(_cols(("Selected Option", "option[@selected]"), ("Name", "@name")), d))
        .when(tag == "dt", F.concat(_cols(("Term", "."), ("Definition", "./following-sibling::dd")), d))
        .when(tag == "li", F.concat(_cols(("List Item", ".")), d))
        .when(tag.isin("h1", "h2", "h3", "h4", "h5", "h6"), F.concat(_cols(("Heading", "."), ("ARIA Label", "@aria-label")), d))
        .when(tag.isin("article", "section", "main", "aside"), F.concat(
            _cols(("Text", "."), ("ARIA Label", "@aria-label")),
            F.when(heading.isNotNull(), F.array(F.struct(F.lit("Headline").alias("name"), _f(heading, "tag").alias("selector"), F.lit(None).cast("string").alias("key")))).otherwise(none).cast(_COL_T),
            d))
        .when(tag == "figure", F.concat(_cols(
            ("Image Source", ".//img/@src"), ("Image Alt", ".//img/@alt"), ("Image Title", ".//img/@title"), ("Caption", "figcaption"),
            ("Code", "pre|code"), ("Blockquote", "blockquote"), ("Paragraph", "p"), ("Figure Text", ".")), d))
        .when(tag == "blockquote", F.concat(_cols(("Quote", "."), ("Citation", "@cite"), ("Footer", "footer"), ("Cite Element", "cite")), d))
        .when(tag.isin("pre", "code"), F.concat(
            _cols(("Code", "."), ("Language", "@data-language"), ("Class", "@class")), d,
            F.when(parent_tag == "figure", _cols(("Caption", "figcaption"))).otherwise(none)))
        .when(tag.isin("colgroup", "col"), F.concat(_cols(("Span", "@span"), ("Class", "@class"), ("Style", "@style")), d))
        .when(tag == "table", _table_template(a))
        .when(tag.isin("ul", "ol"), F.concat(_cols(("List Item", "li")), d))
        .when(tag == "dl", F.concat(_cols(("Term", "dt"), ("Definition", "dd")), d))
        .when(tag == "form", F.concat(_cols(("Action", "@action"), ("Method", "@method"), ("Input Names", ".//input/@name"), ("Input Types", ".//input/@type")), d))
        .when(tag == "nav", F.concat(_cols(("Text", "."), ("ARIA Label", "@aria-label"), ("Links", "a/@href")), d))
        .when(tag.isin("header", "footer"), F.concat(_cols(("Text", "."), ("ARIA Label", "@aria-label")), d))
        .when(tag.isin("video", "audio"), F.concat(_cols(("Source", "source/@src"), ("Poster", "@poster"), ("Controls", "@controls"), ("Captions", "track/@src")), d))
        .when(tag == "details", F.concat(_cols(("Summary", "summary"), ("Details", ".")), d))
        .when(tag == "summary", F.concat(_cols(("Summary", ".")), d))
        .otherwise(F.concat(
            F.when(F.coalesce(F.map_contains_key(_f(a, "attrs"), F.lit("aria-label")), F.lit(False)), _cols(("ARIA Label", "@aria-label"))).otherwise(none),
            _cols(("Text", ".")), d))
    )


def guess_ancestor(m) -> Column:
    """G13 first step: G7's repeating row ancestor, else G8's repeating ancestor."""
    return F.coalesce(row_ancestor(m), repeating_ancestor(m))


def guess_config_at(m) -> Column:
    """``STRUCT<main_selector, path STRUCT<xpath, segs, mode>, table INT, ancestor INT,
    columns>`` for element ``m``. For a row inside a table the selector is
    ``(//table)[k]//tr[td]`` (``table`` = that table's pre); otherwise the minimal path."""
    def build(a):
        def with_table(table):
            k = F.size(F.filter(_rng(F.lit(1), table - 1), _tag_is("table"))) + 1

            def with_path(mp):
                sel = F.when(table.isNotNull(), F.concat(F.lit("(//table)["), k.cast("string"), F.lit("]//tr[td]"))).otherwise(mp["xpath"])
                return F.struct(sel.alias("main_selector"), mp.alias("path"), table.alias("table"), a.alias("ancestor"), guess_columns(a).alias("columns"))

            return _let(minimal_path(a), with_path)

        return _let(F.when(_f(a, "tag") == "tr", _nearest(a, "table")), with_table)

    return _let(guess_ancestor(m), build)


def guess_config_for(dom: DataFrame, selector: str) -> DataFrame:
    """Per page, columns guessed from the FIRST element the selector matches; the
    selector itself is kept. ``(page_id, main_selector, columns, error)``; error is
    'Missing mainSelector' for a blank selector, 'No elements found for selector' when
    the page has no match."""
    _deep_plans(dom)
    from gleaner.operators.extract import matched_nodes

    if not selector or not selector.strip():
        return dom.select("page_id", F.lit(selector).alias("main_selector"), F.lit(None).cast(_COL_T).alias("columns"),
                          F.lit("Missing mainSelector").alias("error"))
    first = F.get(matched_nodes(selector), 0)
    g = dom.select("page_id", "nodes", "text", first.alias("m"))
    cfg = guess_config_at(F.col("m"))
    return g.select(
        "page_id", F.lit(selector).alias("main_selector"),
        F.when(F.col("m").isNotNull(), cfg["columns"]).alias("columns"),
        F.when(F.col("m").isNull(), F.lit("No elements found for selector")).alias("error"),
    )


# --------------------------------------------------------------------------------------
# Pick, quick scrape, element details
# --------------------------------------------------------------------------------------
_CHILD_TEXT_TAGS = ("figcaption", "blockquote", "p", "footer", "cite", "li", "dt", "dd", "summary", "caption",
                    "h1", "h2", "h3", "h4", "h5", "h6")


def _first_text(arr: Column) -> Column:
    return F.coalesce(js_trim(_text(F.get(arr, 0))), F.lit(""))


def _first_attr(arr: Column, name: str) -> Column:
    hits = F.filter(arr, lambda m: F.try_element_at(_f(m, "attrs"), F.lit(name)).isNotNull())
    return F.coalesce(js_trim(F.try_element_at(_f(F.get(hits, 0), "attrs"), F.lit(name))), F.lit(""))


def template_value(sel: Column, r: Column) -> Column:
    """Value at row ``r`` of a column selector produced by the G9 templates (the selector is
    data here, so each template form is evaluated directly; other selectors give '')."""
    idx = F.regexp_extract(sel, r"^\*\[(\d+)\]$", 1)
    td = F.regexp_extract(sel, r"^\.//tr/td\[(\d+)\]$", 1)
    colspan = F.regexp_extract(sel, r"^\.//col\[(\d+)\]/@span$", 1)
    desc_attr = F.regexp_extract(sel, r"^\.//(img|input)/@([a-z-]+)$", 0)
    kids = lambda *tags: _children(r, _tag_is(*tags))
    out = (
        F.when(sel == ".", F.coalesce(js_trim(_text(r)), F.lit("")))
        .when(sel.startswith("@") & ~sel.contains("("), F.coalesce(F.try_element_at(_f(r, "attrs"), F.substring(sel, 2, 1 << 20)), F.lit("")))
        .when(idx != "", _first_text(F.slice(_children(r, _elem), F.greatest(idx.cast("int"), F.lit(1)), 1)))
        .when(td != "", _first_text(F.filter(_desc(r), lambda m: (_f(m, "tag") == "td") & (_f(_f(m, "parent"), "tag") == "tr") & (_f(m, "sib") == td.cast("int")))))
        .when(colspan != "", _first_attr(F.filter(_desc(r), lambda m: (_f(m, "tag") == "col") & (_f(m, "sib") == colspan.cast("int"))), "span"))
        .when(sel == ".//img/@src", _first_attr(F.filter(_desc(r), _tag_is("img")), "src"))
        .when(sel == ".//img/@alt", _first_attr(F.filter(_desc(r), _tag_is("img")), "alt"))
        .when(sel == ".//img/@title", _first_attr(F.filter(_desc(r), _tag_is("img")), "title"))
        .when(sel == ".//input/@name", _first_attr(F.filter(_desc(r), _tag_is("input")), "name"))
        .when(sel == ".//input/@type", _first_attr(F.filter(_desc(r), _tag_is("input")), "type"))
        .when(sel == "a/@href", _first_attr(kids("a"), "href"))
        .when(sel == "source/@src", _first_attr(kids("source"), "src"))
        .when(sel == "track/@src", _first_attr(kids("track"), "src"))
        .when(sel == "count(col)", F.size(kids("col")).cast("string"))
        .when(sel == "pre|code", _first_text(kids("pre", "code")))
        .when(sel == "option[@selected]", _first_text(F.filter(kids("option"), lambda m: F.map_contains_key(_f(m, "attrs"), F.lit("selected")))))
        .when(sel == "./following-sibling::dd", _first_text(F.filter(
            _rng(_f(r, "last") + 1, _f(_f(r, "parent"), "last")),
            lambda m: (_f(m, "parent") == _f(r, "parent")) & (_f(m, "tag") == "dd"))))
        .when(sel.isin(*_CHILD_TEXT_TAGS), _first_text(_children(r, lambda m: _f(m, "tag") == sel)))
    )
    return F.when(desc_attr == "", out.otherwise(F.lit(""))).otherwise(out.otherwise(F.lit("")))


def _path_rows(cfg: Column) -> Column:
    """Rows selected by a guessed config, evaluated from the config as data (document order,
    HTML elements only)."""
    path = cfg["path"]
    by_path = F.filter(
        _rng(F.lit(1), F.size(_nodes()) - 1),
        lambda m: _f(m, "is_html") & (path["mode"] != "root") & (_f(m, "tag") == F.element_at(path["segs"], -1)["tag"])
        & F.when(path["mode"] == "abs", _f(m, "depth") == F.size(path["segs"])).otherwise(_f(m, "depth") >= F.size(path["segs"]))
        & _chain_matches(m, path["segs"]),
    )
    by_table = F.filter(_table_rows(cfg["table"]), lambda m: _f(m, "is_html"))
    return F.when(cfg["table"].isNotNull(), by_table).otherwise(by_path)


def _scrape(dom: DataFrame, selector: str, config) -> DataFrame:
    """Scrape each page with the config that ``config(m)`` gives for the first element the
    selector matches. Pages without a match or without rows are skipped."""
    _deep_plans(dom)
    from gleaner.operators.extract import matched_nodes

    first = F.get(matched_nodes(selector), 0)
    base = dom.select("page_id", "nodes", "text", first.alias("m")).filter(F.col("m").isNotNull())
    plan = _let(config(F.col("m")), lambda c: F.struct(c["main_selector"].alias("main_selector"), c["columns"].alias("columns"), _path_rows(c).alias("rows")))
    g = base.select("page_id", "nodes", "text", plan.alias("plan")).filter(F.size("plan.rows") > 0)
    cells = F.transform("plan.rows", lambda r: F.transform("plan.columns", lambda c: template_value(c["selector"], r)))
    r = g.select("page_id", F.col("plan.main_selector").alias("main_selector"), F.col("plan.columns").alias("columns"), F.posexplode(cells).alias("original_index", "cells"))
    c = r.select("page_id", "main_selector", "original_index", F.posexplode(F.arrays_zip("columns", "cells")).alias("col_pos", "c"))
    return c.select(
        "page_id", "main_selector", F.col("original_index").cast("int"), F.col("col_pos").cast("int"),
        F.col("c.columns.name").alias("name"), F.coalesce(F.col("c.columns.key"), F.col("c.columns.name")).alias("key"), F.col("c.cells").alias("value"),
    )


def pick_and_extract(dom: DataFrame, selector: str, level: int | None = None) -> DataFrame:
    """G15 per page: the element picked by ``selector`` (first match) gives the candidate
    selector (G4/G5, or ``level``), which always replaces the guessed one, and the guessed
    columns (G13); the page is then scraped with that config.
    Long form: ``(page_id, main_selector, original_index, col_pos, name, key, value)``."""
    def config(m):
        def with_cands(cands):
            pick = F.lit(level) if level is not None else default_candidate(cands)
            chosen = F.coalesce(F.get(cands, pick), F.get(cands, 0))
            return F.struct(
                chosen["xpath"].alias("main_selector"),
                F.struct(chosen["xpath"].alias("xpath"), chosen["segs"].alias("segs"), chosen["mode"].alias("mode")).alias("path"),
                F.lit(None).cast("int").alias("table"), _let(guess_ancestor(m), guess_columns).alias("columns"),
            )

        return _let(selector_candidates(m), with_cands)

    return _scrape(dom, selector, config)


def quick_scrape(dom: DataFrame, selector: str) -> DataFrame:
    """G16 per page: scrape with the config guessed (G13) from the clicked element (first
    match), its own selector included. Columns as :func:`pick_and_extract`."""
    return _scrape(dom, selector, guess_config_at)


def element_details(dom: DataFrame, selector: str) -> DataFrame:
    """For the first element matched on each page: its minimal path, text (as it stands,
    not trimmed), tag and, of pages that keep their source, html (the element as the page has it).
    ``(page_id, pre, tag, xpath, text[, html])``."""
    _deep_plans(dom)
    from gleaner.operators.extract import matched_nodes

    source = ["source"] if "source" in dom.columns else []
    first = F.get(matched_nodes(selector), 0)
    b = dom.select("page_id", "nodes", "text", *source, first.alias("m")).filter(F.col("m").isNotNull())
    n = _n(F.col("m"))
    html = [F.col("source").substr(n["s0"] + 1, n["s1"] - n["s0"]).cast("string").alias("html")] if source else []
    return b.select("page_id", F.col("m").alias("pre"), _f(F.col("m"), "tag").alias("tag"),
                    minimal_path(F.col("m"))["xpath"].alias("xpath"), _text(F.col("m")).alias("text"), *html)


def inference_report(dom: DataFrame, selector: str) -> DataFrame:
    """G2/G3/G4/G5/G7/G8 for the first element the selector matches on each page."""
    _deep_plans(dom)
    from gleaner.operators.extract import matched_nodes

    first = F.get(matched_nodes(selector), 0)
    b = dom.select("page_id", "nodes", "text", first.alias("m")).filter(F.col("m").isNotNull())
    b = b.select("*", selector_candidates(F.col("m")).alias("cands"))
    cands = F.col("cands")
    return b.select(
        "page_id", element_path(F.col("m")).alias("path"), minimal_path(F.col("m"))["xpath"].alias("minimal"),
        F.transform(cands, lambda c: c["xpath"]).alias("candidates"), F.transform(cands, lambda c: c["n"]).alias("candidate_matches"),
        default_candidate(cands).alias("default_index"),
        _f(row_ancestor(F.col("m")), "tag").alias("row_ancestor_tag"),
        _f(repeating_ancestor(F.col("m")), "tag").alias("repeating_ancestor_tag"),
    )
