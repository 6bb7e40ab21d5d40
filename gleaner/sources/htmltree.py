"""Per-page helper: HTML source -> flat pre-order node list (runs inside Spark tasks).

The tree rules are a small subset of the HTML5 tree builder: implied html/head/body,
implied tbody/tr/colgroup in tables, void elements, implied end tags (p, li, dt/dd,
tr/td/th, option, table sections), end tags that do not match an open element are
ignored, script/style keep raw text, the first of duplicate attributes wins, SVG/MathML
subtrees are marked as non-HTML. Formatting-element reconstruction and foster parenting
are not done (an unclosed <b> closes with its paragraph).

Node kinds: '#document' (pre 0), elements (lower-case tag), '#text', '#comment'.
``text`` is the document-order concatenation of all text nodes, so an element's
textContent is ``text[t0:t1]``; the text is UTF-8 and offsets are bytes, so a value is cut out
without walking the page. ``s0`` and ``s1`` are the bytes of the source that an element was read from, its
tags included (an element that the source only implies has those of what it holds).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# Fixed values from the HTML standard (element categories used by the tree rules).
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr keygen".split()
)
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search "
    "section summary table ul li dd dt listing xmp plaintext".split()
)
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption "
    "center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li "
    "link listing main marquee menu meta nav noembed noframes noscript object ol p param "
    "plaintext pre script search section select source style summary table tbody td template "
    "textarea tfoot th thead title tr track ul wbr xmp".split()
)
SCOPE_STOP = frozenset("applet caption html table td th marquee object template".split())
TABLE_SECTIONS = frozenset("thead tbody tfoot".split())
FOREIGN_ROOTS = frozenset("svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = ["#document"]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.attrs: list[dict | None] = [None]
        self.last: list[int] = [0]
        self.t0: list[int] = [0]
        self.t1: list[int] = [0]
        self.s0: list[int] = [0]
        self.s1: list[int] = [0]
        self.line_at = [0]
        self.now = 0  # where the markup in hand begins in the source
        self.after = 0  # and where it ends
        self.sib: list[int] = [0]
        self.child: list[int] = [0]
        self.is_html: list[bool] = [False]
        self.texts: list[str] = []
        self.tlen = 0
        self.stack: list[int] = [0]
        self.counts: dict[int, dict[str, int]] = {0: {}}
        self.nchild: dict[int, int] = {0: 0}
        self.html = self.head = self.body = -1
        self.head_closed = False
        self.foreign = 0
        self.open_text = -1

    # -- node creation ---------------------------------------------------------------
    def _add(self, tag: str, attrs: dict | None, html_flag: bool) -> int:
        par = self.stack[-1]
        i = len(self.tag)
        self.tag.append(tag)
        self.parent.append(par)
        self.depth.append(self.depth[par] + 1)
        self.attrs.append(attrs)
        self.last.append(i)
        self.t0.append(self.tlen)
        self.t1.append(self.tlen)
        self.s0.append(self.now)
        self.s1.append(self.after)
        c = self.counts[par]
        c[tag] = c.get(tag, 0) + 1
        self.sib.append(c[tag])
        if tag[0] != "#":
            self.nchild[par] += 1
            self.child.append(self.nchild[par])
            self.counts[i] = {}
            self.nchild[i] = 0
        else:
            self.child.append(0)
        self.is_html.append(html_flag)
        self.open_text = -1
        return i

    def _open(self, tag: str, attrs: dict | None = None, html_flag: bool = True) -> int:
        i = self._add(tag, attrs or {}, html_flag)
        self.stack.append(i)
        return i

    def _pop(self, closed_at: int | None = None) -> int:
        i = self.stack.pop()
        self.last[i] = len(self.tag) - 1
        self.t1[i] = self.tlen
        self.s1[i] = max(self.s0[i], self.now if closed_at is None else closed_at)
        self.open_text = -1
        if self.foreign and self.tag[i] in FOREIGN_ROOTS and self._foreign_root(i):
            self.foreign -= 1
        return i

    def _foreign_root(self, i: int) -> bool:
        p = self.parent[i]
        return p < 0 or self.is_html[p] or self.tag[p][0] == "#"

    def _pop_to(self, pos: int) -> None:
        while len(self.stack) > pos:
            self._pop()

    def _find(self, names, stop=SCOPE_STOP) -> int:
        """Stack position of the nearest open element named in ``names`` within scope."""
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[k]]
            if t in names:
                return k
            if t in stop:
                return -1
        return -1

    # -- implied structure -------------------------------------------------------------
    def _ensure_html(self) -> None:
        if self.html < 0:
            self.html = self._open("html")

    def _ensure_head(self) -> None:
        self._ensure_html()
        if self.head < 0:
            self.head = self._open("head")

    def _ensure_body(self) -> None:
        self._ensure_head()
        if self.body < 0:
            if not self.head_closed:
                k = self.stack.index(self.head) if self.head in self.stack else -1
                if k > 0:
                    self._pop_to(k)
                self.head_closed = True
            self.body = self._open("body")

    def _in_head_mode(self) -> bool:
        return self.body < 0 and not self.head_closed

    # -- parser callbacks --------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, True)

    def _here(self, length: int) -> None:
        line, column = self.getpos()
        self.now = self.line_at[line - 1] + column
        self.after = self.now + length

    def _start(self, tag: str, attrs, self_closing: bool) -> None:
        self._here(len(self.get_starttag_text() or ""))
        amap: dict[str, str] = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        if self.foreign:
            self._open(tag, amap, False)
            if self_closing:
                self._pop(self.after)
            return
        if tag == "html":
            if self.html < 0:
                self.html = self._open("html", amap)
            return
        if tag == "head":
            self._ensure_html()
            if self.head < 0 and self.body < 0:
                self.head = self._open("head", amap)
            return
        if tag == "body":
            if self.body < 0:
                self._ensure_head()
                if not self.head_closed:
                    k = self.stack.index(self.head) if self.head in self.stack else -1
                    if k > 0:
                        self._pop_to(k)
                    self.head_closed = True
                self.body = self._open("body", amap)
            return
        if self.body < 0 and tag in HEAD_ONLY and not self.head_closed:
            self._ensure_head()
        else:
            self._ensure_body()
        self._implied_ends(tag)
        if tag in FOREIGN_ROOTS:
            self.foreign += 1
            self._open(tag, amap, False)
            if self_closing:
                self._pop(self.after)
            return
        self._open(tag, amap)
        if tag in VOID:
            self._pop(self.after)

    def _implied_ends(self, tag: str) -> None:
        if tag in CLOSES_P:
            k = self._find(("p",), SCOPE_STOP | {"button"})
            if k > 0:
                self._pop_to(k)
        if tag == "li":
            self._close_list_item(("li",))
        elif tag in ("dt", "dd"):
            self._close_list_item(("dt", "dd"))
        elif tag in HEADINGS:
            top = self.tag[self.stack[-1]]
            if top in HEADINGS:
                self._pop()
        elif tag in ("option", "optgroup"):
            if self.tag[self.stack[-1]] == "option":
                self._pop()
            if tag == "optgroup" and self.tag[self.stack[-1]] == "optgroup":
                self._pop()
        elif tag in TABLE_SECTIONS or tag in ("caption", "colgroup"):
            k = self._find(("table",), frozenset(("html", "template")))
            if k > 0:
                self._pop_to(k + 1)
        elif tag == "tr":
            k = self._find(("tr",), frozenset(("table", "html", "template")))
            if k > 0:
                self._pop_to(k)
            if self.tag[self.stack[-1]] == "table":
                self._open("tbody")
        elif tag in ("td", "th"):
            k = self._find(("td", "th"), frozenset(("table", "html", "template")))
            if k > 0:
                self._pop_to(k)
            top = self.tag[self.stack[-1]]
            if top == "table":
                self._open("tbody")
                top = "tbody"
            if top in TABLE_SECTIONS:
                self._open("tr")
        elif tag == "col":
            if self.tag[self.stack[-1]] == "table":
                self._open("colgroup")
        elif tag == "a":
            k = self._find(("a",))
            if k > 0:
                self._pop_to(k)

    def _close_list_item(self, names) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[k]]
            if t in names:
                self._pop_to(k)
                return
            if t in SPECIAL and t not in ("address", "div", "p"):
                return

    def handle_endtag(self, tag):
        self._here(0)
        end = self.rawdata.find(">", self.now)
        self.after = end + 1 if end >= 0 else len(self.rawdata)
        self._end(tag)

    def _close(self, pos: int) -> None:
        """Close down to a stack position, whose element the end tag in hand belongs to."""
        self._pop_to(pos + 1)
        self._pop(self.after)

    def _end(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head >= 0 and self.head in self.stack:
                self._close(self.stack.index(self.head))
                self.head_closed = True
            return
        if tag == "p" and not self.foreign and self._find(("p",), SCOPE_STOP | {"button"}) < 0:
            self._ensure_body()
            self._open("p")
            self._pop(self.after)
            return
        if not self.foreign and (tag in SPECIAL or tag in FORMATTING):
            # End tag of a known element: close it when open in scope, else ignore.
            if tag in HEADINGS:
                names, stop = HEADINGS, SCOPE_STOP
            elif tag in TABLE_PARTS:
                names, stop = (tag,), frozenset(("html", "template"))
            elif tag == "li":
                names, stop = (tag,), SCOPE_STOP | {"ol", "ul"}
            else:
                names, stop = (tag,), SCOPE_STOP
            k = self._find(names, stop)
            if k > 0:
                self._close(k)
            return
        for k in range(len(self.stack) - 1, 0, -1):
            i = self.stack[k]
            t = self.tag[i]
            if t == tag:
                self._close(k)
                return
            if self.is_html[i] and t in SPECIAL:
                return

    def handle_data(self, data):
        if not data:
            return
        self._here(0)
        top = self.stack[-1]
        if self.foreign or top not in (0, self.html, self.head):
            self._text(data)
            return
        # Text directly under the document, html or head: whitespace stays out of the
        # tree (kept inside head), anything else opens the body.
        stripped = data.lstrip(" \t\n\r\f")
        if not stripped:
            if top == self.head and self.head >= 0:
                self._text(data)
            return
        self._ensure_body()
        self._text(stripped)

    def _text(self, data: str) -> None:
        if self.open_text >= 0:
            self._keep(data)
            self.t1[self.open_text] = self.tlen
            return
        i = self._add("#text", None, False)
        self._keep(data)
        self.t1[i] = self.tlen
        self.open_text = i

    def _keep(self, data: str) -> None:
        self.texts.append(data)
        self.tlen += len(data) if data.isascii() else len(data.encode())

    def handle_comment(self, data):
        self._add("#comment", None, False)

    def unknown_decl(self, data):
        self._add("#comment", None, False)

    def parse_html_declaration(self, i):
        # declarations the tokenizer does not know are bogus comments, as in a browser
        raw = self.rawdata
        if raw[i : i + 4] == "<!--" or raw[i : i + 9].lower() == "<!doctype":
            return super().parse_html_declaration(i)
        if raw[i : i + 9] == "<![CDATA[":
            return super().parse_html_declaration(i)
        if self.ending and raw.find(">", i) < 0:  # open to the page's end
            self._add("#comment", None, False)
            return len(raw)
        return self.parse_bogus_comment(i)

    ending = False

    def finish(self, length: int) -> None:
        self.ending = True
        self.close()
        self.now = self.after = length
        self._ensure_body()
        self._pop_to(1)
        self.last[0] = len(self.tag) - 1
        self.t1[0] = self.tlen
        self.s1[0] = length


def _source_bytes(html: str, at: list[int]) -> list[int]:
    """Places in the source as bytes of its UTF-8."""
    if html.isascii():
        return at
    points = np.frombuffer(html.encode("utf-32-le"), np.uint32)
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(sizes)])[at].tolist()


def parse_html(html: str | None) -> dict:
    """Parse one page; returns column lists (one entry per node) plus the page text."""
    b = _Builder()
    source = html or ""
    b.line_at = [0, *[m.end() for m in re.finditer("\n", source)]]
    if html:
        b.feed(html)
    b.finish(len(source))
    n = len(b.tag)
    sib_n = [0] * n
    counts = b.counts
    for i in range(1, n):
        sib_n[i] = counts[b.parent[i]][b.tag[i]]
    return {
        "text": "".join(b.texts).encode(),
        "s0": _source_bytes(source, b.s0),
        "s1": _source_bytes(source, b.s1),
        "tag": b.tag,
        "parent": b.parent,
        "depth": b.depth,
        "attrs": b.attrs,
        "last": b.last,
        "t0": b.t0,
        "t1": b.t1,
        "sib": b.sib,
        "sib_n": sib_n,
        "child": b.child,
        "is_html": b.is_html,
    }
