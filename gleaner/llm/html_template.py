"""Main text of web pages by equivalence-class template deduction (operator 9).

Tokens of a page are its tags, told apart by their path, and its texts, inside the article
too, told apart by path and wording; a text is what stands between two block borders. A token's occurrence vector over the pages of
its host is never built: each page has a random weight, and the sums of count x weight are
equal for equal vectors. So deduction is one aggregation by (host, page), which leaves one of
each host's equal pages, one by (host, token) with map-side combining (no host's pages meet
in one task) and one by (host, vector).

An equivalence class is valid if it is large and frequent: ``MIN_SIZE`` tokens, on at
least ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's. Valid classes nest by the paths
of their tags into the host's template. On every page the texts of valid classes are left
out, and a text's slot is its nearest enclosing template tag. Slots inside an article's
container are extracted, whole where over half of them is the template's text: such pages
repeat one article, with few words of their own; without a container, the slot with the most text that is neither template
text nor page furniture, and what stands beside it in the same element. Hosts with too few
pages for a class fall back to every tag as a possible slot.

Defined cases: a null or empty page gives ''; a null url belongs to host ''; copies of a page
on a host count as one page; a page with nothing but template texts keeps them; broken markup (open comments, tags, quotes) is read on to the end
and never raises; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from gleaner.llm.common import cut, map_columns

MIN_PAGES, MIN_SHARE, MIN_SIZE = 3, 0.5, 2
#: Templates of all hosts up to this size are broadcast, and no page is moved.
BROADCAST_BYTES = 64 << 20
#: Beyond it, the pages of the hosts with the most pages are dealt to ``SALTS`` tasks each.
HOT_HOSTS, SALTS = 10_000, 64

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)(?:>|\Z)",
    re.S,
)
#: Every attribute in turn, so that a name inside a value or a longer name is none.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_MARKS = re.compile("class|id|role|hidden|style", re.I)

#: Fixed values of the HTML standard: elements without an end tag, with raw text, and in-line ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements that end an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Page furniture by element.
FURNITURE = frozenset(
    "head script style noscript template nav header footer aside form button select textarea iframe object svg canvas menu dialog title xmp noembed noframes datalist".split()
)
#: Page furniture by a whole class, id or role.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted promotion related share sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe toolbar topbar widget complementary contentinfo search alert dialog reply replies".split()
)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def token(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


class Run:
    """A piece of text: its words as they stand, whether a block begins before it, and the block that it is in."""

    __slots__ = ("text", "breaks", "node", "furniture", "article")

    def __init__(self, text: str, breaks: bool, node: int, furniture: bool, article: bool) -> None:
        self.text, self.breaks, self.node, self.furniture, self.article = text, breaks, node, furniture, article


def marks(attrs: str) -> tuple[set[str], str, bool]:
    """The words of class, id and role, the class as it stands, and whether the element is hidden."""
    words: set[str] = set()
    mark, hidden = "", False
    if _MARKS.search(attrs):
        seen: set[str] = set()
        for a in _ATTR.finditer(attrs):
            key, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
            if key in seen:  # the first of several counts
                continue
            seen.add(key)
            if key == "class":
                mark = value
            if key in ("class", "id", "role"):
                words.update(value.split())
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
    return words, mark, hidden


class Scan:
    """A page read once: the tokens of its tags, its texts, and its blocks.

    A block knows its parent and its path's token, which is made of the parent's; so an element costs the same
    however deep it stands. In-line elements belong to the block they are in.
    """

    def __init__(self, page: str) -> None:
        self.tags: list[int] = []
        self.runs: list[Run] = []
        self.parent, self.path = [-1], [0]
        self._read(page)

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int, int, bool]] = []  # name, path, block, furniture (1 by a word, 2 by element), article
        opened: dict[str, int] = {}
        at, breaks, n = 0, True, len(page)

        def text(s: str) -> None:
            nonlocal breaks
            if s:
                _, _, block, furniture, article = stack[-1] if stack else ("", 0, 0, 0, False)
                self.runs.append(Run(entities.unescape(s), breaks, block, furniture > 0, article))
                breaks = False

        def close(name: str) -> None:
            nonlocal breaks
            if opened.get(name):
                while True:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == name:
                        break
            if name not in INLINE:
                breaks = True

        # always on from the place reached: what looks like markup inside raw text begins none
        while m := _TOKEN.search(page, at):
            text(page[at : m.start()])
            at = m.end()
            if m["end"]:
                close(m["end"].lower())
                continue
            name = (m["tag"] or m["odd"] or "").lower()
            if not name:
                continue
            if name not in INLINE:
                breaks = True
            if name in VOID:
                continue
            if name in CLOSES_P and opened.get("p"):
                close("p")
            elif name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                close(name)
            words, mark, hidden = marks(m["attrs"] or m["rest"] or "")
            _, above, block, furniture, article = stack[-1] if stack else ("", 0, 0, 0, False)
            own = name in ("article", "main") or "main" in words and name not in FURNITURE
            # a word on a wrapper does not reach the article below it; an article within an article is a comment or the like
            if own and furniture == 1 and not opened.get("article"):
                furniture = 0
            heading = name == "header" and article and not furniture  # the article's own
            if name in FURNITURE and not heading or hidden:
                furniture = 2
            elif not furniture and name not in ("html", "body", "main") and words & FURNITURE_WORDS:
                furniture = int(name != "article" or bool(words & {"comment", "comments", "reply", "replies", "ad", "ads", "promo", "sponsored"}))
            path = token("tag", str(above), f"{name}.{mark}" if mark else name)
            self.tags.append(path)
            if name not in INLINE:
                self.parent.append(block)
                self.path.append(path)
                block = len(self.path) - 1
            stack.append((name, path, block, furniture, article or own and not furniture))
            opened[name] = opened.get(name, 0) + 1
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                stop = end.start() if end else n
                text(page[at:stop])
                at = stop
        text(page[at:])


def blocks(page: Scan) -> list[tuple[int, list[Run]]]:
    """The texts between two block borders, furniture apart: their token and pieces."""
    found: dict[tuple[int, bool], list[Run]] = {}
    n = 0
    for r in page.runs:
        n += r.breaks
        found.setdefault((n, r.furniture), []).append(r)
    worded = ((rs, " ".join("".join(r.text for r in rs).split())) for rs in found.values())
    return [(token("text", str(page.path[rs[0].node]), words), rs) for rs, words in worded if words]


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, page, tags, texts): the tokens of each host's distinct pages, told apart by a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page in batch.column("html").to_pylist():
                read = Scan(page or "")
                found.append((token("page", page or ""), read.tags, [t for t, _ in blocks(read)]))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), *made], names=["host", "page", "tags", "texts"])

    each = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, page long, tags array<long>, texts array<long>")
    return each.groupBy("host", "page").agg(F.first("tags").alias("tags"), F.first("texts").alias("texts"))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, is_tag, pages, total, a, b): each token's support, count and vector sums.

    Token 0 stands for the page itself, once on each.
    """
    schema = "host string, token long, is_tag boolean, pages long, total long, a long, b long"
    part = 1 << 31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, bool], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys, values = list(sums), list(sums.values())
            cols = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], *[[v[i] for v in values] for i in range(4)]]
            types = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["host", "token", "is_tag", "pages", "total", "a", "b"])

        for batch in batches:
            for h, page, tags, texts in zip(*[batch.column(c).to_pylist() for c in ("host", "page", "tags", "texts")]):
                weight = xxhash.xxh64_intdigest(str(page))
                counts: dict[tuple[int, bool], int] = {(0, True): 1}
                for t in tags:
                    counts[t, True] = counts.get((t, True), 0) + 1
                for t in texts:
                    counts[t, False] = counts.get((t, False), 0) + 1
                for (t, is_tag), c in counts.items():
                    s = sums.setdefault((h, t, is_tag), [0, 0, 0, 0])
                    s[0] += 1
                    s[1] += c
                    s[2] = (s[2] + c * (weight & (part - 1))) % part
                    s[3] = (s[3] + c * (weight >> 33)) % part
            if len(sums) > 50_000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    each = distinct_pages(pages).mapInArrow(run, schema)
    total = [F.sum(c).alias(c) for c in ("pages", "total")] + [(F.sum(c) % part).alias(c) for c in ("a", "b")]
    return each.groupBy("host", "token", "is_tag").agg(*total)


def templates(pages: DataFrame) -> DataFrame:
    """(host, tags, texts): the tokens of each host's valid equivalence classes."""
    occ = occurrences(pages)
    # most texts stand on one page: they go before the second aggregation
    classes = occ.filter((F.col("pages") >= MIN_PAGES) & (F.col("token") != 0)).groupBy("host", "a", "b", "pages", "total").agg(
        F.collect_list(F.when(F.col("is_tag"), F.col("token"))).alias("tags"), F.collect_list(F.when(~F.col("is_tag"), F.col("token"))).alias("texts")
    ).filter(F.size("tags") + F.size("texts") >= MIN_SIZE)
    seen = pages.select(host(F.col("url")).alias("host"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("page")).distinct()
    of_host = seen.groupBy("host").agg(F.count("*").alias("host_pages"))
    # only classes on half of a host's pages are gathered: no more tokens than two of its pages have
    frequent = classes.join(of_host, "host").filter(F.col("pages") >= MIN_SHARE * F.col("host_pages"))
    return frequent.groupBy("host").agg(
        F.max("host_pages").alias("host_pages"), F.flatten(F.collect_list("tags")).alias("tags"), F.flatten(F.collect_list("texts")).alias("texts")
    )


def length(runs: list[Run]) -> int:
    return sum(len(r.text.strip()) for r in runs)


def main_text(page: str, tags: frozenset[int], texts: frozenset[int]) -> str:
    """The text of the page's article slots, without the template's texts."""
    read = Scan(page)
    runs = read.runs
    kept = [(t, r) for t, rs in blocks(read) for r in rs if not r.furniture]
    own = [r for t, r in kept if t not in texts]
    if not any(r.text.strip() for r in own):
        own = [r for _, r in kept]
    article = [r for _, r in kept if r.article]
    inside = [r for r in own if r.article]
    if 2 * length(inside) < length(article):
        inside = article
    if not inside:
        # each block's nearest template block, itself included; blocks come after their parents
        near = [0]
        for i in range(1, len(read.path)):
            near.append(i if not tags or read.path[i] in tags else near[read.parent[i]])
        slots: dict[int, int] = {}
        for r in own:
            slots[read.path[near[r.node]]] = slots.get(read.path[near[r.node]], 0) + len(r.text.strip())
        best = max(slots, key=lambda s: slots[s], default=0)
        # the largest slot's container: its headings, lists and further paragraphs stand beside it
        parents = [read.path[read.parent[i]] for i in range(1, len(read.path)) if read.path[i] == best and read.parent[i] > 0]
        around = parents[0] if parents else best
        under = [around == 0]
        for i in range(1, len(read.path)):
            under.append(read.path[i] == around or under[read.parent[i]])
        inside = [r for r in own if under[r.node]]
    parts: list[str] = []
    last: Run | None = None
    places = {id(r): i for i, r in enumerate(runs)}
    for r in inside:
        skipped = last is not None and any(x.breaks for x in runs[places[id(last)] + 1 : places[id(r)] + 1])
        if last is not None and skipped:
            parts.append(" ")
        parts.append(r.text)
        last = r
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of each page, from its host's template.

    Templates are written and measured. Up to ``broadcast_bytes`` they go to the pages; beyond, both meet by
    host, and the pages of the ``HOT_HOSTS`` hosts with the most pages by host and salt, so that no task has such a host whole.
    """
    found = cut(templates(pages).select(F.col("host").alias("__host"), F.col("tags").alias("__tags"), F.col("texts").alias("__texts"), "host_pages"))
    size = found.agg(F.sum(F.octet_length("__host") + 8 * (F.size("__tags") + F.size("__texts")) + 64)).first()[0] or 0
    plain = pages.select(*[F.col(f"`{c}`") for c in keep], F.col("html").alias("__html"), host(F.col("url")).alias("__host"))
    if size <= broadcast_bytes:
        joined = plain.join(F.broadcast(found.drop("host_pages")), "__host", "left")
    else:
        hot = found.orderBy(F.col("host_pages").desc(), "__host").limit(HOT_HOSTS).select("__host", F.lit(SALTS).alias("__salts"))
        salted = plain.join(F.broadcast(hot), "__host", "left").withColumn("__salt", F.pmod(F.xxhash64("__html"), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
        dealt = found.join(F.broadcast(hot), "__host", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
        joined = salted.join(dealt.select("__host", "__salt", "__tags", "__texts"), ["__host", "__salt"], "left")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        known: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        out = []
        tags, texts = batch.column("__tags"), batch.column("__texts")
        for i, (h, page) in enumerate(zip(batch.column("__host").to_pylist(), batch.column("__html").to_pylist())):
            if h not in known:
                known[h] = (frozenset(tags[i].as_py() or ()), frozenset(texts[i].as_py() or ()))
            out.append(main_text(page or "", *known[h]))
        return {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}

    return map_columns(joined, run, [StructField("text", StringType()), StructField("n_chars", LongType())], keep, ["__host", "__tags", "__texts", "__html"])
