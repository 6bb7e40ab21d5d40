"""G2-G8, G13 for every element of every page at once: paths, minimal paths, candidates, ancestors.

``element_chains`` walks each element's parents once, inside the scan, and gives a row per element with
the chain of its ancestors; pages and texts are not carried along. After one exchange by page, into as
many partitions as the elements ask for, everything is joins and windows on a page's rows:

* A path that has lost its last indexes matches what lies below its last indexed element, the
  anchor, by tag names alone. So all counts of the first loop are sizes of the groups (page,
  anchor, relative tag path) over pairs of an element and an indexed ancestor.
* A path trimmed at its front matches by suffix. Patterns of one tag suffix differ in which places carry
  an index and in the indexes; elements are hashed once per distinct set of places, so that
  patterns and elements meet on one equal key, and a page with many alike patterns stays linear.

Nothing is built per picked element, so the plan's size does not depend on pages or depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.infer import BROAD, ROW_TAGS
from gleaner.sources.dom import parts_of

MAX_CANDIDATE_LEVELS = 10
MAX_ANCESTOR_LEVELS = 6


def element_chains(dom: DataFrame) -> DataFrame:
    """A row per element: page_id, pre, is_html, chain (array of (pre, tag, sib, sib_n) from the
    document's element to itself)."""
    node = lambda i: F.get("nodes", i)

    def chain(n: Column) -> Column:
        step = lambda acc, _: F.struct(
            F.concat(F.array(F.struct(*[node(acc["cur"])[c].alias(c) for c in ("pre", "tag", "sib", "sib_n")])), acc["up"]).alias("up"),
            node(acc["cur"])["parent"].alias("cur"),
        )
        empty = F.array().cast("array<struct<pre:int,tag:string,sib:int,sib_n:int>>")
        return F.aggregate(F.sequence(F.lit(1), n["depth"]), F.struct(empty.alias("up"), n["pre"].alias("cur")), step)["up"]

    elements = F.filter("nodes", lambda n: ~n["tag"].startswith("#") & (n["depth"] >= 1))
    rows = F.transform(elements, lambda n: F.struct(n["pre"].alias("pre"), n["is_html"].alias("is_html"), chain(n).alias("chain")))
    return dom.select("page_id", F.explode(rows).alias("e")).select("page_id", "e.*").repartition(parts_of(dom), "page_id")


def _tags(chain: Column) -> Column:
    return F.transform(chain, lambda s: s["tag"])


def _path(chain: Column, indexed: Column) -> Column:
    """Segments with an index where ``indexed`` (places from 1 up to it) and siblings ask for one."""
    seg = lambda s, i: F.concat(s["tag"], F.when((i < indexed) & (s["sib_n"] > 1), F.concat(F.lit("["), s["sib"].cast("string"), F.lit("]"))).otherwise(""))
    return F.array_join(F.transform(chain, seg), "/")


def absolute_paths(chains: DataFrame) -> DataFrame:
    """The absolute path of every element, with indexes only where needed."""
    return chains.select("page_id", "pre", F.concat(F.lit("/"), _path(F.col("chain"), F.size("chain"))).alias("path"))


def _selected(chains: DataFrame) -> DataFrame:
    """``chains`` with what the first loop ends with: ``anchor`` (place of the last index that stays, 0: none), ``selected``
    (the count it compares with, null without any index), ``n_html`` of its path."""
    size = F.size("chain")
    places = F.filter(F.sequence(F.lit(1), size), lambda p: F.get("chain", p - 1)["sib_n"] > 1)
    above = F.filter(places, lambda p: p < size)
    pairs = chains.withColumn("any_index", F.size(places) > 0).withColumn("p", F.explode(F.concat(F.array(F.lit(0)), above)))
    anchor = F.when(F.col("p") > 0, F.get("chain", F.col("p") - 1)["pre"]).otherwise(F.lit(-1))
    below = F.xxhash64(F.slice(_tags(F.col("chain")), F.col("p") + 1, size - F.col("p")))
    group = Window.partitionBy("page_id", anchor, below)
    counted = pairs.select("page_id", "pre", "any_index", "p", F.when(F.col("p") == 0, F.col("chain")).alias("chain"), F.count("*").over(group).alias("n"), F.count_if("is_html").over(group).alias("n_html"))
    plain, stops = F.col("p") == 0, (F.col("p") > 0) & (F.col("n") > 1)
    best = counted.groupBy("page_id", "pre").agg(
        F.max("any_index").alias("any_index"),
        F.max_by(F.struct("p", "n", "n_html"), F.when(stops, F.col("p"))).alias("stop"),
        F.max(F.when(plain, F.col("n_html"))).alias("n_html_plain"),
        F.first("chain", ignorenulls=True).alias("chain"),
    )
    return best.select(
        "page_id",
        "pre",
        "chain",
        F.coalesce(F.col("stop.p"), F.lit(0)).alias("anchor"),
        F.when(F.col("any_index"), F.coalesce(F.col("stop.n"), F.lit(1))).alias("selected"),
        F.coalesce(F.col("stop.n_html"), F.col("n_html_plain")).alias("n_html"),
    )


def minimal_paths(chains: DataFrame) -> DataFrame:
    """G3 for every element: page_id, pre, xpath, matches (HTML elements that it selects)."""
    size, n = F.size("chain"), F.col("n")
    suffix = lambda array, k: F.slice(array, size - k + 1, k)

    # of a suffix only its tags' hash and its indexes are carried along; its key: the indexes at ``places`` (counted from its end)
    sibs = F.transform(suffix(F.col("chain"), n), lambda s: s["sib"])

    def key(indexes: Column) -> Column:
        return F.xxhash64(F.transform(indexes, lambda s, i: F.when(F.array_contains("places", n - 1 - i), s)))

    tags = F.xxhash64(suffix(_tags(F.col("chain")), n))
    indexed = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda o: (size - o <= F.col("anchor")) & (F.get("chain", size - 1 - o)["sib_n"] > 1))
    # suffixes of the targets' paths; the one of no segment stands for the target itself and matches nothing
    most = F.when(F.col("selected").isNotNull(), size - 1).otherwise(0)
    patterns = (
        _selected(chains)
        .withColumn("n", F.explode(F.sequence(F.lit(0), most)))
        .withColumn("places", indexed)
        .withColumn("tags", tags)
        .withColumn("key", key(sibs))
        .withColumn("chain", F.when(n == 0, F.col("chain")))
    )
    shapes = patterns.filter(n > 0).select("page_id", "n", "tags", "places").distinct()
    ends = chains.select("page_id", "is_html", "chain", F.explode(F.sequence(F.lit(1), size)).alias("n"))
    ends = ends.select("page_id", "is_html", "n", tags.alias("tags"), sibs.alias("sibs"))
    found = (
        ends.join(shapes, ["page_id", "n", "tags"])
        .groupBy("page_id", "n", "tags", "places", key(F.col("sibs")).alias("key"))
        .agg(F.count("*").alias("found"), F.count_if("is_html").alias("found_html"))
    )
    # a shorter suffix matches no fewer elements, so the shortest that still matches as many is where the loop ends
    same = (n > 0) & (F.col("found") == F.col("selected"))
    own = lambda c: F.first(F.when(n == 0, F.col(c)), ignorenulls=True).alias(c)
    j = (
        patterns.join(found, ["page_id", "n", "tags", "places", "key"], "left")
        .groupBy("page_id", "pre")
        .agg(own("chain"), own("anchor"), own("selected"), own("n_html"), F.min(F.when(same, F.struct("n", "found_html"))).alias("short"))
    )
    short = F.col("short.n")
    # the last segment alone matches once: what is left of it, '/', matches the document once
    root = (F.col("selected") == 1) & (F.when(size == 1, 1).otherwise(short) == 1)
    whole = F.concat(F.lit("/"), _path(F.col("chain"), F.col("anchor")))
    kept = F.concat(F.lit("//"), _path(suffix(F.col("chain"), short), F.col("anchor") - (size - short)))
    return j.select(
        "page_id",
        "pre",
        F.when(root, "/").when(short.isNotNull(), kept).otherwise(whole).alias("xpath"),
        F.when(root, 0).when(short.isNotNull(), F.col("short.found_html")).otherwise(F.col("n_html")).cast("long").alias("matches"),
    )


def candidates(chains: DataFrame, targets: DataFrame, max_levels: int = MAX_CANDIDATE_LEVELS) -> DataFrame:
    """For each of ``targets`` (page_id, pre), the distinct minimal paths of itself and its ancestors below
    body, nearest first: page_id, pre, candidates (array of xpath, matches), default_index."""
    up = F.reverse(F.col("chain"))
    body = F.array_position(_tags(up), "body")
    below = F.slice(F.when(body > 0, F.slice(up, 1, F.greatest(body - 1, F.lit(0)).cast("int"))).otherwise(up), 1, max_levels + 1)
    levels = chains.join(targets.select("page_id", "pre"), ["page_id", "pre"], "left_semi").select("page_id", "pre", F.posexplode_outer(_pres(below)).alias("level", "of"))
    paths = minimal_paths(chains).withColumnRenamed("pre", "of")
    first = levels.join(paths, ["page_id", "of"], "left").groupBy("page_id", "pre", "xpath").agg(F.min("level").alias("level"), F.first("matches").alias("matches"))
    listed = F.array_sort(F.collect_list(F.when(F.col("xpath").isNotNull(), F.struct("level", "xpath", "matches"))))  # at most max_levels + 1
    got = first.groupBy("page_id", "pre").agg(listed.alias("c"))
    enough = F.array_position(F.transform("c", lambda x: x["matches"] >= 2), True)
    return got.select(
        "page_id",
        "pre",
        F.transform("c", lambda x: F.struct(x["xpath"].alias("xpath"), x["matches"].alias("matches"))).alias("candidates"),
        F.greatest(enough - 1, F.lit(0)).cast("int").alias("default_index"),
    )


def _pres(chain: Column) -> Column:
    return F.transform(chain, lambda s: s["pre"])


def _guess(max_levels: int) -> tuple[Column, Column]:
    """The ancestors of G7 and G8, from ``chain``: nearest repeated row (null: none), nearest repeated element or itself."""
    up = F.reverse(F.col("chain"))
    tagged = lambda tag: lambda s: s["tag"] == tag
    nearest = F.array(*[F.get(F.filter(up, tagged(t)), 0) for t in ROW_TAGS])
    row = F.get(F.filter(nearest, lambda s: s.isNotNull() & (s["sib_n"] > 1)), 0)
    repeats = lambda s: ~s["tag"].isin("html", "body") & (s["sib_n"] > 1) & ~(s["tag"].isin(*BROAD) & (s["sib_n"] < 3))
    return row, F.coalesce(F.get(F.filter(F.slice(up, 1, max_levels + 1), repeats), 0), F.element_at("chain", -1))


def ancestors(chains: DataFrame, max_levels: int = MAX_ANCESTOR_LEVELS) -> DataFrame:
    """G7 + G8 for every element: page_id, pre, ``row`` (the nearest repeated tr, else li, dt, dd), ``repeating`` (the
    nearest repeated ancestor-or-self, broad containers only from three on; else itself), ``guess`` (row, else repeating)."""
    row, repeating = _guess(max_levels)
    return chains.select("page_id", "pre", row["pre"].alias("row"), repeating["pre"].alias("repeating"), F.coalesce(row, repeating)["pre"].alias("guess"))


def repeating_groups(dom: DataFrame) -> DataFrame:
    """G13's main selector for every group of same-tag siblings of a page: page_id, pre (its first element), path (G2), tag,
    n (its elements), guess_pre, guess_tag (the ancestor that the guess takes), main_selector, matches."""
    chains = element_chains(dom)
    last = F.element_at("chain", -1)
    row, repeating = _guess(MAX_ANCESTOR_LEVELS)
    groups = chains.filter((last["sib_n"] > 1) & (last["sib"] == 1)).select(
        "page_id", "pre", F.concat(F.lit("/"), _path(F.col("chain"), F.size("chain"))).alias("path"), last["tag"].alias("tag"), last["sib_n"].cast("int").alias("n"),
        F.coalesce(row, repeating).alias("guess"),
    )
    paths = minimal_paths(chains).select("page_id", F.col("pre").alias("guess_pre"), F.col("xpath").alias("main_selector"), "matches")
    flat = groups.select("page_id", "pre", "path", "tag", "n", F.col("guess.pre").alias("guess_pre"), F.col("guess.tag").alias("guess_tag"))
    return flat.join(paths, ["page_id", "guess_pre"]).select("page_id", "pre", "path", "tag", "n", "guess_pre", "guess_tag", "main_selector", "matches")
