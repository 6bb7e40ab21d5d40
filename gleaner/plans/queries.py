"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame over the
supplied tables (or data Spark derives from them), with flat, aliased columns that match
the DuckDB oracle SQL in :mod:`gleaner.plans.oracles`."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import extract as X
from gleaner.plans import presets as P
from gleaner.operators import infer as G
from gleaner.sources import render as R
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources.dom import html_parts, parse_dom, read_dom, write_dom

_STORED: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(spark: SparkSession, sf_dir: str, kind: str, pages: Callable[[], DataFrame]) -> DataFrame:
    """Parsed pages, written to the shared folder by the first query of an application that needs them; of kind
    'source' with their source."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#{kind}")
    if key not in _STORED:
        path, raw = _folder(spark, "dom"), pages()
        parts = max(spark.sparkContext.defaultParallelism, html_parts(raw))
        write_dom(parse_dom(raw, min_partitions=parts, source=kind == "source"), path)
        _STORED[key] = path
    return read_dom(spark, _STORED[key])


def pages_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pages of ``sf_dir``."""
    return _stored(spark, sf_dir, "pages", lambda: table(spark, sf_dir, "pages"))


def derived_dom(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Pages rendered from a relational table (``customer`` or ``part``), parsed."""
    render = {"customer": R.customer_pages, "part": R.part_table_pages}[kind]
    return _stored(spark, sf_dir, kind, lambda: render(table(spark, sf_dir, kind)))


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def snake_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(snake(c)) for c in df.columns])


def _preset_q(pid: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return snake_columns(P.preset(pages_dom(spark, sf_dir), pid))

    q.__name__ = pid.replace("-", "_")
    return q


internal_links = _preset_q("sys-internal-links")
dofollow_links = _preset_q("sys-dofollow-links")
headings = _preset_q("sys-headings")
demo_links = _preset_q("demo-links")
nofollow_links = _preset_q("sys-nofollow-links")
external_links = _preset_q("sys-external-links")


def all_presets_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14: all eleven system presets in one pass, one row per extracted cell."""
    return P.presets_long(pages_dom(spark, sf_dir))


def nav_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``.//a/@href`` evaluated from every ``//nav`` (scoped value selection)."""
    return X.select_values(pages_dom(spark, sf_dir), ".//a/@href", within="//nav").select(
        "page_id", F.col("context_index").cast("int"), F.col("value_index").cast("int"), "value"
    )


def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-page match counts of several selectors in one scan."""
    dom = pages_dom(spark, sf_dir)
    sels = {"li_count": "//li", "a_count": "//a", "p_count": "//p", "nav_li_count": "//nav/ul/li"}
    return dom.select(
        "page_id", *[F.size(X.matched_nodes(s, html_only=False)).cast("long").alias(k) for k, s in sels.items()]
    )


def selector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total matches of a selector over all pages (partial sums, one merge)."""
    return X.validate_selector(pages_dom(spark, sf_dir), "//article/p").select("selector", "match_count")


def ad_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 with an attribute-equality row predicate (R14) and text + class columns."""
    cfg = X.ScrapeConfig.of('//div[@class="ad"]', [("Text", "."), ("Class", "@class")])
    return snake_columns(X.extract(pages_dom(spark, sf_dir), cfg))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute child path (R8) with string functions: title text and its length."""
    cfg = X.ScrapeConfig.of(
        "/html/head/title",
        [("Title", "."), ("Title Length", "string-length(.)"), ("First Word", 'substring-before(concat(normalize-space(.), " "), " ")')],
    )
    return snake_columns(X.extract(pages_dom(spark, sf_dir), cfg))


def nav_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and siblings: 2nd..4th nav item, its link, the next item's text."""
    cfg = X.ScrapeConfig.of(
        "//nav/ul/li[position() >= 2 and position() <= 4]",
        [("Item", "."), ("Href", "a/@href"), ("Next", "following-sibling::li[1]"), ("Pos", "count(preceding-sibling::li) + 1")],
    )
    return snake_columns(X.extract(pages_dom(spark, sf_dir), cfg))


def _rt_preset_q(pid: str, kind: str = "customer"):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return snake_columns(P.preset(derived_dom(spark, sf_dir, kind), pid))

    q.__name__ = "rt_" + pid.replace("-", "_")
    return q


def rt_social_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 plus the cleaned platform column (the bug-compatible one is kept)."""
    return snake_columns(P.with_platform_clean(P.preset(derived_dom(spark, sf_dir, "customer"), "sys-social-media-links")))


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table cell of the part pages with its guessed header."""
    return G.extract_tables(derived_dom(spark, sf_dir, "part"))


def part_table_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guessed row config of each table, one row per column."""
    cfg = G.table_config(derived_dom(spark, sf_dir, "part"))
    return cfg.select(
        "page_id", F.col("table_index").cast("int"), "main_selector",
        F.posexplode("columns").alias("col_pos", "c"),
    ).select("page_id", "table_index", "main_selector", F.col("col_pos").cast("int"),
             F.col("c.name").alias("name"), F.col("c.selector").alias("selector"), F.col("c.key").alias("key"))


QUERIES = {
    "rt_nofollow_links": _rt_preset_q("sys-nofollow-links"),
    "rt_sponsored_links": _rt_preset_q("sys-sponsored-links"),
    "rt_ugc_links": _rt_preset_q("sys-ugc-links"),
    "rt_dofollow_links": _rt_preset_q("sys-dofollow-links"),
    "rt_images": _rt_preset_q("sys-images"),
    "rt_external_links": _rt_preset_q("sys-external-links"),
    "rt_internal_links": _rt_preset_q("sys-internal-links"),
    "rt_social_links": rt_social_links,
    "rt_forms": _rt_preset_q("sys-forms"),
    "rt_buttons": _rt_preset_q("sys-buttons-cta"),
    "rt_demo_table": _rt_preset_q("demo-table", "part"),
    "part_tables": part_tables,
    "part_table_configs": part_table_configs,
    "internal_links": internal_links,
    "dofollow_links": dofollow_links,
    "headings": headings,
    "demo_links": demo_links,
    "nofollow_links": nofollow_links,
    "external_links": external_links,
    "all_presets_cells": all_presets_cells,
    "nav_link_targets": nav_link_targets,
    "element_counts": element_counts,
    "selector_validation": selector_validation,
    "ad_blocks": ad_blocks,
    "page_titles": page_titles,
    "nav_items": nav_items,
}


# ---- view, aggregates, windows (V*, L*, A*, W*) ------------------------------------------
from gleaner.operators import events as E  # noqa: E402
from gleaner.operators import urls as U  # noqa: E402
from gleaner.operators import view as V  # noqa: E402
from gleaner.streaming import sessions as S  # noqa: E402


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article paragraphs with their bold lead-in (blank for most, so rows can be empty)."""
    cfg = X.ScrapeConfig.of("//article/p", [("Bold", "b")])
    return X.extract(pages_dom(spark, sf_dir), cfg)


def paragraph_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1/A2: rows, empty rows and non-empty rows per page."""
    return V.row_counts(_paragraphs(spark, sf_dir))


def paragraph_display_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 + W2: the 1-based '#' shown for each non-empty row."""
    return V.with_display_index(_paragraphs(spark, sf_dir)).select("page_id", "original_index", "display_index", F.col("Bold").alias("bold"))


def paragraph_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + F22: panel column widths (first 50 shown rows, 7 px/char, pad 20, 80..300)."""
    return V.column_widths(_paragraphs(spark, sf_dir), sample=50, char_px=7, pad=20, lo=80, hi=300)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snake_columns(P.preset(pages_dom(spark, sf_dir), "demo-links"))


def link_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2/V4: global case-insensitive search over the data columns (empties hidden)."""
    return V.search(_links(spark, sf_dir), "Th")


def link_page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2/L3 per page: second page of size 2 (clamped to the last page)."""
    return V.page_per_group(_links(spark, sf_dir), index=1, size=2)


def customer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 on a plain table: any column contains the term."""
    return V.search(table(spark, sf_dir, "customer"), "FURNITURE")


def orders_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + L2: global sort (text case-insensitive, numbers natively), 4th page of 20."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    s = V.sort_by(o, [("o_orderpriority", True), ("o_totalprice", False)], tiebreak=("o_orderkey",))
    return V.page_global(s, 3, 20)


def recent_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most recently used items per user (distinct, newest first)."""
    ev = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("selector"), "ts")
    return V.recent_selectors(ev, k=5)


def event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 1000 queued events per user."""
    ev = E.from_table(table(spark, sf_dir, "events"))
    return E.bounded_queue(ev, 1000).select("event_id", "user_id", "name", "ts")


def events_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 + E4 + E7: valid events with environment, context and version, denied keys removed."""
    ev, _ = E.valid_events(E.from_table(table(spark, sf_dir, "events")))
    ev = E.deny_props(E.enrich(ev, "production", "1.0.0", "background"))
    p = F.col("props")
    return ev.select(
        "event_id", "name", p["environment"].alias("environment"), p["extension_context"].alias("extension_context"),
        p["extension_version"].alias("extension_version"), p["k"].alias("k"), F.size(p).alias("n_props"),
    )


def events_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 + E3: consent stored per user (derived from the user's latest event type) decides
    drop / queue / deliver for each of the user's events."""
    ev = E.from_table(table(spark, sf_dir, "events"))
    latest = ev.groupBy("user_id").agg(F.max_by("name", F.struct("ts", "event_id")).alias("last"))
    raw = F.when(F.col("last") == "signup", F.lit("true")).when(F.col("last") == "error", F.lit("false")).when(
        F.col("last") == "view", F.lit('""')
    )
    consent = latest.select("user_id", E.consent_state(raw).alias("consent"))
    return E.route_events(ev, consent).select("event_id", "user_id", "consent", "route")


def page_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4/S5/S6/E10 on every page URL."""
    pg = table(spark, sf_dir, "pages").select("page_id", "url")
    return pg.select(
        "page_id", "url", U.is_scrapable("url").alias("scrapable"), U.rejection_pattern("url").alias("rejection"),
        U.is_http("url").alias("is_http"), U.classify_context("url").alias("context"),
    )


def tab_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write per (tab, field) over an update log (events as updates)."""
    upd = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tab_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("field"),
        F.col("props").alias("value_json"),
    )
    return S.fold_sessions(upd)


QUERIES.update({
    "paragraph_row_counts": paragraph_row_counts,
    "paragraph_display_index": paragraph_display_index,
    "paragraph_widths": paragraph_widths,
    "link_search": link_search,
    "link_page_slice": link_page_slice,
    "customer_search": customer_search,
    "orders_sorted_page": orders_sorted_page,
    "recent_event_types": recent_event_types,
    "event_queue": event_queue,
    "events_enriched": events_enriched,
    "events_routed": events_routed,
    "page_url_rules": page_url_rules,
    "tab_sessions": tab_sessions,
})


# ---- inference (G2-G8, G13-G16) --------------------------------------------------------
def nav_link_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2-G8 for the first navigation link of every page: absolute and minimal path, the
    candidate selectors with their match counts, the default pick and the repeating
    ancestors."""
    r = G.inference_report(pages_dom(spark, sf_dir), "//nav//a")
    return r.select(
        "page_id", "path", "minimal", F.array_join("candidates", " | ").alias("candidates"),
        F.array_join(F.transform("candidate_matches", lambda n: n.cast("string")), ",").alias("candidate_matches"),
        "default_index", "row_ancestor_tag", "repeating_ancestor_tag",
    )


def nav_guess_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns guessed from the first navigation link (selector kept)."""
    g = G.guess_config_for(pages_dom(spark, sf_dir), "//nav//a")
    return g.select("page_id", "main_selector", F.posexplode("columns").alias("col_pos", "c"), "error").select(
        "page_id", "main_selector", F.col("col_pos").cast("int"), F.col("c.name").alias("name"), F.col("c.selector").alias("selector"),
    )


def nav_quick_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape every page with the config guessed from its first navigation link (long
    form)."""
    return G.quick_scrape(pages_dom(spark, sf_dir), "//nav//a")


QUERIES.update({
    "nav_link_inference": nav_link_inference,
    "nav_guess_config": nav_guess_config,
    "nav_quick_scrape": nav_quick_scrape,
})


# ---- more view / sink / text operators on the supplied pages ------------------------------
from gleaner.functions import text as TX  # noqa: E402
from gleaner.sinks import writers as K  # noqa: E402


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = X.ScrapeConfig.of("/html/head/title", [("Title", ".")])
    return X.extract(pages_dom(spark, sf_dir), cfg, keep=("url",))


def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: pages whose title or URL contains the term (case-insensitive)."""
    return V.search_pages(_titles(spark, sf_dir).withColumnRenamed("Title", "title"), "Example.ORG").select("page_id", "url", "title")


def link_tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + F12: each link row as one escaped TSV line."""
    res = _links(spark, sf_dir)
    return res.select("page_id", "original_index", K.tsv_line([F.col(c) for c in ("anchor_text", "url", "rel", "target")]).alias("line"))


def link_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: rows left after the empty filter and a search, per page (nothing selected)."""
    return V.view_counts(_links(spark, sf_dir), "th")


def title_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15 + F16 + F17: truncated single-line title and the export file name for a date."""
    t = _titles(spark, sf_dir)
    ts = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    return t.select(
        "page_id", TX.truncate_cell(TX.single_line(F.col("Title")), 20).alias("short_title"),
        TX.export_name(F.col("Title"), ts).alias("export_name"),
    )


def heading_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picked element details (tag, minimal path, text) for the first h1."""
    return G.element_details(pages_dom(spark, sf_dir), "//h1").select("page_id", "tag", "xpath", "text")


QUERIES.update({
    "page_search": page_search,
    "link_tsv_lines": link_tsv_lines,
    "link_view_counts": link_view_counts,
    "title_display": title_display,
    "heading_details": heading_details,
})


# ---- committed versions, stored results, changelog state, consent (S8, S9, J1, K7, X1, X5, E1-E6) --------
import datetime as dt  # noqa: E402

from gleaner.sources import results as RS  # noqa: E402
from gleaner.sources import versions as VT  # noqa: E402
from gleaner.streaming import changelog as CL  # noqa: E402
from gleaner.streaming import consent as CO  # noqa: E402

#: Event times at which the stored versions of the queries below end.
CUTS = ("2024-01-11", "2024-01-21")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/gleaner-{name}-{uuid.uuid4().hex}"


def _props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _slices(df: DataFrame) -> list[DataFrame]:
    """Rows by event time, cut at ``CUTS``."""
    a, b = (F.lit(c).cast("timestamp_ntz") for c in CUTS)
    ts = F.col("ts").cast("timestamp_ntz")
    return [df.filter(ts < a), df.filter((ts >= a) & (ts < b)), df.filter(ts >= b)]


def _scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scrapes: a tab per user, up to two rows, an error closes the tab, a signup has no config."""
    k = _props_k()
    cell = F.array(F.col("event_type"), k.cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tab_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("//"), "event_type")).alias("main_selector"),
        F.array(F.lit("Type"), F.lit("K")).alias("columns"),
        F.array_repeat(cell, k % 3).alias("data"), (F.col("event_type") == "error").alias("closed"),
    )


def _stored_results(spark: SparkSession, sf_dir: str) -> VT.VersionedTable:
    t = RS.results_table(spark, _folder(spark, "results"))
    for part in _slices(_scrapes(spark, sf_dir)):
        RS.commit_results(t, part)
    return t


def results_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates and deletes between the stored versions, each with its rows before and after."""
    t = _stored_results(spark, sf_dir)
    feeds = [t.changes(v).withColumn("version", F.lit(v)) for v in t.versions()]
    every = feeds[0].unionByName(feeds[1]).unionByName(feeds[2])
    return every.select(
        "version", "tab_id", "change", F.col("before.seq").alias("before_seq"), F.col("after.seq").alias("after_seq"),
        F.size("before.data").alias("before_rows"), F.size("after.data").alias("after_rows"),
    )


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + J1 + K7: open tabs (customers of one segment) with their stored results, row by row, defaults filled in."""
    tab = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    url = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("https://t/"), "c_custkey"))
    tabs = tab.select(F.col("c_custkey").alias("tab_id"), url.cast("string").alias("url"), F.col("c_name").alias("title"))
    got = RS.results_with_tabs(tabs, _stored_results(spark, sf_dir))
    return got.select(
        "tab_id", "tab_url", "tab_title", "main_selector", F.array_join("columns", ",").alias("columns"),
        F.posexplode("data").alias("original_index", "cells"),
    ).select("tab_id", "tab_url", "tab_title", "main_selector", "columns", F.col("original_index").cast("int"), F.array_join("cells", ",").alias("cells"))


def session_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X3: state after a changelog of four batches with removals, merged configs, a snapshot, and
    updates behind the watermark in the last batch, which lose."""
    k = _props_k().cast("string")
    config = F.when(_props_k() % 2 == 0, F.concat(F.lit('{"mainSelector":"//a['), k, F.lit(']","columns":['), k, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"mainSelector":"//a['), k, F.lit(']"}')))
    kind = F.col("event_type")
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tab_id"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", S.CONFIG).when(kind == "error", S.REMOVED).otherwise(kind).alias("field"),
        F.when(kind == "signup", config).when(kind == "error", F.lit(None)).otherwise(F.col("props")).alias("value_json"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    withheld = F.col("seq") % 50 == 7
    t = S.session_table(spark, _folder(spark, "sessions"))
    for batch in [*_slices(ev.filter(~withheld)), ev.filter(withheld)]:
        CL.append_batch(t, batch, S.fold_updates, delay=dt.timedelta(days=7), compact_every=3, expire=S.expire_removals)
    return S.read_sessions(spark, t.path)


def _consents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events, and the consents that users give: a signup grants, an error declines, every fourth purchase takes it back."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    back = (kind == "purchase") & (F.col("event_id") % 4 == 0)
    said = (kind == "signup") & (F.col("event_id") % 3 == 0) | (kind == "error") & (F.col("event_id") % 3 == 0) | back
    consents = ev.filter(said).select(F.col("event_id").alias("consent_id"), "user_id", "ts", F.when(kind == "signup", True).when(kind == "error", False).alias("consent"))
    return ev.filter(~said).select("event_id", "user_id", "ts"), consents


def consent_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + E3 + E5 + E6: each event delivered, dropped, flushed, cleared, evicted or still queued. Queues of three
    events, kept for two days, so that both limits bind."""
    events, consents = _consents(spark, sf_dir)
    got = CO.consent_flow(events, consents, limit=3, timeout=dt.timedelta(days=2))
    return got.select("event_id", "user_id", "route", "buffered", F.col("decided_at").cast("timestamp_ntz").alias("decided_at"))


QUERIES.update({
    "results_feed": results_feed,
    "stored_results": stored_results,
    "session_changelog": session_changelog,
    "consent_flow": consent_flow,
})


# ---- inference over all groups, far pages, numbers, the preset library (G2-G13, L2, L3, W2, E5, T1-T11) ----
from gleaner.operators import groups as GR  # noqa: E402
from gleaner.operators import paging as PG  # noqa: E402
from gleaner.operators import presetstore as PS  # noqa: E402
from gleaner.sources import library as LB  # noqa: E402


def _groups(dom: DataFrame) -> DataFrame:
    return GR.repeating_groups(dom).select("page_id", "path", "tag", "n", "guess_tag", "main_selector", "matches")


def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + G3 + G7 + G8 + G13: every repeating group of every page, the ancestor and selector guessed from it."""
    return _groups(pages_dom(spark, sf_dir))


def part_page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over pages with tables: header cells, rows, and the cells of every row."""
    return _groups(derived_dom(spark, sf_dir, "part"))


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 + G5 + G6: the candidates of every link of the navigation, with what each selects."""
    chains = GR.element_chains(pages_dom(spark, sf_dir))
    last, up = F.element_at("chain", -1), F.element_at("chain", -2)
    links = chains.filter((last["tag"] == "a") & (up["tag"] == "li"))
    c = GR.candidates(chains, links)
    place = links.select("page_id", "pre", up["sib"].alias("link"))
    return c.join(place, ["page_id", "pre"]).select("page_id", F.col("link").cast("int"), "default_index", F.posexplode("candidates").alias("level", "c")).select(
        "page_id", "link", "default_index", F.col("level").cast("int"), "c.xpath", F.col("c.matches").alias("matches"))


def orders_far_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + L2 + L3 + A5: pages far into a sorted result, each read from the partitions it lies in; the last one is clamped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    path = _folder(spark, "ranked")
    PG.write_ranked(o, path, [("o_orderpriority", True), ("o_totalprice", False)], ["o_orderkey"], rows_per_part=1000)
    pages = [PG.ranked_page(spark, path, i, 20).withColumn("page", F.lit(i)) for i in (0, 49, 300, 10_000_000)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3]).select(
        "page", "display_index", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")


def events_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 + W2: each event's place in its user's queue; users above fifty events are numbered in pieces."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return PG.numbered(ev, ["user_id"], ["ts", "event_id"], name="queue_pos", limit=50).select("event_id", "user_id", "queue_pos")


def _part_presets(spark: SparkSession, sf_dir: str, keep, name) -> DataFrame:
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").filter(keep(key))
    column = F.struct(F.lit("Brand").alias("name"), F.lit(".").alias("selector"), F.lit(None).cast("string").alias("key"))
    config = F.struct(F.concat(F.lit("//p["), key.cast("string"), F.lit("]")).alias("main_selector"), F.array(column).alias("columns"))
    return p.select(F.concat(F.lit("u"), key.cast("string")).alias("id"), name.alias("name"), config.alias("config"), key.cast("long").alias("created_at"), key.cast("long").alias("seq"))


def _library(spark: SparkSession, sf_dir: str):
    """Three commits: even parts, then all divisible by three under another name, then those by five deleted."""
    lib = LB.preset_library(spark, _folder(spark, "library"))
    LB.save_presets(lib, _part_presets(spark, sf_dir, lambda k: k % 2 == 0, F.col("p_name")))
    LB.save_presets(lib, _part_presets(spark, sf_dir, lambda k: k % 3 == 0, F.concat(F.lit("new "), F.col("p_name"))))
    LB.delete_presets(lib, _part_presets(spark, sf_dir, lambda k: k % 5 == 0, F.col("p_name")))
    return lib


def preset_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + T2 + T3 + T5 + T6 + U2 + J2: the stored presets in order, then the system presets that are not hidden."""
    status = PS.hide_preset(PS.hide_preset(PS.reset_status(spark), "sys-images"), "sys-forms")
    got = LB.listed_presets(_library(spark, sf_dir), PS.system_presets(spark), status)
    return got.select("origin_rank", "added", "seq", "id", "name", "config.main_selector").withColumn(
        "main_selector", F.when(F.col("origin_rank") == 0, F.col("main_selector")))


def preset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + U3 + U5 + V6 + V7: suggestions for a term: recent selectors that are no preset's, then presets."""
    lib = LB.list_presets(_library(spark, sf_dir))
    ev = table(spark, sf_dir, "events").filter("user_id < 40")
    uses = ev.select(F.lit(0).alias("user_id"), F.concat(F.lit(" //p["), F.col("user_id").cast("string"), F.lit("] ")).alias("selector"), "ts")
    return PS.suggest(V.recent_selectors(uses, k=30), lib, " 2] ")


def preset_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 + T10 + A9 + J6: a preset file per part, good and broken in nine ways, and what importing it says."""
    k = F.col("p_partkey")
    q = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    one = lambda i, n: F.concat(F.lit('{"id":'), i, F.lit(',"name":'), n, F.lit(',"config":{"mainSelector":"//a","columns":[{"name":"T","selector":"."}]},"createdAt":1}'))
    good = one(q(k), q(F.col("p_brand")))
    wrap = lambda v, ps: F.concat(F.lit('{"version":' + v + ',"presets":['), ps, F.lit("]}"))
    both = F.concat(good, F.lit(","), one(F.lit('"sys-images"'), F.lit('"S"')))
    raw = [
        wrap("1", good), wrap("1", both), wrap("1", F.concat(good, F.lit(","), one(F.lit('""'), F.lit('"S"')))), wrap("2", good), wrap('"1"', good),
        F.concat(F.lit('{"presets":['), good, F.lit("]}")), F.lit('{"version":1}'), F.lit('{"version":1,"presets":{}}'), F.concat(good, F.lit(",")), k.cast("string"),
    ]
    text = F.element_at(F.array(*raw), (k % 10 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select(k.alias("file"), text.alias("raw"))
    return PS.validate_import(files).select("file", "error", "imported", "skipped_system", F.array_join(F.transform("presets", lambda p: p["id"]), ",").alias("ids"))


QUERIES.update({
    "page_groups": page_groups,
    "part_page_groups": part_page_groups,
    "link_candidates": link_candidates,
    "orders_far_pages": orders_far_pages,
    "events_numbered": events_numbered,
    "preset_library": preset_library,
    "preset_search": preset_search,
    "preset_imports": preset_imports,
})


# ---- rows whose limits and rules bind on the data ------------------------------------------
def heading_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading's html, as its page has it."""
    dom = _stored(spark, sf_dir, "source", lambda: table(spark, sf_dir, "pages"))
    return G.element_details(dom, "//h1").select("page_id", "html")


def event_queue_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + L8: queues of twenty events; users have up to eighty-six."""
    ev = E.from_table(table(spark, sf_dir, "events"))
    return E.bounded_queue(ev, 20).select("event_id", "user_id", "name", "ts")


def recent_types_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5 + W4 + L6: the two most recent of five kinds of events per user, one kind forgotten."""
    ev = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit(" "), "event_type").alias("selector"), "ts")
    return V.recent_selectors(V.remove_recent(ev, " click "), k=2)


def url_rules_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S5 + S6 + E10: URLs of every blocked kind, allowed ones like them, and an extension's own pages."""
    k = F.col("c_custkey")
    urls = [
        "https://a.example/", "http://a.example/webstore/", "chrome://settings", "about:blank", "chrome-extension://id/sidepanel.html", "https://chromewebstore.google.com/x",
        "file:///etc", "ftp://h/", "ftps://h/", "ws://h", "wss://h", "blob://x", "data://x", "https://chrome.google.com/webstore/a", "https://chrome.google.com/a/b/webstore/",
        "https://chrome.google.com/maps", "", "http://h", "chrome-extension://id/options.html?x=1", "chrome-extension://id/full-data-view.html", "https://a.example/popup",
    ]
    url = F.element_at(F.array(*[F.lit(u) for u in urls]), (k % len(urls) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(k.alias("id"), url.alias("url"))
    return c.select("id", U.is_scrapable("url").alias("scrapable"), U.rejection_pattern("url").alias("rejection"), U.is_http("url").alias("is_http"), U.classify_context("url").alias("context"))


def events_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 + E8 + E9: denied properties removed, user presets masked, events without a name set aside."""
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    props = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"),
        F.when(i % 2 == 0, "$referrer").otherwise("referrer"), F.lit("r"),
        F.when(i % 3 == 0, "preset_id").otherwise("x"), F.when(i % 9 == 0, "sys-images").otherwise("u1"),
        F.when(i % 3 == 1, "preset_name").otherwise("y"), F.lit("mine"),
    )
    name = F.when(i % 7 == 0, F.lit("")).when(i % 7 == 1, F.lit(None)).otherwise(F.col("event_type"))
    valid, dead = E.valid_events(ev.select("event_id", name.alias("name"), props.alias("props")))
    done = valid.withColumn("dead", F.lit(False)).unionByName(dead.withColumn("dead", F.lit(True)))
    done = E.mask_preset_props(E.deny_props(done))
    cells = F.transform(F.array_sort(F.map_keys("props")), lambda k: F.concat(k, F.lit("="), F.coalesce(F.get(F.map_values(F.map_filter("props", lambda n, _: n == k)), 0), F.lit("null"))))
    return done.select("event_id", "dead", F.array_join(cells, ";").alias("props"))


def _selection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Navigation links, and a selection: the first links of even pages, all links of pages divisible by five."""
    links = _links(spark, sf_dir)
    keys = links.filter((F.col("page_id") % 5 == 0) | (F.col("page_id") % 2 == 0) & (F.col("original_index") < 2)).select("page_id", "original_index")
    return links, keys


def links_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8 + V9 + V10: the rows an export takes: a page's selection, or all if all or none are selected."""
    links, keys = _selection(spark, sf_dir)
    return V.hide(V.rows_to_export(links, keys, show_empty=False), ["rel", "target"]).select("page_id", "original_index", "anchor_text", "url")


def links_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + V8: rows that a search leaves and how many of them are selected, per page."""
    links, keys = _selection(spark, sf_dir)
    return V.view_counts(links, "th", keys)


def links_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: empty filter, a column filter, a search, a sort and the second page of two, per page."""
    spec = V.ViewSpec(column_filters={"url": "/"}, term="e", sort=[("anchor_text", False)], page_index=1, page_size=2)
    return V.view(_links(spark, sf_dir), spec).select("page_id", "original_index", "anchor_text", "display_index")


def links_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + F13: the links as CSV, read back as lines without the headers."""
    path = _folder(spark, "csv")
    links = _links(spark, sf_dir)
    text = F.concat("anchor_text", F.when(F.col("page_id") % 3 == 0, F.lit(' "q", x')).otherwise(""))
    K.write_csv(links.withColumn("anchor_text", text), path, columns=["page_id", "original_index", "anchor_text", "url"], names=["Page", "Row", "Text", "Url"])
    return spark.read.text(path).filter("value <> '\"Page\",\"Row\",\"Text\",\"Url\"'").select(F.col("value").alias("line"))


def links_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the links as spreadsheet rows, header first."""
    return K.sheet_values(_links(spark, sf_dir).select("page_id", "original_index", "is_empty", "anchor_text", "url"), names=["Text", "Url"])


QUERIES.update({
    "heading_html": heading_html,
    "event_queue_bound": event_queue_bound,
    "recent_types_bound": recent_types_bound,
    "url_rules_mixed": url_rules_mixed,
    "events_cleaned": events_cleaned,
    "links_exported": links_exported,
    "links_selected": links_selected,
    "links_view": links_view,
    "links_csv": links_csv,
    "links_sheet": links_sheet,
})


# ---- column templates by rule ----------------------------------------------------------------
from gleaner.operators import templates as TP  # noqa: E402


def element_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 + G12 + J11: the distinct column templates of each tag on every page, of plain pages, shop pages and tables."""
    out = None
    for kind in ("pages", "customer", "part"):
        dom = pages_dom(spark, sf_dir) if kind == "pages" else derived_dom(spark, sf_dir, kind)
        cells = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit("="), c["selector"])), "|")
        one = TP.element_templates(dom).select(F.lit(kind).alias("kind"), "page_id", "tag", cells.alias("columns")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["element_templates"] = element_templates


# ---- configs as data ---------------------------------------------------------------------------
from gleaner.operators import configs as CF  # noqa: E402


def config_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 + F20: every preset's config edited in one of five ways, written as JSON and read back."""
    p = LB.list_presets(_library(spark, sf_dir))
    c, k = F.col("config"), F.col("seq")
    edited = (
        F.when(k % 5 == 1, CF.add_column(c, F.lit("  New ")))
        .when(k % 5 == 2, CF.remove_column(c, F.lit(0)))
        .when(k % 5 == 3, CF.rename_column(c, F.lit(0), F.col("name")))
        .otherwise(CF.set_selector(CF.add_column(c, F.lit(" ")), F.lit(0), F.concat(F.lit("@d"), k.cast("string"))))
    )
    j = p.select("id", CF.config_json(edited).alias("json"))
    back = CF.config_from_json(F.col("json"))
    return j.select("id", "json", F.size(back["columns"]).alias("n_columns"), back["main_selector"].alias("main_selector"))


def own_recent_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + L5: the five most recent selectors of each kind of event that are no preset's."""
    ev = table(spark, sf_dir, "events")
    uses = ev.select(F.ascii("event_type").cast("long").alias("user_id"), F.concat(F.lit(" //p["), F.col("user_id").cast("string"), F.lit("]\n")).alias("selector"), "ts")
    return V.recent_selectors(CF.own_selectors(uses, LB.list_presets(_library(spark, sf_dir))), k=5)


QUERIES.update({"config_edits": config_edits, "own_recent_selectors": own_recent_selectors})
