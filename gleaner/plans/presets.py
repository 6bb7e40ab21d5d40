"""Q1-Q14: the canned extraction configs and running them over a parsed ``dom``.

Each preset is an ordinary ``extract`` with a fixed config. ``run_presets`` evaluates
several presets in ONE pass over ``dom``: per page, the rows of every preset are built as
one array and exploded once (no union of N scans, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.extract import ColumnDef, ScrapeConfig, extract, rows_array

# ---- Fixed values: system presets (id, display name, row selector, columns) ----------
# These strings must equal the reference's so results match; they are data, not logic.
_LINK_COLS = [("Anchor text", "."), ("URL", "@href"), ("Title", "@title"), ("Rel", "@rel"), ("Target", "@target")]
SYSTEM_PRESETS: dict[str, tuple[str, ScrapeConfig]] = {
    "sys-nofollow-links": (
        "Nofollow links",
        ScrapeConfig.of('//a[contains(@rel, "nofollow")]', _LINK_COLS),
    ),
    "sys-sponsored-links": (
        "Sponsored links",
        ScrapeConfig.of('//a[contains(@rel, "sponsored")]', _LINK_COLS),
    ),
    "sys-ugc-links": (
        "UGC links",
        ScrapeConfig.of('//a[contains(@rel, "ugc")]', _LINK_COLS),
    ),
    "sys-dofollow-links": (
        "Dofollow links",
        ScrapeConfig.of(
            '//a[not(contains(@rel, "nofollow")) and not(contains(@rel, "sponsored")) and not(contains(@rel, "ugc"))]',
            [("Anchor text", "."), ("URL", ".//@href"), ("Title", ".//@title"), ("Rel", ".//@rel"), ("Target", ".//@target")],
        ),
    ),
    "sys-headings": (
        "Headings (H1-H6)",
        ScrapeConfig.of(
            "//h1 | //h2 | //h3 | //h4 | //h5 | //h6",
            [("Level", "substring(local-name(), 2)"), ("Text", "normalize-space(.)"), ("ID", "@id"), ("Class", "@class")],
        ),
    ),
    "sys-images": (
        "Images",
        ScrapeConfig.of(
            "//img",
            [("Source", "@src"), ("Alt Text", "@alt"), ("Title", "@title"), ("Width", "@width"), ("Height", "@height"), ("Loading", "@loading")],
        ),
    ),
    "sys-external-links": (
        "External Links",
        ScrapeConfig.of(
            '//a[starts-with(@href, "http")]',
            [
                ("Anchor Text", "."),
                ("URL", "@href"),
                ("Host", 'substring-before(substring-after(@href, "://"), "/")'),
                ("Rel", "@rel"),
                ("Target", "@target"),
            ],
        ),
    ),
    "sys-internal-links": (
        "Internal (relative) Links",
        ScrapeConfig.of(
            '//a[starts-with(@href, "/") or starts-with(@href, "#") or starts-with(@href, "?")]',
            [("Anchor Text", "."), ("URL", "@href"), ("Rel", "@rel"), ("Target", "@target")],
        ),
    ),
    "sys-social-media-links": (
        "Social Media Links",
        ScrapeConfig.of(
            '//a[contains(@href, "facebook.com") or contains(@href, "twitter.com") or contains(@href, "x.com") '
            'or contains(@href, "linkedin.com") or contains(@href, "instagram.com") or contains(@href, "youtube.com") '
            'or contains(@href, "tiktok.com") or contains(@href, "pinterest.com")]',
            [
                ("Platform", 'translate(substring-before(substring-after(@href, "://"), ".com"), "www.", "")'),
                ("URL", "@href"),
                ("Anchor Text", "."),
                ("Rel", "@rel"),
            ],
        ),
    ),
    "sys-forms": (
        "Forms",
        ScrapeConfig.of(
            "//form",
            [("Action", "@action"), ("Method", "@method"), ("ID", "@id"), ("Class", "@class"), ("Input Count", "count(.//input)")],
        ),
    ),
    "sys-buttons-cta": (
        "Buttons & CTAs",
        ScrapeConfig.of(
            '//button | //input[@type="submit"] | //a[contains(@class, "btn") or contains(@class, "button") or contains(@class, "cta")]',
            [
                ("Element Type", "local-name()"),
                ("Text/Value", "."),
                ("Value Attr", "@value"),
                ("Type", "@type"),
                ("Class", "@class"),
                ("Href", "@href"),
            ],
        ),
    ),
}

# The two demo configs (link list, and the first 10 data rows of a table).
DEMO_LINKS = ScrapeConfig.of("//a", [("Anchor text", "."), ("URL", "@href"), ("Rel", "@rel"), ("Target", "@target")])
DEMO_TABLE = ScrapeConfig.of(
    '//table[contains(@class, "wikitable")][1]//tr[position() > 1 and position() <= 11]',
    [
        ("Rank", "./td[1]"),
        ("Country/Territory", "./td[2]//a[1]"),
        ("Population", "./td[3]"),
        ("Percentage", "./td[4]"),
        ("Date", "./td[5]"),
    ],
)
# ---- end of fixed values ----------------------------------------------------------------

SYSTEM_IDS = tuple(SYSTEM_PRESETS)


def preset_config(preset_id: str) -> ScrapeConfig:
    if preset_id == "demo-links":
        return DEMO_LINKS
    if preset_id == "demo-table":
        return DEMO_TABLE
    return SYSTEM_PRESETS[preset_id][1]


def preset(dom: DataFrame, preset_id: str, form: str = "wide") -> DataFrame:
    """Q1-Q13: run one canned config (wide form: one column per display key)."""
    return extract(dom, preset_config(preset_id), form=form)


def with_platform_clean(res: DataFrame) -> DataFrame:
    """Q9 extra: the platform read from the host without the reference's character-level
    ``translate`` (which turns ``twitter`` into ``titter``); the original column is kept."""
    host = F.regexp_extract(F.col("URL"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:www\.)?([^/]*?)\.com", 1)
    return res.withColumn("platform_clean", host)


def run_presets(dom: DataFrame, preset_ids=SYSTEM_IDS) -> DataFrame:
    """Q14: several presets in one pass: ``(page_id, preset_id, original_index, is_empty,
    data MAP<STRING,STRING>)``. One Generate over one scan of ``dom``; nothing shuffles."""
    parts = [rows_array(preset_config(p), p) for p in preset_ids]
    allrows = F.concat(*parts) if len(parts) > 1 else parts[0]
    r = F.col("r")
    return dom.select("page_id", F.explode(allrows).alias("r")).select(
        "page_id", r["preset_id"].alias("preset_id"), r["original_index"].cast("int").alias("original_index"),
        r["is_empty"].alias("is_empty"), r["data"].alias("data"),
    )


def presets_long(dom: DataFrame, preset_ids=SYSTEM_IDS) -> DataFrame:
    """Q14 flattened to cells: ``(page_id, preset_id, original_index, is_empty, col_key,
    col_value)`` — one row per extracted cell."""
    res = run_presets(dom, preset_ids)
    return res.select(
        "page_id", "preset_id", "original_index", "is_empty", F.explode("data").alias("col_key", "col_value")
    )


__all__ = [
    "SYSTEM_PRESETS", "SYSTEM_IDS", "DEMO_LINKS", "DEMO_TABLE", "ColumnDef", "preset", "preset_config",
    "run_presets", "presets_long", "with_platform_clean",
]
