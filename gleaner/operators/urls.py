"""URL eligibility, rejection reason, scheme filter, context classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URL prefixes and the pattern on which extraction is not allowed, in the
# reference's order (the first match is the reported reason).
BLOCKED_PREFIXES = [
    "chrome://",
    "about:",
    "chrome-extension://",
    "https://chromewebstore.google.com/",
    "file://",
    "ftp://",
    "ftps://",
    "ws://",
    "wss://",
    "blob://",
    "data://",
]
BLOCKED_PATTERNS = ["^https://chrome\\.google\\.com/(.+/)?webstore/"]
# Extension page contexts, tested in this order on the URL path.
CONTEXTS = [("sidepanel", "sidepanel"), ("popup", "popup"), ("options", "options"), ("onboarding", "onboarding"), ("full-data-view", "full_data_view")]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rejection_pattern(url) -> Column:
    """The first blocked prefix the URL starts with, else the first pattern it
    matches, else null (also null for a null/empty URL)."""
    u = _c(url)
    out = F.lit(None).cast("string")
    for p in reversed(BLOCKED_PATTERNS):
        out = F.when(u.rlike(p), F.lit(p)).otherwise(out)
    for p in reversed(BLOCKED_PREFIXES):
        out = F.when(u.startswith(p), F.lit(p)).otherwise(out)
    return F.when(u.isNull() | (u == ""), F.lit(None).cast("string")).otherwise(out)


def is_scrapable(url) -> Column:
    """False for null/empty URLs and for URLs with a rejection pattern."""
    u = _c(url)
    return F.coalesce((u != "") & rejection_pattern(u).isNull(), F.lit(False))


def filter_scrapable(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.filter(is_scrapable(url_col))


def is_http(url) -> Column:
    """Http or https scheme."""
    return F.coalesce(_c(url).rlike("^https?://"), F.lit(False))


def filter_http(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.filter(is_http(url_col))


def classify_context(url) -> Column:
    """Extension page context from its URL (protocol chrome-extension:, then the first
    context name found in the path); 'unknown' otherwise."""
    u = _c(url)
    path = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    ext = F.coalesce(u.startswith("chrome-extension:"), F.lit(False))
    out = F.lit("unknown")
    for needle, name in reversed(CONTEXTS):
        out = F.when(ext & path.contains(needle), F.lit(name)).otherwise(out)
    return out
