"""Render relational rows as HTML pages (Spark expressions only).

Used to derive page sets whose extraction results are known from the source tables
(round-trip checks), and as a general ``rows -> <table>/<ul>`` publisher. Pages are built
either one per row (no shuffle) or one per bounded chunk of a unique key (``key div
rows_per_page``), so no page grows with the data and no group can be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def esc(c: Column) -> Column:
    """HTML-escape text or an attribute value (&, <, >, ")."""
    x = F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    x = F.replace(x, F.lit(">"), F.lit("&gt;"))
    return F.replace(x, F.lit('"'), F.lit("&quot;"))


def page(title: Column, body: Column) -> Column:
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), esc(title),
        F.lit("</title></head><body>"), body, F.lit("</body></html>"),
    )


# The eight social hosts matched by the social-links preset.
SOCIAL = ["facebook", "twitter", "x", "linkedin", "instagram", "youtube", "tiktok", "pinterest"]
REL_KINDS = ["nofollow", "sponsored", "ugc noopener", ""]


def customer_pages(customer: DataFrame) -> DataFrame:
    """One page per customer with links of every rel kind, an external and a social link,
    an image, a form with inputs and call-to-action elements, all derived from the row.
    ``(page_id, url, html)``; no shuffle."""
    k = F.col("c_custkey")
    name, seg, nat = esc(F.col("c_name")), esc(F.col("c_mktsegment")), F.col("c_nationkey").cast("string")
    rel = F.element_at(F.array(*[F.lit(r) for r in REL_KINDS]), (k % 4 + 1).cast("int"))
    social = F.element_at(F.array(*[F.lit(s) for s in SOCIAL]), (k % 8 + 1).cast("int"))
    rel_attr = F.when(rel == "", F.lit("")).otherwise(F.concat(F.lit(' rel="'), rel, F.lit('"')))
    host = F.concat(F.lower(F.regexp_replace(F.col("c_mktsegment"), "[^A-Za-z]", "")), F.lit(".example.com"))
    body = F.concat(
        F.lit('<nav><a href="https://'), host, F.lit("/c/"), k.cast("string"), F.lit('"'), rel_attr,
        F.lit(' title="'), name, F.lit('" target="_blank">'), name, F.lit("</a>"),
        F.lit('<a href="/n/'), nat, F.lit("/"), k.cast("string"), F.lit('">'), seg, F.lit("</a>"),
        F.lit('<a href="https://www.'), social, F.lit(".com/"), k.cast("string"), F.lit('">'), name, F.lit("</a></nav>"),
        F.lit('<figure><img src="/img/'), k.cast("string"), F.lit('.png" alt="'), name,
        F.lit('" width="'), nat, F.lit('" loading="lazy"></figure>'),
        F.lit('<form action="/buy/'), k.cast("string"), F.lit('" method="post" id="f'), k.cast("string"),
        F.lit('" class="'), seg, F.lit('"><input name="q"><input name="n" type="number">'),
        F.lit('<input type="submit" value="Buy '), nat, F.lit('"></form>'),
        F.lit('<button class="btn" type="button">'), seg, F.lit("</button>"),
        F.lit('<a class="cta" href="#top">'), name, F.lit("</a>"),
    )
    return customer.select(
        k.alias("page_id"),
        F.concat(F.lit("https://shop.example.com/c/"), k.cast("string")).alias("url"),
        page(F.col("c_name"), body).alias("html"),
    )


PART_HEADERS = ["Key", "Name", "Brand", "Size", "Price"]


def part_table_pages(part: DataFrame, rows_per_page: int = 50) -> DataFrame:
    """Parts as ``<table class="wikitable">`` pages of at most ``rows_per_page`` rows each
    (chunk = ``p_partkey div rows_per_page``, bounded by construction), with a header row
    in ``thead`` and the name cell wrapping a link. ``(page_id, url, html)``."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(
        F.lit("<tr>"),
        cell(F.col("p_partkey").cast("string")),
        cell(F.concat(F.lit('<a href="/p/'), F.col("p_partkey").cast("string"), F.lit('">'), esc(F.col("p_name")), F.lit("</a>"))),
        cell(esc(F.col("p_brand"))),
        cell(F.col("p_size").cast("string")),
        cell(F.col("p_retailprice").cast("decimal(12,2)").cast("string")),
        F.lit("</tr>"),
    )
    head = "<thead><tr>" + "".join(f"<th>{h}</th>" for h in PART_HEADERS) + "</tr></thead>"
    chunks = (
        part.select(F.floor(F.col("p_partkey") / rows_per_page).alias("page_id"), F.col("p_partkey"), row.alias("tr"))
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "tr"))).alias("rows"))
    )
    body = F.concat(
        F.lit('<h2>Parts</h2><table class="wikitable sortable">' + head + "<tbody>"),
        F.array_join(F.transform("rows", lambda r: r["tr"]), ""),
        F.lit("</tbody></table>"),
    )
    return chunks.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.concat(F.lit("https://parts.example.com/list/"), F.col("page_id").cast("string")).alias("url"),
        page(F.lit("Parts"), body).alias("html"),
    )
