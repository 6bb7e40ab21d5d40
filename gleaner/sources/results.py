"""Stored results, one row per tab with its latest scrape.

A scrape's rows are one page's, so they stay together in ``data`` (an array of cell arrays
that follow ``columns``). The table is partitioned by a bucket of the tab, which a
join with few tabs prunes at run time. Commits are deltas by tab: a newer scrape (by ``seq``)
replaces a tab's rows, an empty one or a closed tab takes them away.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.versions import VersionedTable
from gleaner.streaming import changelog

RESULTS_DDL = (
    "tab_id long, seq long, ts timestamp, main_selector string, columns array<string>, "
    "data array<array<string>>, closed boolean, bucket int"
)
BUCKETS = 64
# What a tab or session without its own shows.
UNKNOWN_URL, UNKNOWN_TITLE = "Unknown URL", "Unknown Title"
DEFAULT_SELECTOR, DEFAULT_COLUMNS = "", ["Text"]


def results_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable.of(spark, path, RESULTS_DDL, ("tab_id",), order=("seq",), partition_by=("bucket",))


def bucket_of(tab_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(tab_id), F.lit(buckets)).cast("int")


def latest_scrapes(scrapes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The latest of each tab's ``scrapes`` as rows of the table (columns as in ``RESULTS_DDL`` without the bucket)."""
    rest = [c for c in ("ts", "main_selector", "columns", "data", "closed") if c in scrapes.columns]
    last = scrapes.groupBy("tab_id").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("x")).select("tab_id", "seq", "x.*")
    for name, kind in (("ts", "timestamp"), ("main_selector", "string"), ("columns", "array<string>"), ("data", "array<array<string>>"), ("closed", "boolean")):
        if name not in rest:
            last = last.withColumn(name, F.lit(None).cast(kind))
    return last.withColumn("bucket", bucket_of(F.col("tab_id"), buckets))


def scrapes_of(res: DataFrame, columns: list[str], seq: Column, main_selector: str, tab: str = "page_id") -> DataFrame:
    """One scrape per page of an extraction result (P1, wide form): its rows in document order."""
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(F.col("original_index").alias("i"), cells.alias("c"))))
    return res.groupBy(F.col(tab).cast("long").alias("tab_id")).agg(rows.alias("rows")).select(
        "tab_id",
        seq.cast("long").alias("seq"),
        F.lit(main_selector).alias("main_selector"),
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
        F.transform("rows", lambda r: r["c"]).alias("data"),
    )


def commit_results(table: VersionedTable, scrapes: DataFrame) -> int:
    """K7: store the latest of each tab's scrapes as a new version; its number."""
    return table.commit(latest_scrapes(scrapes))


def read_results(table: VersionedTable, version: int | None = None) -> DataFrame:
    """Tabs with a non-empty result."""
    return table.read(version).filter((F.size("data") > 0) & ~F.coalesce(F.col("closed"), F.lit(False)))


def results_with_tabs(tabs: DataFrame, table: VersionedTable, version: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Open tabs that have a stored result, with defaults for what a tab or its session lacks.
    ``tabs(tab_id, url, title)``; ids that are null or 0 are no tabs. A selective filter on ``tabs``
    prunes the stored buckets at run time."""
    t = tabs.filter(F.col("tab_id").isNotNull() & (F.col("tab_id") != 0)).select(
        F.col("tab_id").cast("long").alias("tab_id"),
        F.coalesce(F.nullif("url", F.lit("")), F.lit(UNKNOWN_URL)).alias("tab_url"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit(UNKNOWN_TITLE)).alias("tab_title"),
        bucket_of(F.col("tab_id").cast("long"), buckets).alias("bucket"),
    )
    config = F.col("main_selector").isNotNull()
    return t.join(read_results(table, version), ["bucket", "tab_id"]).select(
        "tab_id",
        "tab_url",
        "tab_title",
        "seq",
        F.when(config, F.col("main_selector")).otherwise(DEFAULT_SELECTOR).alias("main_selector"),
        F.when(config, F.col("columns")).otherwise(F.array(*[F.lit(c) for c in DEFAULT_COLUMNS])).alias("columns"),
        "data",
    )


def result_rows(results: DataFrame) -> DataFrame:
    """A row per stored row: tab_id, original_index, cells."""
    return results.select("tab_id", F.posexplode("data").alias("original_index", "cells"))


def expire_closed(rows: DataFrame, mark: int) -> DataFrame:
    """What a snapshot keeps: tabs with rows, and closed or emptied ones until the watermark has passed them."""
    shown = (F.size("data") > 0) & ~F.coalesce(F.col("closed"), F.lit(False))
    return rows.filter(shown | ~F.coalesce(F.col("ts") < F.timestamp_micros(F.lit(mark)), F.lit(False)))


def stream_results(spark: SparkSession, scrapes_path: str, table: VersionedTable, checkpoint: str, schema: str, trigger_once: bool = True, delay: dt.timedelta | None = None, compact_every: int = 10, max_files: int | None = None):
    """Files of scrapes -> the stored results; :func:`read_results` of its latest version is the live view.
    Returns the started query."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return changelog.stream_into(
        reader.parquet(scrapes_path), table, checkpoint, latest_scrapes, trigger_once, delay=delay, compact_every=compact_every, expire=expire_closed
    )
