"""Per-tab session state from a change log, batch and Structured Streaming.

``session_updates(tab_id, seq, field, value_json)``: one row per changed top-level field.
The state of a tab is, per field, the value with the highest ``seq`` (last write wins);
``currentScrapeConfig`` is merged one level deeper (its ``mainSelector`` and ``columns``
are separate fields, and ``columns`` only changes when the update carries an array). A
``__removed__`` row clears the tab: only updates with a higher ``seq`` survive.

The fold is ``groupBy(tab_id, field).agg(max_by(value, seq))`` — a partial aggregate, so a
tab with a huge log is combined map-side before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.sources.versions import VersionedTable
from gleaner.streaming import changelog

REMOVED = "__removed__"
CONFIG = "currentScrapeConfig"
UPDATES_DDL = "tab_id long, seq long, field string, value_json string"


def normalize_updates(updates: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Split config updates into ``currentScrapeConfig.<sub>`` fields (columns only when an
    array is given); other fields pass through. ``keep`` names further columns to carry."""
    is_cfg = F.col("field") == CONFIG
    v = F.try_parse_json(F.col("value_json"))
    cfg_fields = F.array(
        F.when(F.try_variant_get(v, "$.mainSelector", "string").isNotNull(),
               F.struct(F.lit(CONFIG + ".mainSelector").alias("f"), F.to_json(F.try_variant_get(v, "$.mainSelector", "variant")).alias("j"))),
        F.when(F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.columns", "variant")).startswith("ARRAY"), F.lit(False)),
               F.struct(F.lit(CONFIG + ".columns").alias("f"), F.to_json(F.try_variant_get(v, "$.columns", "variant")).alias("j"))),
    )
    plain = F.array(F.struct(F.col("field").alias("f"), F.col("value_json").alias("j")))
    fields = F.when(F.coalesce(is_cfg, F.lit(False)), F.filter(cfg_fields, lambda x: x.isNotNull())).otherwise(plain)
    return updates.select("tab_id", "seq", *keep, F.explode(fields).alias("x")).select(
        "tab_id", "seq", *keep, F.col("x.f").alias("field"), F.col("x.j").alias("value_json")
    )


def fold_sessions(updates: DataFrame) -> DataFrame:
    """Latest value per ``(tab_id, field)`` after the tab's last removal.
    ``(tab_id, field, value_json, seq)``."""
    return _fold(normalize_updates(updates)).filter(F.col("field") != REMOVED)


def _fold(u: DataFrame) -> DataFrame:
    """Latest value per (tab, field) first (combined map-side), then what a tab's last
    removal covers is dropped; removals stay as rows of their own."""
    return _uncovered(u.groupBy("tab_id", "field").agg(F.max_by("value_json", "seq").alias("value_json"), F.max("seq").alias("seq")))


def _uncovered(latest: DataFrame) -> DataFrame:
    cleared = F.max(F.when(F.col("field") == REMOVED, F.col("seq"))).over(Window.partitionBy("tab_id"))  # a row per field
    kept = (F.col("field") == REMOVED) | F.col("cleared_at").isNull() | (F.col("seq") > F.col("cleared_at"))
    return latest.withColumn("cleared_at", cleared).filter(kept).drop("cleared_at")


def route_updates(msgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Target tab = explicit ``tab_id`` else the sender's; rows without a target or
    without updates are rejected. Returns ``(routed, rejected)``."""
    target = F.coalesce(F.col("tab_id"), F.col("sender_tab_id"))
    ok = target.isNotNull() & F.col("field").isNotNull()
    routed = msgs.filter(ok).select(target.alias("tab_id"), "seq", "field", "value_json")
    return routed, msgs.filter(~ok)


def init_sessions(tabs: DataFrame, state: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Tabs without any state get the default fields (``value_json`` per field)."""
    missing = tabs.select("tab_id").distinct().join(state.select("tab_id").distinct(), "tab_id", "left_anti")
    d = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(v).alias("value_json")) for k, v in defaults.items()])
    return state.unionByName(
        missing.select("tab_id", F.explode(d).alias("d")).select(
            "tab_id", F.col("d.field").alias("field"), F.col("d.value_json").alias("value_json"), F.lit(0).cast("long").alias("seq")
        )
    )


def sessions_wide(state: DataFrame, fields: list[str]) -> DataFrame:
    """One row per tab with one JSON column per known field (pivot on a fixed list)."""
    return state.groupBy("tab_id").pivot("field", fields).agg(F.first("value_json"))


STATE_DDL = "tab_id long, field string, value_json string, seq long, ts timestamp"


def session_table(spark: SparkSession, state_path: str) -> VersionedTable:
    """The stored state, a row per (tab, field) with its last write, removals included."""
    return VersionedTable.of(spark, state_path, STATE_DDL, ("tab_id", "field"), order=("seq",))


def fold_updates(batch: DataFrame) -> DataFrame:
    """The last write of every (tab, field) of a batch, combined map-side."""
    u = normalize_updates(batch, ("ts",) if "ts" in batch.columns else ())
    ts = F.col("ts") if "ts" in batch.columns else F.lit(None).cast("timestamp")
    last = F.max_by(F.struct("value_json", ts.alias("ts")), "seq")
    return u.groupBy("tab_id", "field").agg(last.alias("x"), F.max("seq").alias("seq")).select("tab_id", "field", "x.value_json", "seq", "x.ts")


def expire_removals(state: DataFrame, mark: int) -> DataFrame:
    """State without what a removal covers, and without removals behind the watermark. Sequence
    numbers of a tab rise with its event times, so what such a removal covers is late by then."""
    old = (F.col("field") == REMOVED) & (F.col("ts") < F.timestamp_micros(F.lit(mark)))
    return _uncovered(state).filter(~F.coalesce(old, F.lit(False)))


def read_sessions(spark: SparkSession, state_path: str, version: int | None = None) -> DataFrame:
    """The tabs' state (latest version if none is given), without the removals it remembers."""
    state = session_table(spark, state_path).read(version)
    return _uncovered(state).filter(F.col("field") != REMOVED).select("tab_id", "field", "value_json", "seq")


def stream_sessions(
    spark: SparkSession,
    updates_path: str,
    state_path: str,
    checkpoint: str,
    trigger_once: bool = True,
    schema: str = UPDATES_DDL,
    delay: dt.timedelta | None = None,
    compact_every: int = 10,
    max_files: int | None = None,
):
    """X1 streaming: files of updates -> changelog of the state (see :mod:`gleaner.streaming.changelog`).
    With ``delay``, updates carry ``ts``, and those behind the watermark are dropped. Returns the started query."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return changelog.stream_into(
        reader.parquet(updates_path),
        session_table(spark, state_path),
        checkpoint,
        fold_updates,
        trigger_once,
        delay=delay,
        compact_every=compact_every,
        expire=expire_removals,
    )


def live_results(results: DataFrame) -> DataFrame:
    """Latest result per tab by ``seq``; tabs whose latest result is empty (or that
    were closed) drop out. ``results(tab_id, seq, row_count, closed)``."""
    latest = results.groupBy("tab_id").agg(F.max_by(F.struct("row_count", "closed"), "seq").alias("x"), F.max("seq").alias("seq"))
    return latest.filter((F.col("x.row_count") > 0) & ~F.coalesce(F.col("x.closed"), F.lit(False))).select(
        "tab_id", "seq", F.col("x.row_count").alias("row_count")
    )


def stream_extract(spark: SparkSession, pages_path: str, config, out_path: str, checkpoint: str, schema=None):
    """Extract from pages as they arrive (same parse + extract plan as batch), append
    to a parquet sink. Returns the started query (``availableNow``)."""
    from gleaner.operators.extract import extract
    from gleaner.sources.dom import parse_dom

    sch = schema or "page_id long, url string, html string"
    pages = spark.readStream.schema(sch).parquet(pages_path)
    res = extract(parse_dom(pages), config, form="long")
    return (
        res.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
