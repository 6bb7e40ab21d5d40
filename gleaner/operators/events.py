"""The event log with consent gating.

``events(name STRING, props MAP<STRING,STRING>, ts TIMESTAMP, ...)``. The driver's
``events`` table maps to it with :func:`from_table` (``event_type`` is the name, the
``props`` JSON becomes a map)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.presetstore import is_system
from gleaner.operators.view import top_k_per_group

MAX_QUEUED = 1000
# Property names never sent (URL and referrer fields).
DENY_PROPS = [
    "$current_url",
    "$referrer",
    "$pathname",
    "$prev_pageview_pathname",
    "$session_entry_url",
    "$session_entry_pathname",
    "$session_entry_referrer",
]


def read_events(spark: SparkSession, path: str, stream: bool = False, schema=None):
    """The event log as a batch or streaming source (parquet)."""
    if stream:
        return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)
    return spark.read.parquet(path)


def from_table(events: DataFrame) -> DataFrame:
    """Driver ``events`` -> ``(event_id, user_id, name, props MAP, ts, value)``."""
    return events.select(
        "event_id", "user_id", F.col("event_type").alias("name"),
        F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("props"),
        "ts", "value",
    )


def bounded_queue(events: DataFrame, n: int = MAX_QUEUED, by=("user_id",), ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """Keep the newest ``n`` events per queue (oldest dropped first). The limit is
    applied partially before the shuffle, so a hot queue sends at most ``n`` rows per task."""
    return top_k_per_group(events, list(by), [F.col(ts).desc(), F.col(seq).desc()], n)


def consent_state(raw) -> Column:
    """Stored consent (JSON text) -> true / false / null (undecided). Missing, null and
    '' are undecided; otherwise JavaScript truthiness (``false``, ``0`` -> false)."""
    r = F.col(raw) if isinstance(raw, str) else raw
    t = F.trim(r)
    s = F.try_variant_get(F.try_parse_json(t), "$", "string")
    return (
        F.when(r.isNull() | (t == "") | (t == "null") | (t == '""'), F.lit(None).cast("boolean"))
        .when(t == "false", F.lit(False))
        .when(t == "true", F.lit(True))
        .when(t.rlike("^-?0+(\\.0*)?$"), F.lit(False))
        .when(s.isNotNull(), F.length(s) > 0)
        .otherwise(F.lit(True))
    )


def route_events(events: DataFrame, consent: DataFrame, by: str = "user_id") -> DataFrame:
    """Declined -> 'drop' (nothing queued or sent), undecided -> 'queue',
    granted -> 'deliver'. ``consent(user_id, consent BOOLEAN)``; a user without a row is
    undecided. Join strategy is left to Spark/AQE (skewed users are split by AQE)."""
    j = events.join(consent.select(by, "consent"), by, "left")
    return j.withColumn(
        "route",
        F.when(F.col("consent").isNull(), F.lit("queue")).when(F.col("consent"), F.lit("deliver")).otherwise(F.lit("drop")),
    )


def enrich(events: DataFrame, environment: str | None, version: str, context) -> DataFrame:
    """Add ``environment`` (when set), ``extension_context`` (kept when already
    non-empty, else ``context``) and ``extension_version``."""
    ctx = F.lit(context) if isinstance(context, str) else context
    p = F.col("props")
    cur_ctx = F.nullif(p.getItem("extension_context"), F.lit(""))
    drop = ["extension_context", "extension_version"] + (["environment"] if environment else [])
    base = F.map_filter(p, lambda k, v: ~k.isin(*drop))
    add = []
    if environment:
        add += [F.lit("environment"), F.lit(environment)]
    add += [F.lit("extension_context"), F.coalesce(cur_ctx, ctx), F.lit("extension_version"), F.lit(version)]
    return events.withColumn("props", F.map_concat(base, F.create_map(*add)))


def deny_props(events: DataFrame, keys=DENY_PROPS) -> DataFrame:
    """Drop denied property keys."""
    return events.withColumn("props", F.map_filter("props", lambda k, v: ~k.isin(*keys)))


def mask_preset_props(events: DataFrame) -> DataFrame:
    """Preset id/name only for system presets, null otherwise."""
    p = F.col("props")
    sysp = is_system(p.getItem("preset_id"))
    keep = F.map_filter(p, lambda k, v: ~k.isin("preset_id", "preset_name"))
    masked = F.create_map(
        F.lit("preset_id"), F.when(sysp, p.getItem("preset_id")),
        F.lit("preset_name"), F.when(sysp, p.getItem("preset_name")),
    )
    return events.withColumn("props", F.when(F.map_contains_key(p, "preset_id") | F.map_contains_key(p, "preset_name"), F.map_concat(keep, masked)).otherwise(p))


def valid_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, dead_letter)`` split on a non-empty name."""
    ok = F.coalesce(F.col("name") != "", F.lit(False))
    return events.filter(ok), events.filter(~ok)


def flush_queue(queue: DataFrame, by=("user_id",)) -> DataFrame:
    """E5: queued events in queue order with ``buffered=true``; timestamps kept."""
    out = queue.withColumn(
        "props", F.map_concat(F.map_filter("props", lambda k, v: k != "buffered"), F.create_map(F.lit("buffered"), F.lit("true")))
    )
    w = Window.partitionBy(*by).orderBy("ts", "event_id")
    return out.withColumn("queue_pos", F.row_number().over(w).cast("int"))
