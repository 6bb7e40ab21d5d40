"""The preset library as DataFrames.

``presets(id, name, config STRUCT<main_selector, columns ARRAY<STRUCT<name, selector,
key>>>, created_at BIGINT, seq BIGINT)``; ``seq`` is the list order. Import validation
(T9) parses files with Spark's VARIANT type so JSON types (number vs string, array vs
object) can be checked exactly as the reference does, without Python per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import js_trim
from gleaner.plans.presets import SYSTEM_PRESETS

PRESET_DDL = (
    "id string, name string, config struct<main_selector: string, columns: array<struct<name: string, "
    "selector: string, key: string>>>, created_at bigint, seq bigint"
)
CURRENT_VERSION = 1
# version -> function(DataFrame of raw VARIANT items) -> DataFrame; none defined yet
MIGRATIONS: dict[int, object] = {}


def empty_presets(spark: SparkSession) -> DataFrame:
    """The empty library (default when nothing is stored)."""
    return spark.createDataFrame([], PRESET_DDL)


def system_presets(spark: SparkSession) -> DataFrame:
    rows = [
        (pid, name, (cfg.main_selector, [(c.name, c.selector, c.key) for c in cfg.columns]), 0, i)
        for i, (pid, (name, cfg)) in enumerate(SYSTEM_PRESETS.items())
    ]
    return spark.createDataFrame(rows, PRESET_DDL)


def is_system(id_col) -> Column:
    """Exact, case-sensitive membership in the system preset ids."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return c.isin(*SYSTEM_PRESETS.keys())


def upsert_presets(cur: DataFrame, new: DataFrame) -> DataFrame:
    """Replace presets with the same id in place (keeping their position), append the
    others after the current last position in their own order."""
    top = cur.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    n = new.select("id", "name", "config", "created_at", F.col("seq").alias("nseq"))
    j = cur.join(n.withColumnRenamed("name", "nname").withColumnRenamed("config", "nconfig").withColumnRenamed("created_at", "ncreated"), "id", "full_outer")
    appended = F.row_number().over(Window.partitionBy(F.col("seq").isNull()).orderBy("nseq"))
    return j.select(
        "id",
        F.coalesce("nname", "name").alias("name"),
        F.coalesce("nconfig", "config").alias("config"),
        F.coalesce("ncreated", "created_at").alias("created_at"),
        F.when(F.col("seq").isNotNull(), F.col("seq")).otherwise(F.lit(top) + appended).cast("long").alias("seq"),
    )


def delete_presets(cur: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove by id."""
    return cur.join(ids.select("id"), "id", "left_anti")


def replace_presets(new: DataFrame, path: str) -> None:
    """T4: replace the whole stored library."""
    new.write.mode("overwrite").parquet(path)


def all_presets(user: DataFrame, system: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """User presets in order, then the enabled system presets (status missing =
    enabled). ``origin_rank`` 0 = user, 1 = system."""
    sysp = system
    if status is not None:
        sysp = system.join(status.select("id", "enabled"), "id", "left").filter(
            F.coalesce(F.col("enabled"), F.lit(True))
        ).drop("enabled")
    return user.withColumn("origin_rank", F.lit(0)).unionByName(sysp.withColumn("origin_rank", F.lit(1)))


def hide_preset(status: DataFrame, preset_id: str) -> DataFrame:
    """Mark a system preset hidden (upsert ``(id, false)``)."""
    spark = status.sparkSession
    new = spark.createDataFrame([(preset_id, False)], "id string, enabled boolean")
    return status.join(new, "id", "left_anti").unionByName(new)


def reset_status(spark: SparkSession) -> DataFrame:
    """No hidden presets."""
    return spark.createDataFrame([], "id string, enabled boolean")


def suggest(recents: DataFrame, presets: DataFrame, term: str) -> DataFrame:
    """Recent selectors not already a preset's selector (trimmed), then presets;
    both filtered by the trimmed lower-case term. ``(kind, label, selector, rank)``."""
    t = (term or "").strip().lower()
    psel = presets.select(js_trim(F.col("config.main_selector")).alias("selector")).distinct()
    rec = recents.withColumn("selector", js_trim(F.col("selector"))).join(psel, "selector", "left_anti")
    if t:
        rec = rec.filter(F.lower("selector").contains(t))
        presets = presets.filter(F.lower("name").contains(t) | F.lower("config.main_selector").contains(t))
    r = rec.select(F.lit("recent").alias("kind"), F.col("selector").alias("label"), "selector", F.col("rank").cast("long").alias("rank"))
    p = presets.select(F.lit("preset").alias("kind"), F.col("name").alias("label"), F.col("config.main_selector").alias("selector"), F.col("seq").alias("rank"))
    return r.unionByName(p)


# -- T9 / T10: import validation -------------------------------------------------------------
def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    t = _vtype(v)
    return F.coalesce(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), F.lit(False))


def _is_string(v: Column, nonempty: bool) -> Column:
    ok = F.coalesce(_vtype(v) == "STRING", F.lit(False))
    if nonempty:
        ok = ok & (F.coalesce(F.length(F.try_variant_get(v, "$", "string")), F.lit(0)) > 0)
    return ok


def _is_object(v: Column) -> Column:
    return F.coalesce(_vtype(v).startswith("OBJECT"), F.lit(False))


def _is_array(v: Column) -> Column:
    return F.coalesce(_vtype(v).startswith("ARRAY"), F.lit(False))


def _vget(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _valid_item(item: Column) -> Column:
    cfg = _vget(item, "$.config")
    cols = F.try_variant_get(cfg, "$.columns", "array<variant>")
    col_ok = F.forall(
        F.coalesce(cols, F.array().cast("array<variant>")),
        lambda c: _is_object(c) & _is_string(_vget(c, "$.name"), True) & _is_string(_vget(c, "$.selector"), False),
    )
    return (
        _is_object(item)
        & _is_string(_vget(item, "$.id"), True)
        & _is_string(_vget(item, "$.name"), True)
        & _is_object(cfg)
        & _is_string(_vget(cfg, "$.mainSelector"), True)
        & _is_array(_vget(cfg, "$.columns"))
        & col_ok
        & _is_number(_vget(item, "$.createdAt"))
    )


# What an import reports; {} is the number that it names.
ERRORS = {
    "json": "Invalid JSON file.",
    "object": "Invalid preset file: expected an object.",
    "no version": 'Invalid preset file: missing "version" field.',
    "version": "Unsupported preset file version. Expected version between 1 and {}.",
    "no presets": 'Invalid preset file: missing "presets" field.',
    "presets": 'Invalid preset file: "presets" must be an array.',
    "no migration": "Unsupported preset file version: migration to v{} not defined.",
    "migration": "Failed to migrate presets: version {}",
    "item": "Invalid preset at index {}: missing or invalid fields (id, name, config.mainSelector, config.columns, createdAt).",
}
_ITEM = "struct<item_index: int, id: string, name: string, config: struct<main_selector: string, columns: array<struct<name: string, selector: string, key: string>>>, created_at: bigint>"

#: A migration rewrites a file's items (array of VARIANT) from the version before; null: it could not.
Migration = Callable[[Column], Column]


def with_field(item: Column, name: str, value: Column) -> Column:
    """For migrations: a VARIANT object with one field set (``value`` is a VARIANT); null for other items."""
    fields = F.try_variant_get(item, "$", "map<string,variant>")
    rest = F.map_filter(fields, lambda k, _: k != name)
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(name), value)))


def whole_json(raw: Column) -> Column:
    """``raw`` as a VARIANT; null unless all of it is one JSON value. ``try_parse_json`` stops after the
    first value; a text that is one inside an array and inside an object has nothing after it."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.when((F.size(alone) == 1) & inside.isNotNull(), F.get(alone, 0))


def _message(name: str, number: Column) -> Column:
    before, after = ERRORS[name].split("{}")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def _plain_number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def validate_import(files: DataFrame, file_col: str = "file", raw_col: str = "raw", current: int = CURRENT_VERSION, migrations: dict[int, Migration] | None = None) -> DataFrame:
    """T9 + T10 in one pass, without a shuffle: a row per file with error (null: none), imported, skipped_system and the
    importable ``presets`` in file order.

    A file of an older version goes through the migrations after it, one rewrite of its items each, folded
    into the expression that validates them. The first bad item fails its file.
    """
    migrations = MIGRATIONS if migrations is None else migrations
    v = F.col("v")
    ver, pres = _vget(v, "$.version"), _vget(v, "$.presets")
    number = F.try_variant_get(v, "$.version", "double")
    like_object = F.coalesce(_vtype(v).startswith("OBJECT") | _vtype(v).startswith("ARRAY"), F.lit(False))
    missing = [t for t in range(2, current + 1) if t not in migrations]
    step = F.array_min(F.filter(F.array(*[F.lit(float(t)) for t in missing]).cast("array<double>"), lambda t: t > number))
    between = (number != F.floor(number)) & (number + 1 <= current)  # no step leads from there
    head = (
        F.when(v.isNull(), ERRORS["json"])
        .when(~like_object, ERRORS["object"])
        .when(ver.isNull(), ERRORS["no version"])
        .when(~_is_number(ver) | (number < 1) | (number > current), ERRORS["version"].format(current))
        .when(pres.isNull(), ERRORS["no presets"])
        .when(~_is_array(pres), ERRORS["presets"])
        .when(between, _message("no migration", _plain_number(number + 1)))
        .when((number == F.floor(number)) & step.isNotNull(), _message("no migration", _plain_number(step)))
    )
    f = files.select(F.col(file_col).alias("file"), whole_json(F.col(raw_col)).alias("v"))
    f = f.select("file", head.alias("head"), F.try_variant_get(v, "$.presets", "array<variant>").alias("items"), number.alias("version"), F.lit(None).cast("string").alias("failed"))
    for target in sorted(t for t in migrations if 2 <= t <= current):
        due = F.col("head").isNull() & F.col("failed").isNull() & (F.col("version") < target)
        moved = migrations[target](F.col("items"))
        f = f.withColumn("next", F.when(due, moved)).select(
            "file", "head", "version",
            F.when(due, F.col("next")).otherwise(F.col("items")).alias("items"),
            F.when(due & F.col("next").isNull(), _message("migration", F.lit(target))).otherwise(F.col("failed")).alias("failed"),
        )
    text = lambda item, path: F.try_variant_get(item, path, "string")
    f = f.withColumn("ok", F.transform("items", lambda i: F.coalesce(_valid_item(i), F.lit(False))))
    bad = F.array_position("ok", False)
    error = F.coalesce("head", "failed", F.when(bad > 0, _message("item", bad - 1)))
    preset = lambda i, at: F.struct(
        at.cast("int").alias("item_index"), text(i, "$.id").alias("id"), text(i, "$.name").alias("name"),
        F.struct(text(i, "$.config.mainSelector").alias("main_selector"), F.try_variant_get(i, "$.config.columns", "array<struct<name: string, selector: string, key: string>>").alias("columns")).alias("config"),
        F.try_variant_get(i, "$.createdAt", "double").cast("long").alias("created_at"),
    )
    f = f.select("file", error.alias("error"), F.size("items").alias("n"), F.transform("items", preset).alias("all"))
    own = F.when(F.col("error").isNull(), F.filter("all", lambda p: ~is_system(p["id"]))).otherwise(F.array().cast(f"array<{_ITEM}>"))
    f = f.withColumn("presets", own)
    return f.select(
        "file", "error", F.size("presets").cast("long").alias("imported"),
        F.when(F.col("error").isNull(), F.col("n") - F.size("presets")).otherwise(0).cast("long").alias("skipped_system"), "presets",
    )


def validate_presets(files: DataFrame, file_col: str = "file", raw_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """T9 per file. Returns ``(report, valid)``:

    * ``report(file, error, imported, skipped_system)``: ``error`` is the reference's
      message or null; the first bad item index fails the whole file;
    * ``valid``: the importable presets (system ids removed) of error-free files, as
      ``(file, item_index, id, name, config, created_at)``.
    """
    f = validate_import(files, file_col, raw_col)
    return f.drop("presets"), f.select("file", F.inline("presets"))


def read_preset_files(spark: SparkSession, path: str) -> DataFrame:
    """Preset files as ``(file, raw)`` (one row per file, whole text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))


def migrate_presets(items: DataFrame, from_version: int) -> DataFrame:
    """Apply the migration steps from ``from_version`` to the current version."""
    for v in range(from_version + 1, CURRENT_VERSION + 1):
        step = MIGRATIONS.get(v)
        if step is None:
            raise ValueError(f"Unsupported preset file version: migration to v{v} not defined.")
        items = step(items)
    return items


def _eff_key(c: Column) -> Column:
    return F.coalesce(F.nullif(c["key"], F.lit("")), c["name"])


def needs_rescrape(sessions: DataFrame, cur: str = "current_config", used: str = "result_config", has_result: str = "has_result") -> DataFrame:
    """Flag sessions whose current config differs from the one that produced the
    stored result (selector, column count, names, selectors, effective keys)."""
    a, b = F.col(cur), F.col(used)
    norm = lambda cfg: F.transform(cfg["columns"], lambda c: F.struct(c["name"], c["selector"], _eff_key(c)))
    differs = (
        (F.coalesce(a["main_selector"], F.lit("")) != F.coalesce(b["main_selector"], F.lit("")))
        | (F.coalesce(F.size(a["columns"]), F.lit(0)) != F.coalesce(F.size(b["columns"]), F.lit(0)))
        | ~F.coalesce(norm(a) == norm(b), F.lit(False))
    )
    return sessions.withColumn("needs_rescrape", F.coalesce(F.col(has_result), F.lit(False)) & differs)
