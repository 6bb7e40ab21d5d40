"""Configs as columns of a presets table: edits, JSON both ways, selectors that are no preset's.

A config is ``STRUCT<main_selector, columns ARRAY<STRUCT<name, selector, key>>>``, as in the preset library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import js_trim

_COLUMN = "struct<name: string, selector: string, key: string>"
_JSON = f"struct<mainSelector: string, columns: array<{_COLUMN}>>"


def _config(main: Column, columns: Column) -> Column:
    return F.struct(main.alias("main_selector"), columns.cast(f"array<{_COLUMN}>").alias("columns"))


def _column(name: Column, selector: Column, key: Column) -> Column:
    return F.struct(name.alias("name"), selector.alias("selector"), key.cast("string").alias("key"))


def add_column(config: Column, name: Column) -> Column:
    """A further column with the trimmed ``name`` over ``.``; a blank name changes nothing."""
    new = F.array(_column(js_trim(name), F.lit("."), F.lit(None)))
    return _config(config["main_selector"], F.when(F.coalesce(js_trim(name), F.lit("")) == "", config["columns"]).otherwise(F.concat(config["columns"], new)))


def remove_column(config: Column, index: Column) -> Column:
    """Without the column at ``index`` (from 0; none there: unchanged)."""
    return _config(config["main_selector"], F.filter(config["columns"], lambda c, i: i != index))


def rename_column(config: Column, index: Column, name: Column) -> Column:
    """The column at ``index`` under another name, its selector and key kept."""
    return _config(config["main_selector"], F.transform(config["columns"], lambda c, i: F.when(i == index, _column(name, c["selector"], c["key"])).otherwise(c)))


def set_selector(config: Column, index: Column, selector: Column) -> Column:
    """The column at ``index`` over another selector."""
    return _config(config["main_selector"], F.transform(config["columns"], lambda c, i: F.when(i == index, _column(c["name"], selector, c["key"])).otherwise(c)))


def config_json(config: Column) -> Column:
    """a config as JSON, a missing key left out."""
    return F.to_json(F.struct(config["main_selector"].alias("mainSelector"), config["columns"].alias("columns")))


def config_from_json(raw: Column) -> Column:
    """a config from JSON; null if it is none."""
    j = F.from_json(raw, _JSON)
    return F.when(j["mainSelector"].isNotNull() & j["columns"].isNotNull(), _config(j["mainSelector"], j["columns"]))


def own_selectors(uses: DataFrame, presets: DataFrame, selector: str = "selector") -> DataFrame:
    """Uses of a selector (trimmed, not blank) that no preset has as its main selector; the others never
    become recent ones."""
    trimmed = uses.withColumn(selector, js_trim(F.col(selector))).filter(F.col(selector) != "")
    taken = presets.select(js_trim(F.col("config.main_selector")).alias(selector)).distinct()
    return trimmed.join(taken, selector, "left_anti").select(*uses.columns)
