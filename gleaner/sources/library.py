"""The user's presets as a versioned table, so that two writers cannot lose each other's work.

``added`` (the version that a preset came in with) and ``seq`` (its place among those added with it) are the
list's order; a changed preset keeps both. Nothing is counted or renumbered to append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.presetstore import PRESET_DDL, all_presets
from gleaner.sources.versions import DELETED, VersionedTable

LIBRARY_DDL = PRESET_DDL + ", added bigint"
ORDER = ("added", "seq", "id")


def preset_library(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable.of(spark, path, LIBRARY_DDL, ("id",))


def list_presets(library: VersionedTable, version: int | None = None) -> DataFrame:
    """The stored presets, empty before the first is saved; ``ORDER`` is their order."""
    return library.read(version)


def save_presets(library: VersionedTable, new: DataFrame, retries: int = 3) -> int:
    """Presets with a known id are replaced where they stand, others follow at the end in their
    own order. Of several ``new`` rows with one id the last (by ``seq``) counts. Another writer's version in between
    is read before a new try; its presets stay."""
    last = F.max_by(F.struct("name", "config", "created_at"), "seq")
    n = new.groupBy("id").agg(last.alias("x"), F.min("seq").alias("place")).select("id", "x.*", "place")

    def delta(current: DataFrame, version: int) -> DataFrame:
        old = current.select("id", F.col("seq").alias("old_seq"), F.col("added").alias("old_added"))
        j = n.join(old, "id", "left")
        return j.select("id", "name", "config", "created_at", F.coalesce("old_seq", "place").alias("seq"), F.coalesce("old_added", F.lit(version)).alias("added"))

    return library.update(delta, retries=retries)


def delete_presets(library: VersionedTable, ids: DataFrame, retries: int = 3) -> int:
    """Remove by id; ids that are not there change nothing."""
    gone = ids.select("id").distinct()
    return library.update(lambda current, _: current.join(gone, "id", "left_semi").withColumn(DELETED, F.lit(True)), retries=retries)


def replace_presets(library: VersionedTable, new: DataFrame, retries: int = 3) -> int:
    """T4: the whole list anew, as an import does. Readers of the version before keep it."""
    return library.update(lambda _, version: new.withColumn("added", F.lit(version)), "snapshot", retries)


def listed_presets(library: VersionedTable, system: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """T5 + U2: the stored presets, then the system presets that are not hidden, with ``origin_rank``;
    (origin_rank, added, seq, id) is their order."""
    return all_presets(list_presets(library), system.withColumn("added", F.lit(0).cast("long")), status)
