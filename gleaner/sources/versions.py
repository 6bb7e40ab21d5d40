"""A keyed table kept as committed versions.

Rows are Parquet files, each commit's in a folder of its own; a version exists once its
commit file does, which is created after the rows are written and never replaced:

    data/commit=<id>/[<partition columns>/]part-*.parquet
    commits/<version, 20 digits>.json      {"version", "kind", "commit", "info"}

A ``snapshot`` holds all rows of its version, a ``delta`` the rows that were put or deleted
(``_deleted``) since the version before. Reading takes the newest snapshot not above the
wanted version and the deltas after it, and keeps the latest row of every key by one
aggregation that combines map-side; without deltas it is a plain scan. Rows of a job that died stay
unseen, as no commit file names them, and ``vacuum`` removes them.

Two writers that start from one version both try to create the same commit file; the
second gets ``Conflict``, and ``update`` reads the new version and tries again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

DELETED = "_deleted"
COMMIT = "commit"
#: A commit file without an end is a writer's that died, once it is as old as this.
UNFINISHED_MS = 60_000


class Conflict(RuntimeError):
    """Another writer committed the version that this one was made for."""


@dataclass(frozen=True)
class Commit:
    version: int
    kind: str
    commit: str
    info: dict = field(default_factory=dict)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


@dataclass(frozen=True)
class VersionedTable:
    """``key`` names a row; ``order`` are columns whose greatest value is the latest row of a key
    (after them, and where there are none, the later commit is). Partition columns must follow
    from the key, as a bucket of it does."""

    spark: SparkSession
    path: str
    schema: StructType
    key: tuple[str, ...]
    order: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()

    @staticmethod
    def of(spark: SparkSession, path: str, ddl: str, key: tuple[str, ...], order: tuple[str, ...] = (), partition_by: tuple[str, ...] = ()) -> VersionedTable:
        schema = StructType.fromDDL(ddl)
        if missing := [c for c in (*key, *order, *partition_by) if c not in schema.names]:
            raise ValueError(f"not among the columns: {missing}")
        return VersionedTable(spark, path.rstrip("/"), schema, tuple(key), tuple(order), tuple(partition_by))

    # -- commit files ------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, p = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self, version: int) -> Commit | None:
        """The commit of a version; None if its file is not there or was not written to its end."""
        fs, p = self._fs(), self._path("commits", f"{version:020d}.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            d = json.loads(text)
            return Commit(d["version"], d["kind"], d["commit"], d["info"])
        except (ValueError, KeyError):
            return None

    def _numbers(self) -> list[int]:
        """Versions that have a commit file, whole or not."""
        return [int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and n[:-5].isdigit()]

    def versions(self) -> list[int]:
        return [v for v in self._numbers() if self._manifest(v) is not None]

    def latest(self) -> int:
        """The newest whole version; 0 before the first commit."""
        return next((v for v in reversed(self._numbers()) if self._manifest(v) is not None), 0)

    def commits_of(self, version: int) -> list[Commit]:
        """The snapshot that a version is read from, and the deltas after it."""
        chain: list[Commit] = []
        for v in reversed([n for n in self._numbers() if n <= version]):
            if (m := self._manifest(v)) is None:
                continue
            chain.append(m)
            if m.kind == "snapshot":
                break
        if version and (not chain or chain[0].version != version):
            raise ValueError(f"no version {version} in {self.path}")
        return chain[::-1]

    # -- writing -----------------------------------------------------------------------
    def commit(self, rows: DataFrame, kind: str = "delta", base: int | None = None, info: dict | None = None) -> int:
        """Write ``rows`` as the version after ``base`` (the latest, if not given); its number."""
        if kind not in ("snapshot", "delta"):
            raise ValueError(f"kind is 'snapshot' or 'delta', not {kind!r}")
        base = self.latest() if base is None else base
        gone = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in rows.columns else F.lit(False)
        out = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], gone.alias(DELETED))
        name = uuid.uuid4().hex
        writer = out.write
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/data/{COMMIT}={name}")
        version = self._after(base) + 1
        self._publish(Commit(version, kind, name, info or {}))
        return version

    def _after(self, base: int) -> int:
        """``base``, or the last of the numbers directly after it whose writers died before the commit
        file's end: they keep their numbers and nobody reads them."""
        numbers, n = set(self._numbers()), base
        while n + 1 in numbers and self._manifest(n + 1) is None and self._age_ms("commits", f"{n + 1:020d}.json") > UNFINISHED_MS:
            n += 1
        return n

    def _age_ms(self, *parts: str) -> float:
        return time.time() * 1000 - self._fs().getFileStatus(self._path(*parts)).getModificationTime()

    def _publish(self, c: Commit) -> None:
        text = json.dumps({"version": c.version, "kind": c.kind, "commit": c.commit, "info": c.info})
        if c.version in self._numbers():
            raise Conflict(f"version {c.version} of {self.path} is there already")
        try:
            stream = self._fs().create(self._path("commits", f"{c.version:020d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {c.version} of {self.path} is there already") from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def update(self, change: Callable[[DataFrame, int], DataFrame], kind: str = "delta", retries: int = 3) -> int:
        """Commit ``change(rows of the latest version, number of the new one)``; read anew and try again if
        another writer was first."""
        for attempt in range(retries + 1):
            base = self.latest()
            try:
                return self.commit(change(self.read(base), self._after(base) + 1), kind, base)
            except Conflict:
                if attempt == retries:
                    raise
        raise AssertionError

    def compact(self, keep: Callable[[DataFrame], DataFrame] | None = None, info: dict | None = None) -> int:
        """A snapshot of the latest version (of what ``keep`` leaves of it) as a new version."""
        base = self.latest()
        rows = self.read(base)
        return self.commit(keep(rows) if keep else rows, "snapshot", base, info)

    def vacuum(self, versions: int = 1, unnamed_ms: int = 24 * 3600 * 1000) -> list[str]:
        """Delete rows that none of the newest ``versions`` versions is read from, and rows no commit file
        names that are older than ``unnamed_ms`` (a younger one may be a commit on its way). Commit files
        of versions that cannot be read any more go too."""
        whole = self.versions()
        if not whole:
            return []
        first = self.commits_of(whole[-min(versions, len(whole))])[0].version
        named = {self._manifest(v).commit: v for v in whole}
        fs, gone = self._fs(), []
        for folder in self._names("data"):
            v = named.get(folder.removeprefix(f"{COMMIT}="))
            if (v is not None and v < first) or (v is None and self._age_ms("data", folder) > unnamed_ms):
                gone.append(folder)
        for v in whole:
            if v < first:
                fs.delete(self._path("commits", f"{v:020d}.json"), False)
        for folder in gone:
            fs.delete(self._path("data", folder), True)
        return gone

    # -- reading -----------------------------------------------------------------------
    def _rows(self, commits: list[Commit]) -> DataFrame:
        """Rows of some commits with ``commit``, straight from their files."""
        inner = [f for f in self.schema if f.name not in self.partition_by]
        outer = [f for f in self.schema if f.name in self.partition_by]
        schema = StructType([*inner, StructField(DELETED, BooleanType()), StructField(COMMIT, StringType()), *outer])
        folders = [f"{self.path}/data/{COMMIT}={c.commit}" for c in commits]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)

    def _latest_rows(self, commits: list[Commit]) -> DataFrame:
        rows = self._rows(commits)
        if len(commits) <= 1:
            return rows.drop(COMMIT)
        number = F.element_at(F.create_map(*[F.lit(x) for c in commits for x in (c.commit, c.version)]), F.col(COMMIT))
        by = [*self.key, *[c for c in self.partition_by if c not in self.key]]
        rest = [f.name for f in self.schema if f.name not in by]
        newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest], F.col(DELETED)), F.struct(*self.order, number))
        got = rows.groupBy(*by).agg(newest.alias("_row"))
        return got.select(*by, *[F.col("_row")[c].alias(c) for c in (*rest, DELETED)])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest, if not given)."""
        version = self.latest() if version is None else version
        rows = self._latest_rows(self.commits_of(version))
        return rows.filter(~F.col(DELETED)).select(*self.schema.names)

    def changes(self, version: int) -> DataFrame:
        """The feed from the version before to ``version``, as :func:`changes` gives it. After a delta only
        keys that it holds can differ, so only those rows of the version before are read."""
        chain = self.commits_of(version)
        older = [v for v in self.versions() if v < version]
        before = self.read(older[-1] if older else 0)
        after = self.read(version)
        if chain[-1].kind == "delta":
            by = [*self.key, *[c for c in self.partition_by if c not in self.key]]
            keys = self._rows(chain[-1:]).select(*by).distinct()
            on = lambda df: df.join(keys.select(*[F.col(c).alias(f"_k_{c}") for c in by]), _all_same(by, "_k_"), "left_semi")
            before, after = on(before), on(after)
        return changes(before, after, list(self.key))


def _all_same(key: list[str], prefix: str) -> Column:
    cond = F.lit(True)
    for c in key:
        cond = cond & same(F.col(c), F.col(f"{prefix}{c}"))
    return cond


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The difference of two tables with the same columns, one row per key that differs: the key, ``change``
    ('insert', 'update', 'delete'), and structs ``before`` and ``after`` (null where there is no row).

    Keys are unique on each side; null keys are equal. The full outer join carries keys and
    64-bit row hashes; whole rows are fetched for the differing keys alone.
    """
    names = before.columns
    # of the rows as JSON: a hash of the values themselves passes over nulls, wherever they stand
    digest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}))
    old = before.select(*[F.col(c).alias(f"_o_{c}") for c in key], digest.alias("_oh"))
    new = after.select(*[F.col(c).alias(f"_n_{c}") for c in key], digest.alias("_nh"))
    pair = F.lit(True)
    for c in key:
        pair = pair & same(F.col(f"_o_{c}"), F.col(f"_n_{c}"))
    both = old.join(new, pair, "full_outer").filter(~same(F.col("_oh"), F.col("_nh")))
    kind = F.when(F.col("_oh").isNull(), "insert").when(F.col("_nh").isNull(), "delete").otherwise("update")
    differs = both.select(*[F.when(F.col("_oh").isNull(), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(f"_k_{c}") for c in key], kind.alias("change"))

    def image(rows: DataFrame, name: str) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias(name)
        return rows.select(*[F.col(c).alias(f"_{name}_{c}") for c in key], whole)

    out = differs
    for rows, name in ((before, "before"), (after, "after")):
        on = F.lit(True)
        for c in key:
            on = on & same(F.col(f"_k_{c}"), F.col(f"_{name}_{c}"))
        out = out.join(image(rows, name), on, "left")
    return out.select(*[F.col(f"_k_{c}").alias(c) for c in key], "change", "before", "after")


def apply_changes(rows: DataFrame, feed: DataFrame, key: list[str]) -> DataFrame:
    """The table after ``feed``: rows of other keys, and the rows after each insert and update."""
    touched = feed.select(*[F.col(c).alias(f"_k_{c}") for c in key])
    left = rows.join(touched, _all_same(key, "_k_"), "left_anti")
    return left.unionByName(feed.filter(F.col("change") != "delete").select("after.*").select(*rows.columns))


def stream_changes(table: VersionedTable, out: str, checkpoint: str, trigger_once: bool = True):
    """S9 as a stream: each new commit file starts a batch that writes the feeds of all versions not in ``out``
    yet, one folder ``version=<n>`` each. A batch that is run again writes the same folders anew, so
    the feed has every version once. Returns the started query."""
    spark = table.spark
    files = spark.readStream.schema("version long").json(f"{table.path}/commits")

    def write(_batch: DataFrame, _epoch: int) -> None:
        written = VersionedTable(spark, out.rstrip("/"), table.schema, table.key)
        for v in table.versions():
            if "_SUCCESS" not in written._names(f"version={v}"):  # not there, or its job did not end
                table.changes(v).write.mode("overwrite").parquet(f"{out.rstrip('/')}/version={v}")

    w = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="5 seconds")
    return w.start()


def read_feed(spark: SparkSession, out: str) -> DataFrame:
    """The feeds that :func:`stream_changes` has written, with ``version``."""
    return spark.read.parquet(out)
