"""State kept as a changelog with snapshots, fed by micro-batches.

A batch is folded to one row per key and committed as a delta of a
:class:`~gleaner.sources.versions.VersionedTable`; the state itself is neither read nor
copied by it. After ``compact_every`` deltas a snapshot follows, which leaves out what
``expire`` names, and rows no version needs are removed.

The watermark is the greatest event time seen, less ``delay``, kept in the commit files; it
never falls. Rows behind it are late and dropped before they are folded, so a removal older than
the watermark may be forgotten: nothing it covers can come any more.

A commit names the stream (its checkpoint's id) and the batch. A batch that is run again after a failure
finds its commit and writes nothing; a stream that starts over with a new checkpoint goes on
with the state that is there.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.versions import Commit, VersionedTable

Fold = Callable[[DataFrame], DataFrame]


def newest_info(table: VersionedTable, name: str, where: Callable[[Commit], bool] = lambda c: True):
    """The newest commit's entry ``name`` among those for which ``where`` holds; None if there is none."""
    for v in reversed(table._numbers()):
        m = table._manifest(v)
        if m is not None and name in m.info and where(m):
            return m.info[name]
    return None


def watermark(table: VersionedTable) -> dt.datetime | None:
    """Event time behind which rows are late (UTC, without zone)."""
    us = newest_info(table, "watermark")
    return None if us is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


def _at(us: int):
    return F.timestamp_micros(F.lit(us))


def append_batch(
    table: VersionedTable,
    batch: DataFrame,
    fold: Fold,
    delay: dt.timedelta | None = None,
    ts: str = "ts",
    stream: str = "",
    epoch: int | None = None,
    compact_every: int = 10,
    expire: Callable[[DataFrame, int], DataFrame] | None = None,
) -> int:
    """Fold ``batch`` into the table as a delta; the version after it.

    ``expire(rows, watermark)`` gives the rows that a snapshot keeps (watermark in microseconds).
    """
    mine = lambda c: c.info.get("stream") == stream
    if epoch is not None and (done := newest_info(table, "epoch", mine)) is not None and done >= epoch:
        version = table.latest()
    else:
        mark = newest_info(table, "watermark")
        if delay is not None:
            if mark is not None:
                batch = batch.filter(F.col(ts) >= _at(mark))
            top = batch.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()[0]
            if top is not None:
                risen = top - int(delay / dt.timedelta(microseconds=1))
                mark = risen if mark is None else max(mark, risen)
        info = {"stream": stream}
        if epoch is not None:
            info["epoch"] = epoch
        if mark is not None:
            info["watermark"] = mark
        version = table.commit(fold(batch), "delta", info=info)
    chain = table.commits_of(version)
    if sum(c.kind == "delta" for c in chain) >= compact_every:
        mark = newest_info(table, "watermark")
        keep = None if expire is None or mark is None else (lambda rows: expire(rows, mark))
        version = table.compact(keep, {"watermark": mark} if mark is not None else {})
        table.vacuum(versions=1)
    return version


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint gives it; another checkpoint, even in the same place, has another."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def stream_into(source: DataFrame, table: VersionedTable, checkpoint: str, fold: Fold, trigger_once: bool = True, **options):
    """Start a stream that folds every micro-batch of ``source`` into ``table`` (options of :func:`append_batch`)."""

    def write(batch: DataFrame, epoch: int) -> None:
        append_batch(table, batch, fold, stream=checkpoint_id(table.spark, checkpoint), epoch=epoch, **options)

    w = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="5 seconds")
    return w.start()
