"""Every event's fate under its user's consent as it was and became.

An event whose user has consented is delivered at once, one of a user who declined is dropped. While
the user has not decided, it waits in the user's queue: the next decision flushes the queue
(``buffered``) or clears it. The queue holds the newest ``limit`` events, and none longer
than ``timeout``; what it loses so is evicted. A consent of null takes a decision back.

``consent_flow`` decides all events of a table at once; ``stream_consent`` does the same as rows arrive, with
one processor state per user. Events need not arrive in order: a user's rows are worked on in
event time, once the watermark has passed them. At one time a consent comes before events, then the smaller id.

Routes: deliver, drop, flush, clear, evicted, queue (still undecided at the end).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gleaner.operators.events import MAX_QUEUED
from gleaner.operators.view import top_k_per_group

DAY = dt.timedelta(days=1)
_US = dt.timedelta(microseconds=1)


def consent_flow(events: DataFrame, consents: DataFrame, limit: int = MAX_QUEUED, timeout: dt.timedelta | None = None, upto: Column | None = None, bin_width: dt.timedelta = DAY) -> DataFrame:
    """``events(event_id, user_id, ts)``, ``consents(consent_id, user_id, ts, consent)`` -> a row per event:
    event_id, user_id, route, buffered, decided_at. ``upto`` is the time until which the queue was kept
    (the latest time of both tables, if not given).

    A user's rows are cut into time bins. Inside a bin, windows find the consent that holds at an
    event and the next decision; a second pass over one row per user and bin carries both across bins. So a user with a third
    of all events is spread over their bins, and no task needs a user whole.
    """
    e = events.select("user_id", "ts", F.lit(1).alias("kind"), F.col("event_id").alias("id"), F.lit(None).cast("boolean").alias("consent"))
    c = consents.select("user_id", "ts", F.lit(0).alias("kind"), F.col("consent_id").alias("id"), "consent")
    width = int(bin_width / _US)
    both = e.unionByName(c).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("bin", F.floor(F.col("at") / width))
    order = ["at", "kind", "id"]
    is_consent = F.col("kind") == 0
    said = F.when(is_consent, F.struct("consent"))
    decided = F.when(is_consent & F.col("consent").isNotNull(), F.struct("at", "consent"))

    user = F.struct("user_id")  # null users are one user
    keyed = both.withColumn("user", user)
    inside = Window.partitionBy("user", "bin")
    up = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = inside.orderBy(*[F.col(x).desc() for x in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = keyed.withColumn("state", F.last(said, ignorenulls=True).over(up)).withColumn("next", F.last(decided, ignorenulls=True).over(down))

    place = F.struct(*order)
    bins = keyed.groupBy("user", "bin").agg(F.max_by(said, F.when(is_consent, place)).alias("last"), F.min_by(decided, F.when(decided.isNotNull(), place)).alias("first"))
    days = Window.partitionBy("user")
    carried = bins.select(
        "user",
        "bin",
        F.last("last", ignorenulls=True).over(days.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("state_before"),
        F.last("first", ignorenulls=True).over(days.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("next_after"),
    )
    j = near.filter("kind = 1").join(carried, ["user", "bin"])
    state = F.coalesce(F.col("state"), F.col("state_before"))["consent"]
    ahead = F.coalesce(F.col("next"), F.col("next_after"))
    j = j.select("user", "user_id", "id", "at", state.alias("state"), ahead["at"].alias("next_at"), ahead["consent"].alias("next_consent"))

    # the oldest place that a queue still holds when it is decided; a queue is known by its user and decision
    waiting = j.filter(F.col("state").isNull()).select("user", F.struct("next_at").alias("queue"), "at", "id")
    held = top_k_per_group(waiting, ["user", "queue"], [F.col("at").desc(), F.col("id").desc()], limit)
    oldest = held.groupBy("user", "queue").agg(F.min(F.struct("at", "id")).alias("oldest"))
    j = j.withColumn("queue", F.when(F.col("state").isNull(), F.struct("next_at"))).join(oldest, ["user", "queue"], "left")
    if timeout is None:
        fresh = F.lit(True)
    else:
        end = F.unix_micros(upto.cast("timestamp")) if upto is not None else F.lit(both.agg(F.max("at")).first()[0])
        fresh = F.coalesce(F.col("next_at"), end) - F.col("at") <= int(timeout / _US)
    kept = (F.struct("at", "id") >= F.col("oldest")) & fresh
    route = (
        F.when(F.col("state"), "deliver")
        .when(~F.col("state"), "drop")
        .when(~kept, "evicted")
        .when(F.col("next_consent").isNull(), "queue")
        .when(F.col("next_consent"), "flush")
        .otherwise("clear")
    )
    done = route.isin("flush", "clear")
    return j.select(F.col("id").alias("event_id"), "user_id", route.alias("route"), (route == "flush").alias("buffered"), F.when(done, F.timestamp_micros("next_at")).alias("decided_at"))


OUT_DDL = "event_id long, user_id long, route string, buffered boolean, decided_at timestamp"


class ConsentQueue(StatefulProcessor):
    """One user's rows: those the watermark has not passed, the consent that holds, and the queue."""

    def __init__(self, limit: int, timeout_us: int | None) -> None:
        self.limit, self.timeout = limit, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # by event time: rows that came, in no order
        self.waiting = handle.getMapState("waiting", "at long, kind int, id long", "consent boolean, has_consent boolean")
        self.queue = handle.getListState("queue", "at long, id long")
        self.consent = handle.getValueState("consent", "consent boolean, known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for df in rows:
            for at, kind, i, consent in zip(df["at"], df["kind"], df["id"], df["consent"], strict=True):
                none = consent is None or pd.isna(consent)
                self.waiting.updateValue((int(at), int(kind), int(i)), (None if none else bool(consent), not none))
                times.add(int(at))
        if times:
            self._wake(min(times))
        return iter(())

    def _wake(self, at: int) -> None:
        """A timer for what is due at a time: it fires when the watermark is past it."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((tuple(k), v) for k, v in self.waiting.iterator()), key=lambda r: r[0])
        ready = [r for r in rows if r[0][0] < mark]
        held = self.consent.get() if self.consent.exists() else None
        state = held[0] if held is not None and held[1] else None
        queue = [tuple(q) for q in self.queue.get()]
        out: list[tuple] = []

        def evict(now: int) -> None:
            while self.timeout is not None and queue and now - queue[0][0] > self.timeout:
                out.append((queue.pop(0)[1], "evicted", False, None))

        for (at, kind, i), (consent, has) in ready:
            self.waiting.removeKey((at, kind, i))
            if kind == 0:
                state = consent if has else None
                if state is not None:
                    evict(at)
                    out += [(q, "flush" if state else "clear", bool(state), at) for _, q in queue]
                    queue.clear()
            elif state is None:
                queue.append((at, i))
                if len(queue) > self.limit:
                    out.append((queue.pop(0)[1], "evicted", False, None))
            else:
                out.append((i, "deliver" if state else "drop", False, None))
        evict(mark)
        self.consent.update((state, state is not None))
        self.queue.put(queue) if queue else self.queue.clear()
        later = [r[0][0] for r in rows if r[0][0] >= mark]
        if later:
            self._wake(later[0])
        if queue and self.timeout is not None:
            self._wake(queue[0][0] + self.timeout)
        if out:
            yield pd.DataFrame(
                {
                    "event_id": [o[0] for o in out],
                    "user_id": [key[0]] * len(out),
                    "route": [o[1] for o in out],
                    "buffered": [o[2] for o in out],
                    "decided_at": pd.to_datetime(pd.Series([o[3] for o in out], dtype="Int64"), unit="us"),
                }
            )


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose streams keep their state in RocksDB, as processors with timers need."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return s


ROWS_DDL = "user_id long, ts timestamp, kind int, id long, consent boolean"


def consent_rows(events: DataFrame, consents: DataFrame) -> DataFrame:
    """Both tables as rows of the stream's source (``ROWS_DDL``)."""
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("kind"), F.col("event_id").cast("long").alias("id"), F.lit(None).cast("boolean").alias("consent"))
    return e.unionByName(consents.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("kind"), F.col("consent_id").cast("long").alias("id"), "consent"))


def stream_consent(
    spark: SparkSession,
    rows_path: str,
    out_path: str,
    checkpoint: str,
    delay: str = "1 hour",
    limit: int = MAX_QUEUED,
    timeout: dt.timedelta | None = None,
    max_files: int | None = None,
    trigger_once: bool = True,
):
    """Files of rows (``ROWS_DDL``) -> Parquet rows of ``OUT_DDL`` as events are decided. ``spark`` is a
    :func:`stream_session`. Rows later than ``delay`` are dropped by the watermark. Returns the started query."""
    reader = spark.readStream.schema(ROWS_DDL)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(rows_path).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    got = rows.groupBy("user_id").transformWithStateInPandas(
        ConsentQueue(limit, None if timeout is None else int(timeout / _US)),
        outputStructType=StructType.fromDDL(OUT_DDL),
        outputMode="Append",
        timeMode="EventTime",
    )
    w = got.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="5 seconds")
    return w.start()
