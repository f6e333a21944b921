"""Streams with state of their own: funnels with a timeout, a join of two streams, repeats
that are dropped, sessions.

All run the events' files through a stream until they are used up and append what is settled
to a table in the shared folder; what the last watermark (an hour behind the latest event)
has not passed yet is not settled and gives no row. Rows that come later than the watermark
are dropped. Rows of a null time or a null user take no part. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.sources.shared import fresh_path
from quarry.streaming.windows import events

STEPS = ["view", "click", "purchase"]
PACKED = 10_000  # events in one value of the state
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State kept by RocksDB, which transformWithState needs, for queries begun within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def appended(stream: DataFrame, progress: list | None = None) -> DataFrame:
    """The rows that the stream appends, in a table to which each batch is added once. The
    batches' progress goes to `progress`."""
    spark = stream.sparkSession
    base = fresh_path(spark, "stream")
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
    query = writer.trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    if not query.lastProgress:  # no file, no batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows of a time for which the condition holds. One that does not name the time would
    be pushed below the watermark, which would then not see the other rows."""
    return rows.where(F.when(F.col("at").isNotNull(), condition))


class Funnel(StatefulProcessor):
    """A user's view, click and purchase within a timeout.

    A view opens a funnel if none is open; then a click and then a purchase that come up to
    `timeout` microseconds after the view move it on. It ends with the purchase or, without
    one, with the timeout. Events wait in the state until the watermark has passed them, so
    they are taken in the order of their times, whatever batch they come in. They wait packed,
    many in one value, with a timer for the earliest of them; it wakes the user, all events
    that are due are taken at once, and the rest get a timer again. So the calls to the state,
    each a message to the JVM, grow with the users of a batch and not with their events. The
    state holds the events of the watermark's delay and one funnel."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at binary, step binary")
        self.open = handle.getValueState("open", "started long, clicked long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))  # milliseconds, not before the time

    def _keep(self, at: np.ndarray, step: np.ndarray) -> None:
        self.waiting.appendValue((at.tobytes(), step.tobytes()))
        self._wake(int(at.min()))

    def _due(self, until: int) -> Iterator[tuple[int, int]]:
        """The waiting events up to `until` in order; those after it go on waiting."""
        if not self.waiting.exists():
            return
        packed = list(self.waiting.get())
        at = np.concatenate([np.frombuffer(p[0], "<i8") for p in packed])
        step = np.concatenate([np.frombuffer(p[1], "i1") for p in packed])
        due = at <= until
        if not due.any():
            return
        self.waiting.clear()
        if not due.all():
            self._keep(at[~due], step[~due])
        at, step = at[due], step[due]
        order = np.lexsort((step, at))
        for i in range(0, len(order), PACKED):
            some = order[i : i + PACKED]
            yield from zip(at[some].tolist(), step[some].tolist())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        while some := list(islice(rows, PACKED)):
            self._keep(np.array([r.micros for r in some], "<i8"), np.array([r.step for r in some], "i1"))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        was = now = self.open.get()
        out = []
        for at, step in self._due(until):
            if now and at > now[0] + self.timeout:
                out.append((*now, None, now[0] + self.timeout))
                now = None
            if now is None and step == 0:
                now = (at, None)
            elif now and step == 1 and now[1] is None and at > now[0]:
                now = (now[0], at)
            elif now and step == 2 and now[1] is not None and at > now[1]:
                out.append((*now, at, at))
                now = None
        if now and now[0] + self.timeout <= until:
            out.append((*now, None, now[0] + self.timeout))
            now = None
        if now is None and was is not None:
            self.open.clear()
        elif now != was:
            self.open.update(now)
            if was is None or now[0] != was[0]:
                self._wake(now[0] + self.timeout)
        return iter([Row(user_id=key[0], started=s, clicked=c, purchased=p, ended=e) for s, c, p, e in out])

    def close(self) -> None:
        pass


def funnels(spark: SparkSession, sf_dir: str, timeout_hours: int = 12, files_per_batch: int = 1000, progress: list | None = None, source: DataFrame | None = None) -> DataFrame:
    """(user_id, started, clicked, purchased, ended) of each funnel that has ended. One
    user's events are taken one after the other; users are dealt out by a hash."""
    rows = events(spark, sf_dir, files_per_batch) if source is None else source
    step = F.coalesce(*[F.when(F.col("event_type") == s, i) for i, s in enumerate(STEPS)])
    rows = only(rows, step.isNotNull() & F.col("user_id").isNotNull()).select("user_id", "at", F.unix_micros("at").alias("micros"), step.alias("step"))
    schema = "user_id long, started long, clicked long, purchased long, ended long"
    with rocksdb(spark):
        found = rows.groupBy("user_id").transformWithState(Funnel(timeout_hours * 3_600_000_000), schema, "Append", "EventTime")
        ended = appended(found, progress)
    times = [F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("started", "clicked", "purchased", "ended")]
    return ended.select("user_id", *times)


def click_purchases(spark: SparkSession, sf_dir: str, hours: int = 1, files_per_batch: int = 1000, progress: list | None = None, source: DataFrame | None = None) -> DataFrame:
    """(click_id, user_id, clicked, purchase_id, purchased): each click with each purchase of
    its user up to `hours` later, or with nulls once none can come any more.

    Both sides keep rows until the other side's watermark rules a partner out: clicks for
    `hours` and the watermark's delay, purchases for the delay."""
    rows = events(spark, sf_dir, files_per_batch) if source is None else source
    known = F.col("user_id").isNotNull()
    clicks = only(rows, known & (F.col("event_type") == "click")).select(F.col("event_id").alias("click_id"), "user_id", F.col("at").alias("clicked"))
    buys = only(rows, known & (F.col("event_type") == "purchase")).select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("by"), F.col("at").alias("purchased"))
    near = F.expr(f"user_id = by AND purchased > clicked AND purchased <= clicked + INTERVAL {hours} HOURS")
    pairs = appended(clicks.join(buys, near, "left_outer").drop("by"), progress)
    return pairs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("clicked", "purchased")})


def deliveries(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """The events as a sender gives them that is not sure of errors: it sends these again."""
    rows = events(spark, sf_dir, files_per_batch)
    return rows.unionByName(only(rows, F.col("event_type") == "error"))


def distinct_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000, progress: list | None = None, source: DataFrame | None = None) -> DataFrame:
    """(event_id, user_id, event_type, ts): each delivered event once. An id is kept in the
    state until the watermark's delay has passed; one that comes again later than that is
    another event."""
    rows = deliveries(spark, sf_dir, files_per_batch) if source is None else source
    once = rows.where("at is not null").dropDuplicatesWithinWatermark(["event_id"])
    out = appended(once.select("event_id", "user_id", "event_type", "at"), progress)
    return out.select("event_id", "user_id", "event_type", F.col("at").cast("timestamp_ntz").alias("ts"))


def sessions(spark: SparkSession, sf_dir: str, gap_minutes: int = 30, files_per_batch: int = 1000, progress: list | None = None, source: DataFrame | None = None) -> DataFrame:
    """(user_id, started, ended, rows) of each session that is over: a user's events no more
    than the gap apart. Sessions in the state merge when a later batch joins them; a session
    is given out once, when the watermark has passed its end."""
    rows = events(spark, sf_dir, files_per_batch) if source is None else source
    window = F.session_window("at", f"{gap_minutes} minutes").alias("w")
    found = only(rows, F.col("user_id").isNotNull()).groupBy("user_id", window).agg(F.count("*").alias("rows"), F.max("at").alias("ended"))
    out = appended(found.select("user_id", F.col("w.start").alias("started"), "ended", "rows"), progress)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})
