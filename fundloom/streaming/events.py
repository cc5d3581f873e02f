"""Sessions, rate limits and windows of event streams, for batch tables and for structured streams."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; on a stream, windows close ``late`` after the latest event."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = stamped.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


class AllowedHits:
    """The hits of one key that were allowed in the trailing window; refused ones leave no trace.

    Holds at most ``limit`` times, whatever a key's rate is.
    """

    def __init__(self, limit: int, span: int, kept: list[int] | None = None):
        self.limit, self.span, self.kept = limit, span, kept or []

    def hit(self, at: int) -> tuple[int, bool, int]:
        """(hits that count, whether this one is allowed, time until the first of them goes)."""
        gone = bisect.bisect_right(self.kept, at - self.span)
        del self.kept[:gone]
        held = bisect.bisect_right(self.kept, at)
        if held >= self.limit:
            return held, False, self.span - (at - self.kept[held - self.limit])
        bisect.insort(self.kept, at)
        del self.kept[: -self.limit]
        return held, True, 0


RATES = "event_id long, user_id long, hits long, allowed boolean, retry_us long"


def rate_limit(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """(event_id, user_id, hits, allowed, retry_us): whether each event of a user is within ``limit`` events in ``seconds``.

    Only allowed events count, so ``hits`` is their number in the window before
    the event, and ``retry_us`` is the time until the earliest of them is out.
    Events of one time are taken by id; null users are one user; events without
    a time are left out, as the limit can't place them.

    What is decided depends on what was decided before, so a user's events are
    folded in order, with ``limit`` times as state. A pause of a whole window
    forgets everything; users are cut there, at windows of the clock without
    events, so that a busy user's days are folds of their own.
    """
    span = seconds * 1_000_000
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("at IS NOT NULL")
    rows = rows.withColumn("clock", F.expr(f"at div {span}"))
    order = Window.partitionBy("user_id").orderBy("clock")
    runs = rows.groupBy("user_id", "clock").agg(F.count("*").alias("n"))
    first = F.when(F.coalesce(F.col("clock") - F.lag("clock").over(order), F.lit(9)) > 1, F.col("clock"))
    runs = runs.withColumn("first", first).withColumn("run", F.last("first", ignorenulls=True).over(order)).select(F.col("user_id").alias("user_"), F.col("clock").alias("clock_"), "run")
    placed = rows.join(runs, F.col("user_id").eqNullSafe(F.col("user_")) & (F.col("clock") == F.col("clock_")))
    dealt = placed.select("user_id", "run", "at", "event_id").repartition("user_id", "run").sortWithinPartitions("user_id", "run", "at", "event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, AllowedHits(limit, span)
        for batch in batches:
            out = []
            users, runs_, ats = (batch.column(c).to_pylist() for c in ("user_id", "run", "at"))
            for key, at in zip(zip(users, runs_, strict=True), ats, strict=True):
                if key != now:
                    now, state = key, AllowedHits(limit, span)
                out.append(state.hit(at))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("user_id"), *columns], names=["event_id", "user_id", "hits", "allowed", "retry_us"])

    return dealt.mapInArrow(fold, RATES)


class _LimitedUsers(StatefulProcessor):
    """``AllowedHits`` of each user of a stream; a timer clears what the watermark has left behind."""

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "times array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = AllowedHits(self.limit, self.span, list(self.kept.get()[0]) if self.kept.exists() else None)
        all_ = pd.concat(list(rows)).sort_values(["at", "event_id"])
        out = [state.hit(at) for at in all_["at"].tolist()]
        self.kept.update((state.kept,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state.kept[-1] // 1000 + self.span // 1000 + 1)
        yield pd.DataFrame({"event_id": all_["event_id"], "user_id": key[0], "hits": [x[0] for x in out], "allowed": [x[1] for x in out], "retry_us": [x[2] for x in out]})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.clear()
        yield pd.DataFrame({"event_id": [], "user_id": [], "hits": [], "allowed": [], "retry_us": []}).astype({"event_id": "int64", "user_id": "int64", "hits": "int64", "allowed": "bool", "retry_us": "int64"})

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """``rate_limit`` on a stream of non-null users; events that come more than ``late`` behind the latest are dropped.

    Events of one batch are taken in order of time; one that comes after a
    later one was decided sees what is known then. A user's state is at most
    ``limit`` times, and is cleared once no event to come can meet them.
    """
    keep_state_on_disk(events.sparkSession)
    stamped = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    timed = stamped.withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("user_id").transformWithStateInPandas(_LimitedUsers(limit, seconds * 1_000_000), RATES, "Append", "EventTime")


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of several variables and with timers needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


CHECKS = "event_id long, session_id long, valid boolean, reason string, refreshed boolean"


def session_checks(requests: DataFrame, issued: DataFrame, users: DataFrame, throttle: int = 60) -> DataFrame:
    """(event_id, session_id, valid, reason, refreshed) for ``requests(event_id, session_id, ts)``.

    ``issued(session_id, user_id, issued_at, expires_at)`` are sessions, and
    ``users(user_id, is_active)`` who may have one. A request is valid if its
    session is known, has not expired (it has at its expiry) and its user is
    active. One that isn't valid ends its session: later requests find it
    unknown. Reasons are ``unknown``, ``expired`` and ``inactive``. A valid
    request refreshes when the session was seen last if that is more than
    ``throttle`` seconds ago; a session counts as seen when it is issued.

    A session that isn't there, a null one, or one that is issued later than
    the request is unknown. A user that isn't in the table is inactive.
    Requests of one time are taken by id. A session's requests are folded in
    order with two numbers as state; no session is longer than its expiry.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    micros = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("issued_at", "expires_at")]
    known = issued.join(users.select("user_id", F.col("is_active").alias("active")), "user_id", "left")
    known = known.select("session_id", *micros, F.coalesce("active", F.lit(False)).alias("active"))
    met = requests.select("event_id", "session_id", at).join(known, "session_id", "left")
    there = F.coalesce(F.col("issued_at") <= F.col("at"), F.lit(False))
    dealt = met.withColumn("there", there).repartition("session_id").sortWithinPartitions("session_id", "at", "event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ended, seen = object(), False, 0
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("session_id", "at", "issued_at", "expires_at", "active", "there"))
            for session, time, issued_at, expires_at, active, known_ in zip(*columns, strict=True):
                if session != now:
                    now, ended, seen = session, False, issued_at
                if not known_ or ended:
                    out.append((False, "unknown", False))
                elif expires_at <= time or not active:
                    ended = True
                    out.append((False, "expired" if expires_at <= time else "inactive", False))
                else:
                    fresh = time - seen > throttle * 1_000_000
                    seen = time if fresh else seen
                    out.append((True, None, fresh))
            found = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.bool_(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("session_id"), *found], names=["event_id", "session_id", "valid", "reason", "refreshed"])

    return dealt.mapInArrow(fold, CHECKS)


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """(user_id, start, n, events): runs of a user's events without a pause of ``gap``; works on streams too."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap)
    grouped = stamped.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "last_seen", "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what a stream has now and append it to a Parquet table; the checkpoint makes a restart safe."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upsert_each_batch(stream: DataFrame, apply, checkpoint: str) -> None:
    """Call ``apply(batch, batch_id)`` for what a stream has now; ``apply`` must be safe to repeat for a batch id."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
