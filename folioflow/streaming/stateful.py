"""Submission guard, stuck sweep and live status as keyed state with event-time timers.

Each is a processor of ``transformWithState``: one small state per key, kept by the state store, freed by an event or by a timer.
Rows of a key are handled in the order of their time within a micro-batch, and an event that comes after a deadline settles it as
the timer would have done, so results do not depend on where one micro-batch ends and the next begins.  Micro-batches must follow
each other in time; rows older than the latest of an earlier micro-batch may be dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from folioflow.schemas import TERMINAL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_HOUR = 3_600_000_000
#: Rows as old as the watermark are dropped, so it stays just behind the latest row.
BEHIND = "1 millisecond"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started in this block keep their state in RocksDB, which timers and keyed state variables need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _ms(micros: int) -> int:
    """The millisecond at which a time in microseconds has passed."""
    return -(-micros // 1000)


class _Deadline(StatefulProcessor):
    """A deadline per key, in microseconds, and the timer that ends it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "start bigint, stop bigint")

    def held(self) -> tuple[int, int] | None:
        return tuple(self.deadline.get()) if self.deadline.exists() else None

    def hold(self, before: tuple[int, int] | None, now: tuple[int, int] | None) -> None:
        """Put ``now`` in the place of ``before``, with its timer."""
        if now == before:
            return
        if before:
            self.handle.deleteTimer(_ms(before[1]))
        if now:
            self.deadline.update(now)
            self.handle.registerTimer(_ms(now[1]))
        else:
            self.deadline.clear()

    def close(self) -> None:
        pass


class Guard(_Deadline):
    """Admits a request while its key has no job under way: admitted before, not ended, and not older than ``delay``."""

    def __init__(self, delay: int) -> None:
        self.delay = delay

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = now = self.held()
        # What ends a job comes before a request of the same time.
        for at, ended in sorted((r["__at"], not r["__ended"]) for r in rows):
            ended = not ended
            if now and at >= now[1]:
                now = None
            if ended:
                now = None
            elif now is None:
                now = (at, at + self.delay)
                yield Row(file_key=key[0], at=at)
        self.hold(before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held()
        if held and _ms(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.deadline.clear()
        return iter([])


class Sweep(_Deadline):
    """Reports jobs that run for longer than ``limit``, once for each start, at the time when the limit is reached."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = now = self.held()
        for at, running in sorted((r["__at"], r["status"] == "running") for r in rows):
            if now and at > now[1]:
                yield Row(job_id=key[0], started_at=now[0], failed_at=now[1])
            now = (at, at + self.limit) if running else None
        self.hold(before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held()
        if held and _ms(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.deadline.clear()
            yield Row(job_id=key[0], started_at=held[0], failed_at=held[1])


class Latest(StatefulProcessor):
    """Keeps the last status of each job and its time; a terminal status stays."""

    def __init__(self, final: tuple[str, ...] = ()) -> None:
        self.final = final

    def init(self, handle) -> None:
        self.status = handle.getValueState("status", "status string, at bigint, position bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = now = tuple(self.status.get()) if self.status.exists() else None
        for at, position, status in sorted((r["__at"], r["__position"], r["status"]) for r in rows):
            if now is None or ((at, position) >= now[1:] and now[0] not in self.final):
                now = (status, at, position)
        if now != before:
            self.status.update(now)
            yield Row(job_id=key[0], status=now[0], at=now[1])

    def close(self) -> None:
        pass


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "Append") -> DataFrame:
    timed = rows.withWatermark("at", BEHIND).withColumn("__at", F.unix_micros("at"))
    return timed.groupBy(key).transformWithState(processor, schema, mode, "EventTime")


def _times(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.timestamp_micros(n) for n in names})


def guarded_until_done(events: DataFrame, ended: Column, delay_hours: float) -> DataFrame:
    """Admitted requests (``file_key``, ``at``) of a stream of requests and, where ``ended`` is true, ends of jobs.

    A key is free again when its job ends or, if no end is reported, ``delay_hours`` after it was admitted; a request at that
    very time is admitted.  State is two numbers for each job under way; all rows of a key in a micro-batch are
    sorted in one task, so bound the micro-batch.  Rows without key or time are left out.
    """
    rows = events.where(F.col("file_key").isNotNull() & F.col("at").isNotNull()).select("file_key", "at", F.coalesce(ended, F.lit(False)).alias("__ended"))
    found = _with_state(rows, "file_key", Guard(int(delay_hours * _HOUR)), "file_key string, at bigint")
    return _times(found, "at")


def sweep_by_timers(events: DataFrame, max_hours: float) -> DataFrame:
    """``job_id``, ``started_at`` and ``failed_at`` of jobs that report ``running`` and nothing more for over ``max_hours``.

    ``events`` (``job_id``, ``status``, ``at``) reports states as they change; another ``running`` starts anew.  No tick reads a
    registry: each running job has a timer, and a job whose next report comes after its limit is failed at the limit all
    the same.  The clock is the time of the reports of all jobs.  Rows without id or time are left out.
    """
    rows = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull()).select("job_id", "status", "at")
    found = _with_state(rows, "job_id", Sweep(int(max_hours * _HOUR)), "job_id string, started_at bigint, failed_at bigint")
    return _times(found, "started_at", "failed_at")


def status_changes(events: DataFrame, position: Column, stop_at_terminal: bool = False) -> DataFrame:
    """``job_id``, ``status`` and ``at`` of every micro-batch's last change of each job; the state holds the same for all jobs.

    ``position`` orders reports of one time.  With ``stop_at_terminal`` the first terminal status stays.
    """
    rows = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull()).select("job_id", "status", "at", position.cast("long").alias("__position"))
    found = _with_state(rows, "job_id", Latest(TERMINAL if stop_at_terminal else ()), "job_id string, status string, at bigint", "Update")
    return _times(found, "at")


def held_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``job_id``, ``status`` and ``at`` of all jobs, as the state of a stream of ``status_changes`` holds them: no log is folded."""
    state = spark.read.format("statestore").option("stateVarName", "status").load(checkpoint)
    return state.select(F.col("key.job_id").alias("job_id"), F.col("value.status").alias("status"), F.timestamp_micros("value.at").alias("at"))


def run_states(stream: DataFrame, checkpoint: str, out: str | None = None, mode: str = "append") -> None:
    """Run a stateful stream over everything available, to Parquet at ``out`` or, without it, for its state alone."""
    with keyed_state(stream.sparkSession):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        (writer.format("parquet").start(out) if out else writer.format("noop").start()).awaitTermination()
