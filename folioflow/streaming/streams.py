"""Discovery, status log, stuck sweep, submission guard, and resuming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import paths
from folioflow.operators import registry
from folioflow.schemas import TERMINAL
from folioflow.sources.catalog import list_files

#: A second submission of a key counts as a repeat while the first job may still be running.
GUARD_DELAY = "2 hours"

def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything available to Parquet at ``out``, exactly once across restarts."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(
        out
    ).awaitTermination()


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``files_per_batch`` bounds a micro-batch and thus its state changes."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# ---- discovery -----------------------------------------------------------------------------


def discover_on_ticks(ticks: DataFrame, root: str, jobs: Callable[[], DataFrame], log: str, checkpoint: str, prefix: str = "", look_back: int | None = None) -> None:
    """List below ``root`` once per micro-batch of ``ticks(at)`` and log pending jobs for documents that have none.

    ``jobs`` gives the registry as it is when the batch runs; documents of earlier batches count as known, too.  Each batch
    owns the folder ``batch=<id>`` of the log and overwrites it, so a replay logs every document once.  Listing and anti join
    run in tasks; nothing remembers the files seen but the log.  Where the registry takes up logged jobs within some batches,
    ``look_back`` says how many, and older parts of the log are not read.
    """

    def discover(batch: DataFrame, batch_id: int) -> None:
        at = batch.agg(F.max("at").cast("string").alias("at")).first()["at"]
        if at is not None:
            fresh = discovered_jobs(list_files(batch.sparkSession, root, prefix), jobs(), at)
            earlier = _earlier(batch.sparkSession, log, batch_id, look_back)
            if earlier is not None:
                fresh = fresh.join(earlier.select("file_key"), "file_key", "left_anti")
            fresh.write.mode("overwrite").parquet(f"{log}/batch={batch_id:012d}")

    _each_batch(ticks, discover, checkpoint)


def _each_batch(ticks: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    ticks.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _earlier(spark: SparkSession, log: str, batch_id: int, look_back: int | None) -> DataFrame | None:
    """The log of the ``look_back`` batches before ``batch_id`` (of all, if no number is given); None if there is none."""
    try:
        held = spark.read.parquet(log)
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    held = held.where(F.col("batch") < batch_id)
    return held if look_back is None else held.where(F.col("batch") >= batch_id - look_back)


def discovered_jobs(arrivals: DataFrame, jobs: DataFrame, at: datetime | str | Column) -> DataFrame:
    """Pending jobs for arrivals without one.  The id depends on key and time only, so a replay agrees."""
    submitted = registry.keys_in(jobs)
    when = registry.clock(jobs, at)
    fresh = arrivals.join(submitted, arrivals["key"] == submitted["file_key"], "left_anti")
    return fresh.select(
        paths.job_id("key", when.cast("string")).alias("job_id"),
        F.col("key").alias("file_key"),
        F.col("size").alias("file_size"),
        when.alias("submitted_at"),
    )


# ---- status log ----------------------------------------------------------------------------


def current_jobs(base: DataFrame, log: DataFrame, order: str) -> DataFrame:
    """Base table with the whole log applied in order."""
    return registry.update(base, log, order)


def log_batches(updates: DataFrame, log: str, checkpoint: str) -> None:
    """Append a stream of update rows to a log with one folder for each micro-batch; a replayed batch overwrites its own."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id:012d}")

    _each_batch(updates, append, checkpoint)


def watched_status(events: DataFrame, *order: str) -> DataFrame:
    """What a poller that stops at the first terminal state shows last, per job.

    Two aggregates with map-side reduction; no job's events are gathered in one place.
    """
    position = F.struct(*order)
    terminal = F.col("status").isin(*TERMINAL)
    return events.groupBy("job_id").agg(
        F.coalesce(F.min_by("status", F.when(terminal, position)), F.max_by("status", position)).alias("status"),
        F.bool_or(terminal).alias("terminal"),
    )


# ---- sweep ---------------------------------------------------------------------------------


def sweep_on_ticks(
    ticks: DataFrame, jobs: DataFrame | Callable[[], DataFrame], log: str, checkpoint: str, max_hours: float = registry.MAX_HOURS, look_back: int | None = None
) -> None:
    """Sweep on every tick of ``ticks(at)``: a job is failed at the first tick at which it is stuck, and never again.

    ``jobs`` is the registry, or a function that gives it as it is when a batch runs; what earlier batches failed is left out.
    Each batch owns the folder ``batch=<id>`` of the log and overwrites it, so a batch replayed after a crash leaves the same
    log, which has one row for each swept job.  ``look_back`` is that of :func:`discover_on_ticks`.
    """

    def sweep(batch: DataFrame, batch_id: int) -> None:
        # The ticks of one batch in order, one small row.
        order = batch.where("at is not null").agg(F.array_sort(F.collect_set("at")).alias("ticks"))
        current = jobs() if callable(jobs) else jobs
        earlier = _earlier(batch.sparkSession, log, batch_id, look_back)
        if earlier is not None:
            current = current.join(earlier.select("job_id"), "job_id", "left_anti")
        updates = registry.first_stuck(current, order, max_hours).withColumn("seq", F.lit(batch_id))
        updates.write.mode("overwrite").parquet(f"{log}/batch={batch_id:012d}")

    _each_batch(ticks, sweep, checkpoint)


# ---- submission guard ----------------------------------------------------------------------


def first_of_batch(requests: DataFrame, key: str = "file_key", at: str = "at") -> DataFrame:
    """Of the rows a task reads at once, the earliest of each key, and the latest of all for the watermark.

    The guard admits one row of a key in a micro-batch at most, so nothing is lost, and a hot key is shuffled as one row for
    each Arrow batch instead of all its rows.
    """

    def reduce(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(batch.column(at), null_placement="at_start").to_pylist()
            keys, first = batch.column(key).to_pylist(), {}
            for i in order:
                first.setdefault(keys[i], i)
            yield batch.take(pa.array(sorted({*first.values(), order[-1]})))

    return requests.mapInArrow(reduce, requests.schema)


def guarded_submissions(requests: DataFrame, delay: str = GUARD_DELAY) -> DataFrame:
    """Drop repeats of a ``file_key`` within ``delay`` of its first request ``(file_key, at)``.

    State is one timestamp per key and leaves with the watermark.
    """
    return first_of_batch(requests).withWatermark("at", delay).dropDuplicatesWithinWatermark(["file_key"])
