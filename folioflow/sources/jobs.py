"""The job table on disk, by Spark's own readers and writers.

Registry operators give the new table; where it goes is the caller's: a new folder, or a table of whatever format the session
knows, whose own commits then decide between concurrent writers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.schemas import align_jobs


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``, brought to the current columns."""
    return align_jobs(spark.read.parquet(path))


def save_jobs(jobs: DataFrame, path: str) -> None:
    """Write a table to a new folder; one that is there is an error, so what ``jobs`` derives from is never overwritten."""
    align_jobs(jobs).write.mode("errorifexists").parquet(path)


def save_bucketed(jobs: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write a table of the session's catalog with rows of a file in one bucket, and give it.

    The latest job of each file, and joins with the jobs on ``file_key``, then need no shuffle of the jobs.  A bucket is read by
    one task: keep a registry in which one file has a large share of all jobs in plain Parquet (``save_jobs``), which
    adaptive execution can split.
    """
    writer = align_jobs(jobs).write.mode("errorifexists").format("parquet").bucketBy(buckets, "file_key").sortBy("file_key")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return align_jobs(jobs.sparkSession.table(table))
