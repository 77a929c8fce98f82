"""Catalog joined with registry, and the listing views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import fmt, paths, text
from folioflow.operators import registry
from folioflow.schemas import PUBLIC_FIELDS, TERMINAL


def file_listing(files: DataFrame, jobs: DataFrame, show_all: bool = False) -> DataFrame:
    """Each file with its latest job's state; without ``show_all`` only files never submitted."""
    if not show_all:
        none = F.lit(None).cast("string")
        return unsubmitted(files, jobs).select("key", "size", none.alias("job_status"), none.alias("job_id"))
    latest = registry.latest_per_key(jobs.select("file_key", "submitted_at", "job_id", "status"))
    return files.join(latest, files["key"] == latest["file_key"], "left").select(
        "key", "size", F.col("status").alias("job_status"), "job_id"
    )


def unsubmitted(files: DataFrame, jobs: DataFrame) -> DataFrame:
    submitted = registry.keys_in(jobs)
    return files.join(submitted, files["key"] == submitted["file_key"], "left_anti")


def file_sizes(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog size of each key, 0 where the catalog has none."""
    return keys.join(files.select(F.col("key").alias("file_key"), "size"), "file_key", "left").withColumn(
        "size", F.coalesce("size", F.lit(0))
    )


def public_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select(*PUBLIC_FIELDS)


def job_list(jobs: DataFrame, zone: str = "UTC", with_backend: bool = False) -> DataFrame:
    """The job list with its display columns, newest first.

    Errors are cut before the sort and the display texts made after it, so that neither travels.
    """
    extra = ["backend"] if with_backend else []
    public = jobs.select(*PUBLIC_FIELDS, *extra).withColumn("error", fmt.short_error("error"))
    return registry.newest_first(public).select(
        *PUBLIC_FIELDS,
        *extra,
        fmt.status_label("status").alias("status_label"),
        fmt.listing_date("submitted_at", zone).alias("submitted_text"),
        fmt.listing_date("completed_at", zone).alias("completed_text"),
        fmt.listing_duration("started_at", "completed_at").alias("duration_text"),
        fmt.listing_size("file_size").alias("size_text"),
        fmt.or_dash("page_count").alias("pages_text"),
        fmt.or_dash("error").alias("error_text"),
        (F.col("status") == "success").alias("comparable"),
        F.col("status").isin(*TERMINAL).alias("terminal"),
    )


def linked_results(artifacts: DataFrame, location: str = "") -> DataFrame:
    """Results with their image links pointing below ``location``.

    Done per result and before any join: a result shared by many jobs is rewritten once.
    """
    prefix = F.concat(F.lit(location), paths.artifact_prefix("target_key"))
    return artifacts.select("target_key", text.rewrite_image_links("md", prefix).alias("md"))


def result_view(jobs: DataFrame, artifacts: DataFrame, location: str = "") -> DataFrame:
    """Markdown of every job that has a result, with rewritten links."""
    done = registry.has_result(jobs).select("job_id", "file_key", "target_key")
    return done.join(linked_results(artifacts, location), "target_key").select("job_id", "file_key", "target_key", "md")


def comparison(jobs: DataFrame, files: DataFrame, artifacts: DataFrame, source: str = "", target: str = "") -> DataFrame:
    """Source and result side by side, one row per successful job; either side may be NULL."""
    done = registry.with_status(jobs, "success").select("job_id", "file_key", "target_key")
    sources = files.select(F.col("key").alias("file_key"), F.concat(F.lit(source), F.col("key")).alias("source_url"))
    results = linked_results(artifacts, target)
    return (
        done.join(sources, "file_key", "left")
        .join(results, "target_key", "left")
        .select(
            "job_id",
            F.col("file_key").alias("title"),
            "source_url",
            F.when(F.col("source_url").isNotNull(), fmt.source_kind("source_url")).alias("source_kind"),
            F.col("md").alias("result_md"),
        )
    )
