"""Bundle manifests: which objects belong into a download of given jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import paths
from folioflow.operators import registry
from folioflow.sources.artifacts import images_below


def job_images(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Image objects of each job: those a listing below ``<target without .md>/images/`` finds."""
    wanted = registry.has_result(jobs).select(
        "job_id", "file_key", F.concat(paths.artifact_prefix("target_key"), F.lit("/images/")).alias("images_prefix")
    )
    return wanted.join(images_below(results), "images_prefix").select("job_id", "file_key", F.col("key").alias("image_key"))


def manifest(requested: DataFrame, jobs: DataFrame, sources: DataFrame, results: DataFrame) -> DataFrame:
    """``job_id, part, arcname, source_key`` of all parts that exist.

    ``requested(job_id)`` names the jobs; ``sources`` and ``results`` are the two catalogs
    ``(key, size)``.  Unknown jobs and absent parts are left out without notice.
    """
    chosen = requested.select("job_id").join(jobs.select("job_id", "file_key", "target_key"), "job_id")
    folder = paths.bundle_folder("file_key")

    def part(rows: DataFrame, kind: str, key: str, inner: str) -> DataFrame:
        arcname = F.concat(folder, F.lit(inner), paths.file_name(key))
        return rows.select("job_id", F.lit(kind).alias("part"), arcname.alias("arcname"), F.col(key).alias("source_key"))

    originals = chosen.join(sources.select(F.col("key").alias("file_key")), "file_key")
    markdown = registry.has_result(chosen).join(results.select(F.col("key").alias("target_key")), "target_key")
    images = job_images(chosen, results)
    return (
        part(originals, "original", "file_key", "/")
        .unionByName(part(markdown, "markdown", "target_key", "/"))
        .unionByName(part(images, "image", "image_key", "/images/"))
    )
