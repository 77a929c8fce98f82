"""The file catalog: which documents lie below a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import paths
from folioflow.sources.objects import put_objects
from folioflow.sources.objectstore import objects


def all_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``key, size`` of everything below ``root`` whose key starts with ``prefix``; no name is left out.

    Nothing is listed before an action, and then only the folder that can hold the prefix (see :mod:`.objectstore`).  The listing
    is made anew by each action; :func:`folioflow.session.materialise` keeps one.
    """
    files = objects(spark, root)
    return files.where(F.col("key").startswith(prefix)) if prefix else files


def supported(files: DataFrame) -> DataFrame:
    return files.where(paths.is_supported("key"))


def list_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Catalog of supported documents."""
    return supported(all_files(spark, root, prefix))


def documents(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``key, size, content`` of everything below the prefix; an object that cannot be read fails the query.

    To isolate unreadable documents, extract by key: ``extract(list_files(...), extractor, root)``.
    """
    found = objects(spark, root, content=True)
    found = found.where(F.col("key").startswith(prefix)) if prefix else found
    reason = F.concat(F.lit("cannot read "), F.col("key"), F.lit(": "), F.col("fetch_error"))
    content = F.when(F.col("fetch_error").isNotNull(), F.raise_error(reason).cast("binary")).otherwise(F.col("content"))
    return found.select("key", "size", content.alias("content"))


def split_supported(files: DataFrame) -> DataFrame:
    """Route unsupported files: they stay, as ``skipped`` rows with the reason."""
    ok = paths.is_supported("key")
    return files.select(
        "*",
        F.when(~ok, F.lit("skipped")).alias("status"),
        F.when(~ok, F.lit(0)).alias("page_count"),
        F.when(~ok, F.concat(F.lit("Unsupported format: "), paths.suffix("key"))).alias("error"),
    )


def ingest(uploads: DataFrame, source_prefix: str = "") -> DataFrame:
    """Uploads (``name, size``) to catalog keys, with the reason where the format is refused."""
    ok = paths.is_supported("name")
    return uploads.select(
        "name",
        F.when(ok, paths.ingest_key("name", source_prefix)).alias("key"),
        F.when(ok, F.col("size")).alias("size"),
        ok.alias("accepted"),
        F.when(~ok, F.concat(F.lit("Unsupported format: "), paths.suffix("name"))).alias("reason"),
    )


def store_uploads(uploads: DataFrame, root: str, source_prefix: str = "", **tries) -> DataFrame:
    """Store accepted uploads (``name, content``) at their catalog keys: ``name, key, size, error`` of every upload.

    ``size`` is that of the bytes written; a refused upload has its reason, one that could not be written the store's.
    """
    ok = paths.is_supported("name")
    taken = uploads.where(ok).select(paths.ingest_key("name", source_prefix).alias("key"), "content")
    written = put_objects(taken, root, content_type=paths.content_type("key"), **tries)
    size = F.when(F.col("error").isNull(), F.col("size")).alias("size")
    refused = uploads.where(~ok).select(
        "name",
        F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("long").alias("size"),
        F.concat(F.lit("Unsupported format: "), paths.suffix("name")).alias("error"),
    )
    return written.select(paths.file_name("key").alias("name"), "key", size, "error").unionByName(refused)


def target_collisions(files: DataFrame, source_prefix: str = "", target_prefix: str = "") -> DataFrame:
    """Targets that several sources would share, with their number and first and last source."""
    keyed = files.select("key", paths.target_key("key", source_prefix, target_prefix).alias("target_key"))
    return (
        keyed.groupBy("target_key")
        .agg(F.count("*").alias("sources"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
        .where(F.col("sources") > 1)
    )
