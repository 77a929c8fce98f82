"""Extraction results lying as objects: Markdown, layout JSON, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import fmt, paths, text
from folioflow.session import materialise
from folioflow.sources.objects import fetch_objects, list_objects, put_objects
from folioflow.sources.objectstore import objects


#: Tasks among which the keys of a scan are dealt, per core.
READS_PER_CORE = 4


def pick_preferred(candidates: DataFrame, document: str, path: str, expected: Column) -> DataFrame:
    """One candidate per document: the expected path if it is there, else the first path.

    The rank filter is applied in every map task before the shuffle, so a document with very many
    candidates sends one row per task.
    """
    order = Window.partitionBy(document).orderBy(expected.desc(), F.col(path).asc())
    return candidates.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def markdown(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``target_key, md, error`` of the Markdown objects below the prefix; only those are read.

    A flat folder is listed by one task, so the keys, not the bytes, are dealt out anew before the objects are read.
    """
    keys = objects(spark, root).where(F.col("key").endswith(".md"))
    keys = keys.where(F.col("key").startswith(prefix)) if prefix else keys
    docs = fetch_objects(keys, root, tasks=READS_PER_CORE * spark.sparkContext.defaultParallelism)
    md = text.decode_utf8("content")
    error = F.when(md.isNull(), F.coalesce("fetch_error", F.lit("not UTF-8")))
    return docs.select(F.col("key").alias("target_key"), md.alias("md"), error.alias("error"))


def _work_objects(spark: SparkSession, root: str, work: DataFrame) -> DataFrame:
    """All objects below the given work folders, listed inside tasks, once; ``folder`` is the first component."""
    listed = materialise(list_objects(spark, root, work.select("folder")), "listing")
    return listed.withColumn("folder", F.substring_index("key", "/", 1))


def _picked(spark: SparkSession, root: str, work: DataFrame, ending: str) -> DataFrame:
    """Choose among the objects with an ending below each work folder, by listing only.

    The expected object is ``{d}/{d}/{d}{ending}``.
    """
    found = _work_objects(spark, root, work).where(F.col("key").endswith(ending))
    folder = F.col("folder")
    expected = F.col("key") == F.concat(folder, F.lit("/"), folder, F.lit("/"), folder, F.lit(ending))
    return pick_preferred(found, "folder", "key", expected).select("folder", "key", "size")


def work_markdown(spark: SparkSession, root: str, work: DataFrame) -> DataFrame:
    """Markdown per work folder in ``work(folder)``; ``error`` where there is none, or why it could not be read."""
    docs = fetch_objects(_picked(spark, root, work, ".md"), root)
    decoded = text.decode_utf8("content")
    broken = F.when(F.col("content").isNotNull() & decoded.isNull(), F.concat(F.lit("not UTF-8: "), F.col("key")))
    md = docs.select("folder", decoded.alias("md"), F.coalesce("fetch_error", broken).alias("problem"))
    missing = F.concat(F.lit("no Markdown output below "), F.col("folder"))
    joined = work.join(md, "folder", "left")
    return joined.select("folder", "md", F.when(F.col("md").isNull(), F.coalesce("problem", missing)).alias("error"))


def work_page_counts(spark: SparkSession, root: str, work: DataFrame) -> DataFrame:
    """Page count per work folder: 0 where the layout is absent or broken, NULL and ``error`` where it could not be read."""
    docs = fetch_objects(_picked(spark, root, work, "_middle.json"), root)
    counts = docs.select("folder", fmt.page_count(text.decode_utf8_lossy("content")).alias("pages"), F.col("fetch_error").alias("error"))
    joined = work.join(counts, "folder", "left")
    return joined.select("folder", F.when(F.col("error").isNull(), F.coalesce("pages", F.lit(0))).alias("page_count"), "error")


def work_images(spark: SparkSession, root: str, work: DataFrame) -> DataFrame:
    """Images per work folder: those of the expected ``images`` folder, else of the first found."""
    home = F.left("key", F.length("key") - F.length(paths.file_name("key")) - 1)
    images = _work_objects(spark, root, work).withColumn("home", home).where(F.col("home").endswith("/images"))
    homes = images.select("folder", "home").distinct()
    expected = F.col("home") == F.concat("folder", F.lit("/"), "folder", F.lit("/images"))
    chosen = pick_preferred(homes, "folder", "home", expected)
    return images.join(chosen, ["folder", "home"], "left_semi").select(
        "folder", paths.file_name("key").alias("name"), "key", "size"
    )


def images_below(files: DataFrame, target_key: str = "target_key") -> DataFrame:
    """Image objects with every prefix under which a listing would find them."""
    return files.select("key", "size", F.explode(paths.image_roots("key")).alias("images_prefix"))


def explode_images(artifacts: DataFrame) -> DataFrame:
    """One row per image of each result, in name order, with its object key and content type."""
    ordered = F.array_sort("images", lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return artifacts.select("target_key", F.posexplode(ordered).alias("position", "image")).select(
        "target_key",
        "position",
        paths.image_key(paths.artifact_prefix("target_key"), F.col("image.name")).alias("key"),
        paths.content_type(F.col("image.name")).alias("content_type"),
        F.col("image.content").alias("content"),
    )


def write_markdown_objects(artifacts: DataFrame, root: str, **tries) -> DataFrame:
    """Results as one object per document; see :func:`put_objects`."""
    return put_objects(artifacts, root, "target_key", "md", F.lit("text/markdown; charset=utf-8"), **tries)


def write_image_objects(artifacts: DataFrame, root: str, **tries) -> DataFrame:
    """All images of all results as objects; a failed image is a row with its error."""
    return put_objects(explode_images(artifacts), root, "key", "content", F.col("content_type"), **tries)
