"""Batch runs over a catalog and runs over pending jobs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import fmt, paths, text
from folioflow.operators import registry
from folioflow.operators.extraction import Extractor, extract
from folioflow.plans import report
from folioflow.plans.submission import Defaults
from folioflow.session import materialise
from folioflow.sources import artifacts as stored


@dataclass(frozen=True)
class BatchOutcome:
    results: DataFrame
    finished: DataFrame

    @property
    def summary(self) -> DataFrame:
        return report.summary(self.results)

    @property
    def artifacts(self) -> DataFrame:
        return artifacts_of(self.finished, overwritten(self.finished), "key")

    def delivered(self, root: str, **tries) -> BatchOutcome:
        """Write the artifacts below ``root``: a document whose Markdown cannot be written has failed, its page count stays.

        A failed image does not fail its document.  The outcome of the writes is kept once.
        """
        failed = deliver(self.artifacts, root, **tries)
        finished = self.finished.join(failed, "target_key", "left")
        told = failed_writes(F.col("status") == "success")
        return BatchOutcome(results_of(finished.withColumns(told)), finished.withColumns(told).drop("write_error"))


def finish(
    extracted: DataFrame, source_prefix: str, target_prefix: str, mode: Column | str = "auto", reorder=None
) -> DataFrame:
    """From raw outcomes to finished ones: page count, target key, and the Arabic chain by language."""
    good = F.col("status") == "success"
    lang = F.col("lang") if "lang" in extracted.columns else F.lit(None).cast("string")
    return extracted.withColumns(
        {
            "md": text.arabic_chain("md", lang, mode, reorder),
            "page_count": F.when(good, fmt.page_count("layout_json")).otherwise(F.lit(0)),
            "target_key": F.when(good, paths.target_key("key", source_prefix, target_prefix)),
        }
    )


def artifacts_of(finished: DataFrame, lost: DataFrame, on: str | list[str]) -> DataFrame:
    """Results to be kept: one per target key, as later results overwrite earlier ones.

    The keys of the others are written first, so that Spark knows their size and moves the keys rather than the results
    where they are few.
    """
    good = finished.where(F.col("status") == "success").join(materialise(lost, "lost"), on, "left_anti")
    return good.select("key", "target_key", "md", "page_count", "images")


def deliver(artifacts: DataFrame, root: str, **tries) -> DataFrame:
    """Write Markdown and images; ``target_key, write_error`` of the results whose Markdown could not be written."""
    images = stored.write_image_objects(artifacts, root, **tries)
    written = stored.write_markdown_objects(artifacts, root, **tries)
    outcome = materialise(written.withColumn("kind", F.lit("md")).union(images.withColumn("kind", F.lit("image"))), "written")
    bad = outcome.where("kind = 'md' and error is not null")
    return bad.select(F.col("key").alias("target_key"), F.concat(F.lit("cannot write "), "key", F.lit(": "), "error").alias("write_error"))


def failed_writes(good: Column) -> dict[str, Column]:
    lost = good & F.col("write_error").isNotNull()
    return {
        "error": F.when(lost, F.col("write_error")).otherwise(F.col("error")),
        "status": F.when(lost, F.lit("failed")).otherwise(F.col("status")),
    }


def overwritten(finished: DataFrame) -> DataFrame:
    """Keys of results that a later key of the same target overwrites; keys are listed in order."""
    good = finished.where(F.col("status") == "success").select("key", "target_key")
    shared = good.groupBy("target_key").agg(F.max("key").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    return good.join(registry.apart(shared, "target_key"), "target_key").where(F.col("key") != F.col("_last")).select("key")


def results_of(finished: DataFrame, *extra: str) -> DataFrame:
    return finished.select(
        F.col("key").alias("file_key"), F.col("size").alias("file_size"), "page_count", "duration_us", "status", "error", *extra
    )


def run_batch(
    docs: DataFrame,
    extractor: Extractor,
    source_prefix: str = "",
    target_prefix: str = "",
    defaults: Defaults | None = None,
    reorder=None,
    root: str | None = None,
    tasks: int | None = None,
) -> BatchOutcome:
    """Extract a whole catalog.  The outcome is written once; results, artifacts and summary read it.

    A document that fails or is not supported is a row in ``results`` and never stops the others.
    """
    if defaults is not None:
        docs = docs.withColumns({"lang": F.lit(defaults.lang), "backend": F.lit(defaults.backend)})
    mode = defaults.arabic_bidi_fix if defaults is not None else "auto"
    finished = finish(extract(docs, extractor, root, tasks), source_prefix, target_prefix, mode, reorder)
    finished = materialise(finished, "batch")
    return BatchOutcome(results_of(finished), finished)


#: What makes the work of two jobs equal.
UNIT = ["key", "lang", "arabic_bidi_fix", "backend"]


@dataclass(frozen=True)
class JobRun:
    updates: DataFrame
    finished: DataFrame
    lost: DataFrame

    @property
    def artifacts(self) -> DataFrame:
        return artifacts_of(self.finished, self.lost, UNIT)

    def delivered(self, root: str, **tries) -> DataFrame:
        """Write the artifacts below ``root`` and give the update rows: a job whose Markdown cannot be written has failed.

        A job whose result another one overwrites shares the outcome of that write.
        """
        failed = deliver(self.artifacts, root, **tries)
        joined = self.updates.join(failed, "target_key", "left")
        lost = F.col("write_error").isNotNull() & (F.col("status") == "success")
        told = failed_writes(F.col("status") == "success") | {"set_error": F.col("set_error") | lost, "set_target_key": F.col("set_target_key") & ~lost}
        return joined.withColumns(told).select(*self.updates.columns)


def run_pending(
    jobs: DataFrame,
    docs: DataFrame,
    extractor: Extractor,
    started_at: datetime | str | Column,
    completed_at: datetime | str | Column,
    defaults: Defaults,
    source_prefix: str = "",
    target_prefix: str = "",
    reorder=None,
    root: str | None = None,
    tasks: int | None = None,
) -> JobRun:
    """Run every pending job and give its final state as update rows, plus the artifacts.

    ``docs`` is the catalog ``(key, size[, content])``.  With ``root`` only the documents of
    pending jobs are read.  A pending job without its document fails like an extractor error.

    Jobs with the same file and options ask for the same work, which is done once; a file with a
    large share of all jobs costs one extraction per set of options.  Of several results for one
    target the job submitted last gives the one to keep.
    """
    pending = registry.with_options(registry.with_status(jobs, "pending"), *defaults)
    asked = pending.select("job_id", "submitted_at", F.col("file_key").alias("key"), "lang", "arabic_bidi_fix", "backend")
    # Written first, so that Spark knows their size: few units go to the documents, and no bytes move.
    units = materialise(asked.select(*UNIT).distinct(), "units")
    work = units.join(docs if root is None else docs.select("key", "size"), "key")
    finished = finish(extract(work, extractor, root, tasks), source_prefix, target_prefix, F.col("arabic_bidi_fix"), reorder)
    finished = materialise(finished, "jobs")
    missing = units.join(docs.select("key"), "key", "left_anti").select(
        *UNIT, F.lit("failed").alias("status"), F.concat(F.lit("no such document: "), F.col("key")).alias("error")
    )
    outcome = finished.select(*UNIT, "status", "error", "page_count", "target_key").unionByName(missing, allowMissingColumns=True)
    done = asked.join(outcome, UNIT)
    good = F.col("status") == "success"
    updates = done.select(
        "job_id",
        "status",
        registry.clock(jobs, started_at).alias("started_at"),
        registry.clock(jobs, completed_at).alias("completed_at"),
        "error",
        (~good).alias("set_error"),
        "page_count",
        good.alias("set_page_count"),
        "target_key",
        good.alias("set_target_key"),
    )
    last = F.max_by(F.struct(*UNIT), F.struct("submitted_at", "job_id"))
    won = done.where(good).groupBy("target_key").agg(last.alias("_won")).select("_won.*")
    lost = finished.where(good).select(*UNIT).join(won, UNIT, "left_anti")
    return JobRun(updates, finished, lost)
