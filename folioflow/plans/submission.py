"""Submitting files for extraction."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import fmt, paths
from folioflow.operators import registry


class Defaults(NamedTuple):
    lang: str
    arabic_bidi_fix: str
    backend: str


def decide(
    requests: DataFrame,
    files: DataFrame,
    jobs: DataFrame,
    at: datetime | str | Column,
    defaults: Defaults,
    conflict_states: tuple[str, ...] = ("running",),
) -> DataFrame:
    """Judge each request ``(request_id, file_key[, lang, arabic_bidi_fix, backend])``.

    Joins in place of per-key lookups: what is known about each key is put together first, one row
    per key, and the requests, of which many may name one key, are shuffled for a single join.
    ``code`` is 202, 400 (format) or 409 (a job is running); accepted rows carry all that a new job
    needs.
    """
    busy = registry.keys_in(jobs, *conflict_states).withColumn("_busy", F.lit(True))
    known = files.select(F.col("key").alias("file_key"), "size").join(busy, "file_key", "full")
    judged = requests.join(known, "file_key", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    ok, free = paths.is_supported("file_key"), F.col("_busy").isNull()
    code = F.when(~ok, 400).when(~free, 409).otherwise(202)
    # The two messages.
    reason = F.when(~ok, F.concat(F.lit("Unsupported format: "), paths.suffix("file_key"))).when(
        ~free, F.concat(F.lit("Job already running for: "), F.col("file_key"))
    )
    when = registry.clock(jobs, at)

    def option(name: str) -> Column:
        given = F.col(name) if name in requests.columns else F.lit(None).cast("string")
        return fmt.or_default(given, getattr(defaults, name)).alias(name)

    accepted = code == 202
    return judged.select(
        "request_id",
        "file_key",
        accepted.alias("accepted"),
        code.alias("code"),
        reason.alias("reason"),
        F.when(accepted, paths.job_id("file_key", when.cast("string"), F.col("request_id"))).alias("job_id"),
        F.when(accepted, F.col("size")).alias("file_size"),
        when.alias("submitted_at"),
        *[option(name) for name in Defaults._fields],
    )


def accepted_jobs(decisions: DataFrame, strict: bool = False) -> DataFrame:
    """New pending jobs of the accepted requests; ``strict`` gives none if any request was refused."""
    chosen = decisions.where("accepted")
    if strict:
        chosen = chosen.where(~decisions.where("not accepted").select("code").exists())
    return registry.new_jobs(chosen)


def refused(decisions: DataFrame) -> DataFrame:
    return decisions.where("not accepted").select("request_id", "file_key", "code", "reason")


def created_count(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count_if("accepted").alias("created"), F.count_if(~F.col("accepted")).alias("rejected"), F.count("*").alias("requested")
    )
