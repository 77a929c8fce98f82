"""The job registry as a table: every operator returns the new table, none changes one in place."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import fmt
from folioflow.schemas import UNFINISHED, UPDATABLE, align_jobs

#: A running job older than this counts as stuck.
MAX_HOURS = 2.0


def clock(jobs: DataFrame, at: datetime | str | Column) -> Column:
    """A point in time in the timestamp flavour the table uses.  All clocks are parameters."""
    at = at if isinstance(at, Column) else F.lit(str(at))
    return at.cast(jobs.schema["submitted_at"].dataType)


# ---- reading -------------------------------------------------------------------------------


def latest_per_key(jobs: DataFrame, key: str = "file_key") -> DataFrame:
    """The job submitted last for each key; equal times go to the greater job id.

    An aggregate rather than a window: each map task first reduces its rows to one per key, so a
    key holding a large share of all jobs costs one row per task in the shuffle.
    """
    rest = [c for c in jobs.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct("submitted_at", "job_id"))
    return jobs.groupBy(key).agg(last.alias("_last")).select(*[F.col(c if c == key else f"_last.{c}") for c in jobs.columns])


def latest_for_keys(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Latest job of the given keys only."""
    return latest_per_key(with_keys(jobs, keys))


def with_keys(jobs: DataFrame, keys: DataFrame, key: str = "file_key") -> DataFrame:
    """Jobs whose key is among ``keys``: a semi join in place of a long IN list."""
    return jobs.join(apart(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key), key, "left_semi")


def get_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("submitted_at"), F.desc("job_id"))


def recent(jobs: DataFrame, n: int, *columns: str) -> DataFrame:
    """The ``n`` jobs submitted last; planned as one top-k per task and a merge of those."""
    return newest_first(jobs).limit(n).select(*(columns or jobs.columns))


def with_status(jobs: DataFrame, *statuses: str) -> DataFrame:
    return jobs.where(F.col("status").isin(*statuses))


def unfinished(jobs: DataFrame) -> DataFrame:
    """Pending and running jobs, oldest first."""
    return with_status(jobs, *UNFINISHED).orderBy("submitted_at", "job_id")


def has_result(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.nullif("target_key", F.lit("")).isNotNull())


def last_submissions(jobs: DataFrame, key: str = "file_key") -> DataFrame:
    """``last_submitted`` of each key."""
    return jobs.groupBy(key).agg(F.max("submitted_at").alias("last_submitted"))


def keys_in(jobs: DataFrame, *statuses: str) -> DataFrame:
    """Distinct keys with a job in one of the states (any state if none is named).

    Made distinct before it meets another table: one row per key and map task is shuffled, and the
    join behind it never sees the copies of a frequent key.
    """
    chosen = with_status(jobs, *statuses) if statuses else jobs
    return chosen.select("file_key").distinct()


def apart(keys: DataFrame, key: str) -> DataFrame:
    """Hide that ``keys`` is already partitioned by ``key``, for a join with a side full of copies.

    A join that reuses the partitioning of an aggregate has no shuffle of its own on that side, and
    adaptive execution then leaves a hot partition of the other side whole.  One more shuffle of
    the distinct keys lets it be split.
    """
    return keys.withColumn(key, F.concat(F.col(key), F.lit("")))


def conflicts(keys: DataFrame, jobs: DataFrame, *statuses: str) -> DataFrame:
    """The given keys that already have a job in a conflicting state (default: running)."""
    busy = apart(keys_in(jobs, *(statuses or ("running",))), "file_key")
    return keys.join(busy, "file_key", "left_semi")


def with_options(jobs: DataFrame, lang: str, arabic_bidi_fix: str, backend: str) -> DataFrame:
    """Job options with the configured defaults filled in."""
    return jobs.withColumns(
        {
            "lang": fmt.or_default("lang", lang),
            "arabic_bidi_fix": fmt.or_default("arabic_bidi_fix", arabic_bidi_fix),
            "backend": fmt.or_default("backend", backend),
        }
    )


# ---- insert --------------------------------------------------------------------------------


def new_jobs(rows: DataFrame) -> DataFrame:
    """Fresh pending jobs from ``job_id, file_key, file_size, submitted_at`` and optional options."""
    given = [c for c in ("lang", "arabic_bidi_fix", "backend") if c in rows.columns]
    return align_jobs(rows.select("job_id", "file_key", "file_size", "submitted_at", *given))


def duplicate_ids(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids of ``rows`` that exist already or occur more than once."""
    known = jobs.select("job_id").join(rows.select("job_id").distinct(), "job_id", "left_semi")
    repeated = rows.groupBy("job_id").count().where("count > 1").select("job_id")
    return known.union(repeated).distinct()


def insert(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Append pending jobs.  A duplicate id fails the query, as a primary key would."""
    fresh = new_jobs(rows)
    clash = duplicate_ids(jobs, rows).withColumn("_clash", F.lit(True))
    # As a filter, which no projection or count over the result prunes away.
    refused = F.raise_error(F.concat(F.lit("duplicate job_id: "), F.col("job_id"))).cast("boolean")
    checked = fresh.join(clash, "job_id", "left").where(F.when(F.col("_clash"), refused).otherwise(F.lit(True)))
    return jobs.unionByName(checked.drop("_clash"), allowMissingColumns=True)


def insert_new(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Append those of the pending jobs whose id is not yet in the table."""
    known = jobs.select("job_id").join(rows.select("job_id").distinct(), "job_id", "left_semi")
    return jobs.unionByName(new_jobs(rows).join(known, "job_id", "left_anti"), allowMissingColumns=True)


# ---- update --------------------------------------------------------------------------------


def update_fields(updates: DataFrame) -> list[str]:
    """The fields an update table sets: its columns on the whitelist; others are ignored."""
    return [c for c in UPDATABLE if c in updates.columns]


def fold_updates(updates: DataFrame, order: str) -> DataFrame:
    """Several updates per job to one: per field, the value set last.

    A field counts as set where ``set_<field>`` is true; without such a column, always.  The value
    is kept inside a struct so that an explicit NULL survives.
    """
    folded = []
    for name in update_fields(updates):
        flag = F.coalesce(F.col(f"set_{name}"), F.lit(False)) if f"set_{name}" in updates.columns else F.lit(True)
        last = F.max_by(F.struct(name), F.when(flag, F.col(order)))
        folded += [last.alias(f"_{name}")]
    out = updates.groupBy("job_id").agg(*folded)
    names = update_fields(updates)
    return out.select(
        "job_id",
        *[F.col(f"_{n}.{n}").alias(n) for n in names],
        *[F.col(f"_{n}").isNotNull().alias(f"set_{n}") for n in names],
    )


def apply_updates(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Overlay one update row per job; several rows of a job fail the query.  An explicit NULL is written, not skipped."""
    names = update_fields(updates)
    if not names:
        return jobs
    rest = [c for c in updates.columns if c != "job_id"]
    one = updates.groupBy("job_id").agg(F.count("*").alias("_rows"), *[F.first(F.struct(c)).alias(f"_one_{c}") for c in rest])
    refused = F.raise_error(F.concat(F.lit("several updates of job_id: "), F.col("job_id"))).cast("boolean")
    one = one.where(F.when(F.col("_rows") > 1, refused).otherwise(F.lit(True)))
    return _overlay(jobs, one.select("job_id", *[F.col(f"_one_{c}.{c}").alias(c) for c in rest]))


def _overlay(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """``jobs`` with update rows whose ``job_id`` is known to be unique."""
    names = update_fields(updates)
    if not names:
        return jobs
    flags = {n: F.col(f"set_{n}") if f"set_{n}" in updates.columns else F.lit(True) for n in names}
    patch = updates.select(
        "job_id",
        *[F.col(n).alias(f"_new_{n}") for n in names],
        *[F.coalesce(flags[n], F.lit(False)).alias(f"_set_{n}") for n in names],
    )
    joined = jobs.join(patch, "job_id", "left")
    kinds = {f.name: f.dataType for f in jobs.schema.fields}
    return joined.select(
        *[
            F.when(F.col(f"_set_{c}"), F.col(f"_new_{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
            for c in jobs.columns
        ]
    )


def update(jobs: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """Apply any number of updates per job in the given order."""
    return _overlay(jobs, fold_updates(updates, order))


# ---- delete --------------------------------------------------------------------------------


def delete(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select(F.col(ids.columns[0]).alias("job_id")).distinct(), "job_id", "left_anti")


def deleted_count(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """How many rows a delete would really remove."""
    gone = jobs.join(ids.select(F.col(ids.columns[0]).alias("job_id")).distinct(), "job_id", "left_semi")
    return gone.agg(F.count("*").alias("deleted"))


# ---- sweep and recovery --------------------------------------------------------------------

# The messages of a swept job.
NEVER_STARTED = "Task stuck: no started_at timestamp"
TOO_LONG = "Task stuck for more than {} hours, automatically marked as failed"


def stuck_reason(jobs: DataFrame, as_of: datetime | str | Column, max_hours: float = MAX_HOURS) -> Column:
    """Why a running job counts as stuck, else NULL: never started, or running for too long.

    The comparison is strict, on whole microseconds.
    """
    running = F.col("status") == "running"
    age = fmt.micros(clock(jobs, as_of)) - fmt.micros("started_at")
    return F.when(running & F.col("started_at").isNull(), F.lit(NEVER_STARTED)).when(
        running & (age > F.lit(round(max_hours * 3_600_000_000))),
        F.lit(TOO_LONG.format(max_hours)),
    )


def stuck_updates(jobs: DataFrame, as_of: datetime | str | Column, max_hours: float = MAX_HOURS) -> DataFrame:
    """The sweep as update rows, for a registry kept as a log."""
    reason = stuck_reason(jobs, as_of, max_hours)
    return jobs.select(
        "job_id", F.lit("failed").alias("status"), reason.alias("error"), clock(jobs, as_of).alias("completed_at")
    ).where(F.col("error").isNotNull())


def first_stuck(jobs: DataFrame, ticks: DataFrame, max_hours: float = MAX_HOURS) -> DataFrame:
    """Update rows of the jobs that are stuck at one of the ``ticks``, as of the first such tick.

    ``ticks`` is one row with a sorted array of the table's own timestamp flavour.
    """
    running = jobs.where("status = 'running'").join(F.broadcast(ticks), F.size("ticks") > 0)
    least = F.lit(round(max_hours * 3_600_000_000))
    began = fmt.micros("started_at")
    late = F.filter("ticks", lambda t: F.col("started_at").isNull() | (fmt.micros(t) - began > least))
    reason = F.when(F.col("started_at").isNull(), F.lit(NEVER_STARTED)).otherwise(F.lit(TOO_LONG.format(max_hours)))
    found = running.select("job_id", F.lit("failed").alias("status"), reason.alias("error"), F.get(late, 0).alias("completed_at"))
    return found.where("completed_at is not null")


def sweep(jobs: DataFrame, as_of: datetime | str | Column, max_hours: float = MAX_HOURS) -> DataFrame:
    """The table after the sweep: one pass over the rows, no join and no shuffle."""
    reason = stuck_reason(jobs, as_of, max_hours)
    marked = jobs.withColumn("_reason", reason)
    stuck = F.col("_reason").isNotNull()
    return marked.withColumns(
        {
            "status": F.when(stuck, F.lit("failed")).otherwise(F.col("status")),
            "error": F.when(stuck, F.col("_reason")).otherwise(F.col("error")),
            "completed_at": F.when(stuck, clock(jobs, as_of)).otherwise(F.col("completed_at")),
        }
    ).drop("_reason")


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart: running jobs are pending again, all else stays."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def recovery_queue(jobs: DataFrame) -> DataFrame:
    """The jobs to run again after a restart, oldest first."""
    return unfinished(recover(jobs))
