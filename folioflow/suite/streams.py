"""Streaming queries, each run to the end of its input; the final table equals the batch result."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import registry
from folioflow.suite import derived
from folioflow.suite.derived import AS_OF, sql_with
from folioflow.session import materialise, new_path
from folioflow.sources.objects import put_objects
from folioflow.streaming import stateful, streams
from folioflow.suite import query
from folioflow.suite.catalog import SUPPORTED_SQL
from folioflow.suite.registry import COLUMNS

STATUS = {"signup": "pending", "view": "running", "purchase": "success", "error": "failed", "click": "skipped"}
STATUS_SQL = "case event_type when 'signup' then 'pending' when 'view' then 'running' when 'purchase' then 'success' when 'error' then 'failed' else 'skipped' end"


def _event_stream(spark, sf_dir):
    """The events as a stream, with a zoned clock as watermarks want it."""
    schema = derived.table(spark, sf_dir, "events").schema
    stream = streams.read_stream(spark, f"{sf_dir}/events.parquet*", schema)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def _collect(spark, stream):
    """Run a stream into a fresh table and give the table."""
    out = new_path(spark, "stream")
    streams.run_to_end(stream, out, new_path(spark, "progress"))
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "r1_file_discovery",
    sql_with("files", "jobs", body=f"select key as file_key, doc_id as file_size from files where {SUPPORTED_SQL} and key not in (select file_key from jobs)"),
)
def _(spark, sf_dir):
    """Three listings, between which files arrive; each file without a job is logged once.

    The files are as long as their numbers; they are written by their length alone, as only key and size are ever looked at.
    """
    root, log, ticks = new_path(spark, "incoming"), new_path(spark, "discovered"), new_path(spark, "ticks")
    progress = new_path(spark, "progress")
    files = derived.files(spark, sf_dir).select("doc_id", "key", F.greatest("doc_id", F.lit(0)).alias("body"))
    for step in range(3):
        put_objects(files.where(F.col("doc_id") % 3 == step), root, "key", "body").write.parquet(new_path(spark, "written"))
        at = F.to_timestamp_ntz(F.lit(f"{AS_OF[:11]}0{step}:00:00")).alias("at")
        spark.range(1).select(at).write.mode("append").parquet(ticks)
        stream = streams.read_stream(spark, ticks, spark.read.parquet(ticks).schema, files_per_batch=1)
        streams.discover_on_ticks(stream, root, lambda: derived.jobs(spark, sf_dir), log, progress)
    return spark.read.option("recursiveFileLookup", True).parquet(log).select("file_key", "file_size")


def _status_events(spark, sf_dir):
    """Status reports of one job per user."""
    labels = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return _event_stream(spark, sf_dir).select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), labels[F.col("event_type")].alias("status"), "at", "event_id"
    )


@query(
    "r2_watched_status",
    f"""select job_id, coalesce(arg_min(status, ts) filter (where terminal), arg_max(status, ts)) as status, bool_or(terminal) as terminal
      from (select concat('job-', user_id) as job_id, {STATUS_SQL} as status, ts,
        event_type in ('purchase', 'error', 'click') as terminal from events) group by job_id""",
)
def _(spark, sf_dir):
    return streams.watched_status(_collect(spark, _status_events(spark, sf_dir)), "at", "event_id")


@query(
    "r2_live_registry",
    sql_with(
        "files",
        body=f"""select doc_id, concat('job-', doc_id) as job_id, coalesce(s.status, 'pending') as status from files left join
          (select user_id, arg_max({STATUS_SQL}, ts) as status from events group by user_id) s on user_id = doc_id""",
    ),
)
def _(spark, sf_dir):
    base = derived.files(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("job-"), F.col("doc_id").cast("string")).alias("job_id"), F.lit("pending").alias("status")
    )
    return streams.current_jobs(base, _collect(spark, _status_events(spark, sf_dir)), "at")


TICKS_SQL = "select distinct cast(date_trunc('day', ts) as timestamp) as t from events"


@query(
    "r3_stuck_sweep",
    sql_with(
        "jobs",
        extra=f"""ticks as ({TICKS_SQL}),
          found as (select job_id, min(t) as tick, bool_or(started_at is null) as never from jobs, ticks
            where status = 'running' and (started_at is null or t > started_at + interval '2' hour) group by job_id)""",
        body="select "
        + ", ".join(
            {
                "status": "case when tick is not null then 'failed' else status end as status",
                "error": f"case when tick is null then error when never then '{registry.NEVER_STARTED}' else '{registry.TOO_LONG.format(2.0)}' end as error",
                "completed_at": "coalesce(tick, completed_at) as completed_at",
            }.get(c, f"jobs.{c}")
            for c in COLUMNS.split(", ")
        )
        + " from jobs left join found on found.job_id = jobs.job_id",
    ),
)
def _(spark, sf_dir):
    """One tick a day in four micro-batches; the first tick at which a job is stuck fails it."""
    jobs, log, path = derived.jobs(spark, sf_dir), new_path(spark, "sweeps"), new_path(spark, "ticks")
    # Ticks carry the clock of the job table, so no zone enters.
    days = derived.table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).distinct()
    days = materialise(days.withColumn("part", F.ntile(4).over(Window.orderBy("at"))), "days")
    for part in range(1, 5):
        days.where(F.col("part") == part).select("at").coalesce(1).write.mode("append").parquet(path)
    ticks = streams.read_stream(spark, path, days.select("at").schema, files_per_batch=1)
    streams.sweep_on_ticks(ticks, jobs, log, new_path(spark, "progress"))
    updates = spark.read.option("recursiveFileLookup", True).parquet(log)
    return registry.apply_updates(jobs, updates.drop("seq"))


def _in_order(spark, rows, parts, run):
    """Feed rows (clock ``at``) to a stream in time order: ``parts`` periods of one length, each a run over what is new."""
    source = new_path(spark, "source")
    clock = F.unix_micros("at")
    first, last = rows.agg(F.min(clock), F.max(clock)).first()
    length = (last - first) // parts + 1 if first is not None else 1
    for part in range(parts):
        own = F.floor((clock - F.lit(first)) / length) == part
        rows.where(own).write.mode("append").parquet(source)
        run(streams.read_stream(spark, source, rows.schema))


def _zoned_events(spark, sf_dir):
    return derived.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


GUARD_HOURS, SWEEP_HOURS = 12, 5


@query(
    "r4_submission_guard",
    f"""with recursive files as ({derived.FILES}),
      seen as (select key as file_key, ts, event_type = 'purchase' as ended,
        min(case when event_type = 'purchase' then ts end) over (partition by key order by ts rows between 1 following and unbounded following) as done
        from events join files on doc_id = user_id),
      requests as (select file_key, ts, least(ts + interval '{GUARD_HOURS}' hour, coalesce(done, ts + interval '{GUARD_HOURS}' hour)) as until from seen where not ended),
      next as (select a.file_key, a.ts, min(b.ts) as after from requests a join requests b on b.file_key = a.file_key and b.ts > a.ts and b.ts >= a.until group by a.file_key, a.ts),
      admitted as (select file_key, min(ts) as ts from requests group by file_key
        union all select next.file_key, next.after from admitted join next on next.file_key = admitted.file_key and next.ts = admitted.ts)
      select file_key, ts as at from admitted""",
)
def _(spark, sf_dir):
    """Every event but a purchase asks for a job of its user's file, a purchase ends it; three micro-batches."""
    keyed = _zoned_events(spark, sf_dir).join(derived.files(spark, sf_dir), F.col("user_id") == F.col("doc_id"))
    events = keyed.select(F.col("key").alias("file_key"), "at", (F.col("event_type") == "purchase").alias("ended"))
    out, progress = new_path(spark, "admitted"), new_path(spark, "progress")
    _in_order(spark, events, 3, lambda stream: stateful.run_states(stateful.guarded_until_done(stream, F.col("ended"), GUARD_HOURS), progress, out))
    return spark.read.parquet(out).select("file_key", F.col("at").cast("timestamp_ntz").alias("at"))


@query(
    "r3_timer_sweep",
    f"""select job_id, ts as started_at, ts + interval '{SWEEP_HOURS}' hour as failed_at from (select concat('job-', user_id) as job_id, event_type, ts,
        lead(ts) over (partition by user_id order by ts) as after, max(ts) over () as last from events)
      where event_type = 'view' and (after > ts + interval '{SWEEP_HOURS}' hour or (after is null and ts + interval '{SWEEP_HOURS}' hour < last))""",
)
def _(spark, sf_dir):
    """Jobs that say nothing for hours after they began to run, in three micro-batches."""
    labels = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    events = _zoned_events(spark, sf_dir).select(F.concat(F.lit("job-"), "user_id").alias("job_id"), labels[F.col("event_type")].alias("status"), "at")
    out, progress = new_path(spark, "swept"), new_path(spark, "progress")
    _in_order(spark, events, 3, lambda stream: stateful.run_states(stateful.sweep_by_timers(stream, SWEEP_HOURS), progress, out))
    return spark.read.parquet(out).select("job_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "failed_at")])


@query("r2_held_status", f"select concat('job-', user_id) as job_id, arg_max({STATUS_SQL}, ts) as status, max(ts) as at from events group by user_id")
def _(spark, sf_dir):
    """The last status of every job, read from the state of the stream that saw its reports."""
    labels = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    events = _zoned_events(spark, sf_dir)
    events = events.select(F.concat(F.lit("job-"), "user_id").alias("job_id"), labels[F.col("event_type")].alias("status"), "at", "event_id")
    progress = new_path(spark, "progress")
    _in_order(spark, events, 3, lambda stream: stateful.run_states(stateful.status_changes(stream, F.col("event_id")), progress, mode="update"))
    return stateful.held_status(spark, progress).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("r5_resume", "select event_id, concat('job-', user_id) as job_id from events")
def _(spark, sf_dir):
    """Three periods arrive; the run over the second one fails on a row and the third run takes up from there."""
    out, progress, runs = new_path(spark, "stream"), new_path(spark, "progress"), []

    def run(stream):
        runs.append(stream)
        rows = stream.select("event_id", F.concat(F.lit("job-"), "user_id").alias("job_id"))
        if len(runs) != 2:
            return streams.run_to_end(rows, out, progress)
        lost = F.when(F.pmod("event_id", F.lit(7)) == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("job_id"))
        try:
            streams.run_to_end(rows.withColumn("job_id", lost.cast("string")), out, progress)
        except StreamingQueryException:
            pass

    _in_order(spark, _zoned_events(spark, sf_dir).select("event_id", "user_id", "at"), 3, run)
    return spark.read.parquet(out).select("event_id", "job_id")
