"""Job registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import fmt
from folioflow.operators import registry
from folioflow.suite import derived
from folioflow.suite.derived import AS_OF, sql_with
from folioflow.schemas import JOB_SCHEMA, TERMINAL, UPDATABLE
from folioflow.session import new_path
from folioflow.sources import jobs as stored
from folioflow.suite import query

COLUMNS = ", ".join(f.name for f in JOB_SCHEMA.fields)
LATEST_SQL = f"select {COLUMNS} from jobs qualify row_number() over (partition by file_key order by submitted_at desc, job_id desc) = 1"


@query("s7_job_table", sql_with("jobs", body=f"select {COLUMNS} from jobs"))
def _(spark, sf_dir):
    """Through a table on disk."""
    root = new_path(spark, "registry")
    stored.save_jobs(derived.jobs(spark, sf_dir), root)
    return stored.load_jobs(spark, root)


@query("s8_key_manifest", sql_with("jobs", "files", body=f"select {COLUMNS} from jobs where file_key in (select key from files where ends_with(key, '.pdf'))"))
def _(spark, sf_dir):
    keys = derived.files(spark, sf_dir).where(F.col("key").endswith(".pdf")).select("key")
    return registry.with_keys(derived.jobs(spark, sf_dir), keys)


@query("w1_latest_per_key", sql_with("jobs", body=LATEST_SQL))
def _(spark, sf_dir):
    return registry.latest_per_key(derived.jobs(spark, sf_dir))


def _bucketed(spark, sf_dir):
    root = new_path(spark, "bucketed")
    return stored.save_bucketed(derived.jobs(spark, sf_dir), f"jobs_{root[-32:]}", 8, root)


@query("w1_latest_bucketed", sql_with("jobs", body=LATEST_SQL))
def _(spark, sf_dir):
    """The latest job of each file from a bucketed table: no shuffle."""
    return registry.latest_per_key(_bucketed(spark, sf_dir))


@query(
    "j4_latest_for_keys",
    sql_with(
        "jobs",
        body=f"""select {COLUMNS} from jobs where file_key in (select file_key from jobs where status = 'failed')
          and submitted_at = (select max(submitted_at) from jobs j2 where j2.file_key = jobs.file_key)""",
    ),
)
def _(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir)
    return registry.latest_for_keys(jobs, registry.keys_in(jobs, "failed"))


@query("a2_last_submission", sql_with("jobs", body="select file_key, max(submitted_at) as last_submitted from jobs group by file_key"))
def _(spark, sf_dir):
    return registry.last_submissions(derived.jobs(spark, sf_dir))


@query(
    "a3_counts",
    sql_with(
        "jobs",
        body="""select count(*) as jobs, count(*) filter (where status in ('pending', 'running')) as unfinished,
          count(distinct file_key) as submitted_keys from jobs""",
    ),
)
def _(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir)
    unfinished = F.count_if(F.col("status").isin("pending", "running"))
    # One row per key first: distinct keys are then a plain count, with map-side reduction throughout.
    by_key = jobs.groupBy("file_key").agg(F.count("*").alias("n"), unfinished.alias("u"))
    return by_key.agg(F.sum("n").alias("jobs"), F.sum("u").alias("unfinished"), F.count("*").alias("submitted_keys"))


@query("p5_option_defaults", sql_with("jobs", body="select job_id, coalesce(nullif(lang, ''), 'ch') as lang from jobs"))
def _(spark, sf_dir):
    return derived.jobs(spark, sf_dir).select("job_id", fmt.or_default("lang", "ch").alias("lang"))


@query(
    "j6_job_options",
    sql_with(
        "jobs",
        body="""select job_id, coalesce(nullif(lang, ''), 'ch') as lang, coalesce(nullif(arabic_bidi_fix, ''), 'auto') as arabic_bidi_fix,
          coalesce(nullif(backend, ''), 'pipeline') as backend from jobs""",
    ),
)
def _(spark, sf_dir):
    jobs = registry.with_options(derived.jobs(spark, sf_dir), "ch", "auto", "pipeline")
    return jobs.select("job_id", "lang", "arabic_bidi_fix", "backend")


@query("p6_public_fields", sql_with("jobs", body="select job_id, file_key, file_size, status, submitted_at, started_at, completed_at, page_count, error from jobs"))
def _(spark, sf_dir):
    from folioflow.plans.views import public_jobs

    return public_jobs(derived.jobs(spark, sf_dir))


@query("p7_short_error", sql_with("jobs", body="select job_id, case when length(error) > 300 then concat(left(error, 300), '…') else error end as error from jobs"))
def _(spark, sf_dir):
    return derived.jobs(spark, sf_dir).select("job_id", fmt.short_error("error").alias("error"))


@query("p8_job_lookup", sql_with("jobs", body=f"select {COLUMNS} from jobs where job_id = 'job-7'"))
def _(spark, sf_dir):
    return registry.get_job(derived.jobs(spark, sf_dir), "job-7")


@query("p9_unfinished_filter", sql_with("jobs", body=f"select {COLUMNS} from jobs where status in ('pending', 'running')"))
def _(spark, sf_dir):
    return registry.with_status(derived.jobs(spark, sf_dir), "pending", "running")


@query(
    "p10_status_flags",
    sql_with(
        "jobs",
        body="""select job_id, status = 'running' as running, status = 'success' as success,
          status in ('success', 'failed', 'skipped') as terminal from jobs""",
    ),
)
def _(spark, sf_dir):
    status = F.col("status")
    return derived.jobs(spark, sf_dir).select(
        "job_id", (status == "running").alias("running"), (status == "success").alias("success"), status.isin(*TERMINAL).alias("terminal")
    )


@query("p11_jobs_of_keys", sql_with("jobs", "files", body="select job_id, file_key from jobs where file_key in (select key from files where size > 500000)"))
def _(spark, sf_dir):
    keys = derived.files(spark, sf_dir).where(F.col("size") > 500000).select("key")
    return registry.with_keys(derived.jobs(spark, sf_dir), keys).select("job_id", "file_key")


@query("p13_has_result", sql_with("jobs", body="select job_id, target_key from jobs where nullif(target_key, '') is not null"))
def _(spark, sf_dir):
    return registry.has_result(derived.jobs(spark, sf_dir)).select("job_id", "target_key")


@query("o1_newest_first", sql_with("jobs", body="select job_id, submitted_at from jobs order by submitted_at desc"))
def _(spark, sf_dir):
    return registry.newest_first(derived.jobs(spark, sf_dir).select("job_id", "submitted_at"))


@query("o2_unfinished_oldest_first", sql_with("jobs", body="select job_id, status, submitted_at from jobs where status in ('pending', 'running') order by submitted_at"))
def _(spark, sf_dir):
    return registry.unfinished(derived.jobs(spark, sf_dir).select("job_id", "status", "submitted_at"))


@query("o4_running_exists", sql_with("jobs", "files", body="select key from files where exists (select 1 from jobs where file_key = key and status = 'running' limit 1)"))
def _(spark, sf_dir):
    keys = derived.files(spark, sf_dir).select(F.col("key").alias("file_key"))
    return registry.conflicts(keys, derived.jobs(spark, sf_dir)).select(F.col("file_key").alias("key"))


@query("o5_recent_jobs", sql_with("jobs", body="select job_id, lang, backend, status from jobs order by submitted_at desc, job_id desc limit 10"))
def _(spark, sf_dir):
    return registry.recent(derived.jobs(spark, sf_dir), 10, "job_id", "lang", "backend", "status")


@query("j3_running_conflicts", sql_with("jobs", "files", body="select doc_id, key as file_key from files where key in (select file_key from jobs where status = 'running')"))
def _(spark, sf_dir):
    keys = derived.files(spark, sf_dir).select("doc_id", F.col("key").alias("file_key"))
    return registry.conflicts(keys, derived.jobs(spark, sf_dir)).select("doc_id", "file_key")


# ---- writes --------------------------------------------------------------------------------

NEW_SQL = f"""select concat('new-', cast(doc_id as string)) as job_id, key as file_key, size as file_size, 'pending' as status,
  timestamp '{AS_OF}' as submitted_at, null::timestamp as started_at, null::timestamp as completed_at, null::int as page_count,
  null::varchar as error, null::varchar as target_key, 'ch' as lang, null::varchar as arabic_bidi_fix, null::varchar as backend from files"""


def _new_rows(spark, sf_dir, jobs):
    return derived.files(spark, sf_dir).select(
        F.concat(F.lit("new-"), F.col("doc_id").cast("string")).alias("job_id"),
        F.col("key").alias("file_key"),
        F.col("size").alias("file_size"),
        registry.clock(jobs, AS_OF).alias("submitted_at"),
        F.lit("ch").alias("lang"),
    )


@query("k4_insert", sql_with("jobs", "files", body=f"select {COLUMNS} from jobs union all {NEW_SQL}"))
def _(spark, sf_dir):
    """The table with new rows, written and read again."""
    jobs, root = derived.jobs(spark, sf_dir), new_path(spark, "registry")
    stored.save_jobs(registry.insert(jobs, _new_rows(spark, sf_dir, jobs)), root)
    return stored.load_jobs(spark, root)


@query(
    "k4_duplicate_ids",
    """select distinct concat('job-', cast(o_orderkey as string)) as job_id from orders
      where o_orderkey in (select event_id from events join documents on doc_id = user_id)""",
)
def _(spark, sf_dir):
    ids = derived.table(spark, sf_dir, "orders").select(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"))
    return registry.duplicate_ids(derived.jobs(spark, sf_dir), ids)


def _updates(jobs):
    """One update per running job and a later one per failed or running job; errors are cleared by an explicit NULL."""
    running = registry.with_status(jobs, "running").select(
        "job_id",
        F.lit(1).alias("seq"),
        F.lit("success").alias("status"),
        F.lit(True).alias("set_status"),
        F.lit(5).alias("page_count"),
        F.lit(True).alias("set_page_count"),
        F.lit("ignored").alias("file_key"),
    )
    cleared = registry.with_status(jobs, "failed", "running").select(
        "job_id",
        F.lit(2).alias("seq"),
        F.lit(None).cast("string").alias("error"),
        F.lit(True).alias("set_error"),
        F.lit("vlm-auto-engine").alias("backend"),
        (F.col("status") == "failed").alias("set_backend"),
    )
    return running.unionByName(cleared, allowMissingColumns=True)


UPDATED = {
    "status": "case when status = 'running' then 'success' else status end",
    "page_count": "case when status = 'running' then 5 else page_count end",
    "error": "case when status in ('failed', 'running') then null else error end",
    "backend": "case when status = 'failed' then 'vlm-auto-engine' else backend end",
}
UPDATED_SQL = "select " + ", ".join(f"{UPDATED.get(f.name, f.name)} as {f.name}" for f in JOB_SCHEMA.fields) + " from jobs"


@query("k5_update", sql_with("jobs", body=UPDATED_SQL))
def _(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir)
    return registry.update(jobs, _updates(jobs), "seq")


@query(
    "p18_update_whitelist",
    "select unnest(['status', 'page_count', 'error', 'backend']) as field, count(*) as jobs from events join documents on doc_id = user_id group by 1",
)
def _(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir)
    updates = _updates(jobs)
    names = F.array(*[F.lit(c) for c in registry.update_fields(updates) if c in UPDATABLE])
    return jobs.select(F.explode(names).alias("field")).groupBy("field").agg(F.count("*").alias("jobs"))


@query("k6_delete", sql_with("jobs", body=f"select {COLUMNS} from jobs where job_id not in (select concat('job-', cast(o_orderkey as string)) from orders where o_orderstatus = 'F')"))
def _(spark, sf_dir):
    return registry.delete(derived.jobs(spark, sf_dir), _doomed(spark, sf_dir))


@query(
    "k6_deleted_count",
    sql_with("jobs", body="select count(*) as deleted from jobs where job_id in (select concat('job-', cast(o_orderkey as string)) from orders where o_orderstatus = 'F')"),
)
def _(spark, sf_dir):
    return registry.deleted_count(derived.jobs(spark, sf_dir), _doomed(spark, sf_dir))


def _doomed(spark, sf_dir):
    """Ids asked to be deleted; many do not exist."""
    orders = derived.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return orders.select(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"))


@query(
    "j9_update_then_delete",
    sql_with("jobs", body=f"select * from ({UPDATED_SQL}) where job_id not in (select concat('job-', cast(o_orderkey as string)) from orders where o_orderstatus = 'F')"),
)
def _(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir)
    return registry.update(registry.delete(jobs, _doomed(spark, sf_dir)), _updates(jobs), "seq")


# ---- sweep and recovery --------------------------------------------------------------------


def sweep_sql(as_of: str) -> str:
    """The sweep in SQL; ``as_of`` is a timestamp expression."""
    never = "status = 'running' and started_at is null"
    late = f"status = 'running' and {as_of} - started_at > interval '2' hour"
    swept = {
        "status": f"case when {never} or {late} then 'failed' else status end",
        "completed_at": f"case when {never} or {late} then {as_of} else completed_at end",
        "error": f"""case when {never} then 'Task stuck: no started_at timestamp'
          when {late} then 'Task stuck for more than 2.0 hours, automatically marked as failed' else error end""",
    }
    return "select " + ", ".join(f"{swept.get(f.name, f.name)} as {f.name}" for f in JOB_SCHEMA.fields) + " from jobs"


@query("c4_stuck_sweep", sql_with("jobs", body=sweep_sql(f"timestamp '{AS_OF}'")))
def _(spark, sf_dir):
    return registry.sweep(derived.jobs(spark, sf_dir), AS_OF)


@query(
    "c4_sweep_as_updates",
    sql_with("jobs", body=sweep_sql(f"timestamp '{AS_OF}'")),
)
def _(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir)
    return registry.apply_updates(jobs, registry.stuck_updates(jobs, AS_OF))


@query(
    "c5_recovery",
    sql_with(
        "jobs",
        body=f"""select {COLUMNS.replace("status", "'pending' as status")} from jobs where status in ('pending', 'running')
          order by submitted_at""",
    ),
)
def _(spark, sf_dir):
    return registry.recovery_queue(derived.jobs(spark, sf_dir))
