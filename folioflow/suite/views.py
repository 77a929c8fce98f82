"""Catalog joined with registry: listings, submission, bundles, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import fmt
from folioflow.operators import registry
from folioflow.plans import bundle, report, submission, views
from folioflow.suite import derived
from folioflow.suite.derived import AS_OF, sql_with
from folioflow.schemas import TERMINAL
from folioflow.session import new_path
from folioflow.sources import catalog
from folioflow.suite import query
from folioflow.suite.catalog import SUPPORTED_SQL

LATEST_SQL = "(select * from jobs qualify row_number() over (partition by file_key order by submitted_at desc, job_id desc) = 1)"


@query(
    "j1_catalog_status",
    sql_with("files", "jobs", body=f"select f.key, f.size, j.status as job_status, j.job_id from files f left join {LATEST_SQL} j on j.file_key = f.key where {SUPPORTED_SQL}"),
)
def catalog_status(spark, sf_dir):
    files = catalog.supported(derived.files(spark, sf_dir))
    return views.file_listing(files, derived.jobs(spark, sf_dir), show_all=True)


@query("j2_unsubmitted_files", sql_with("files", "jobs", body="select key, size from files where key not in (select file_key from jobs)"))
def _(spark, sf_dir):
    return views.unsubmitted(derived.files(spark, sf_dir), derived.jobs(spark, sf_dir)).select("key", "size")


@query(
    "p12_listing_default",
    sql_with("files", "jobs", body=f"select key, size, null::varchar as job_status, null::varchar as job_id from files where {SUPPORTED_SQL} and key not in (select file_key from jobs)"),
)
def _(spark, sf_dir):
    files = catalog.supported(derived.files(spark, sf_dir))
    return views.file_listing(files, derived.jobs(spark, sf_dir))


REQUESTS_SQL = """requests as (
  select concat('e', event_id) as request_id, case when event_type = 'error' then concat('in/none/', event_id, '.pdf') else key end as file_key,
    case when event_type = 'click' then 'arabic' when event_type = 'view' then '' end as lang
  from events join files on doc_id = user_id
  union all select concat('f', doc_id), key, null from files)"""


def _requests(spark, sf_dir):
    """One request per event and one per file: absent files, unsupported ones and repeats among them."""
    files = derived.files(spark, sf_dir)
    events = derived.table(spark, sf_dir, "events").withColumnRenamed("user_id", "doc_id")
    kind = F.col("event_type")
    absent = F.concat(F.lit("in/none/"), F.col("event_id").cast("string"), F.lit(".pdf"))
    asked = events.join(files, "doc_id").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(kind == "error", absent).otherwise(F.col("key")).alias("file_key"),
        F.when(kind == "click", "arabic").when(kind == "view", "").alias("lang"),
    )
    whole = files.select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("request_id"),
        F.col("key").alias("file_key"),
        F.lit(None).cast("string").alias("lang"),
    )
    return asked.unionByName(whole)


@query(
    "j5_size_lookup",
    sql_with(
        "files",
        extra=REQUESTS_SQL,
        body="select request_id, r.file_key, coalesce(f.size, 0) as size from requests r left join files f on f.key = r.file_key",
    ),
)
def _(spark, sf_dir):
    requests = _requests(spark, sf_dir).select("request_id", "file_key")
    return views.file_sizes(requests, derived.files(spark, sf_dir).drop("doc_id"))


DECISION_SQL = f"""{REQUESTS_SQL}, judged as (select request_id, r.file_key, coalesce(f.size, 0) as size, lang,
    case when not regexp_matches(r.file_key, '(?i)\\.(pdf|png|jpg|jpeg|tiff)$') then 400
         when r.file_key in (select file_key from jobs where status = 'running') then 409 else 202 end as code
    from requests r left join files f on f.key = r.file_key)"""


def _decisions(spark, sf_dir):
    return submission.decide(
        _requests(spark, sf_dir), derived.files(spark, sf_dir), derived.jobs(spark, sf_dir), AS_OF, submission.Defaults("ch", "auto", "pipeline")
    )


@query(
    "c1_submission",
    sql_with(
        "files",
        "jobs",
        extra=DECISION_SQL,
        body=f"""select request_id, file_key, code = 202 as accepted, code,
          case code when 400 then concat('Unsupported format: ', lower(regexp_extract(file_key, '[^/](\\.[^./]+)$', 1)))
                    when 409 then concat('Job already running for: ', file_key) end as reason,
          case when code = 202 then sha256(concat('{{"p0":"', file_key, '","p1":"{AS_OF}","p2":"', request_id, '"}}')) end as job_id,
          case when code = 202 then size end as file_size, timestamp '{AS_OF}' as submitted_at,
          coalesce(nullif(lang, ''), 'ch') as lang, 'auto' as arabic_bidi_fix, 'pipeline' as backend from judged""",
    ),
)
def _(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query(
    "c1_strict_submission",
    sql_with(
        "files",
        "jobs",
        extra=DECISION_SQL,
        body="""select 'all' as batch, file_key from judged where (select count(*) from judged where code <> 202) = 0
          union all select 'accepted' as batch, file_key from judged where code = 202""",
    ),
)
def _(spark, sf_dir):
    """All requests together, one of which is refused, and those that were accepted."""
    decisions = _decisions(spark, sf_dir)
    batches = {"all": decisions, "accepted": decisions.where("code = 202")}
    both = [submission.accepted_jobs(d, strict=True).withColumn("batch", F.lit(name)) for name, d in batches.items()]
    jobs = both[0].union(both[1])
    return jobs.select("batch", "file_key")


@query(
    "a3_created_count",
    sql_with(
        "files",
        "jobs",
        extra=DECISION_SQL,
        body="""select count(*) filter (where code = 202) as created, count(*) filter (where code <> 202) as rejected,
          count(*) as requested from judged""",
    ),
)
def _(spark, sf_dir):
    return submission.created_count(_decisions(spark, sf_dir))


# ---- listing view --------------------------------------------------------------------------

LABEL_SQL = "case status when 'pending' then '待处理' when 'running' then '处理中' when 'success' then '成功' when 'failed' then '失败' when 'skipped' then '已跳过' else status end"
SHORT_SQL = "case when length(error) > 300 then concat(left(error, 300), '…') else error end"
SIZE_SQL = """case when {0} is null or {0} = 0 then '—' when {0} < 1024 then concat({0}, ' B')
  when {0} < 1048576 then format('{{:.1f}} KB', floor({0} * 10 / 1024 + 0.5) / 10) else format('{{:.2f}} MB', floor({0} * 100 / 1048576 + 0.5) / 100) end"""


@query("p14_status_label", sql_with("jobs", body=f"select job_id, {LABEL_SQL} as label from (select job_id, status from jobs union all select job_id, 'paused' from jobs)"))
def _(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir).select("job_id", "status")
    unknown = jobs.withColumn("status", F.lit("paused"))
    return jobs.unionByName(unknown).select("job_id", fmt.status_label("status").alias("label"))


@query("p15_placeholder", sql_with("jobs", body="select job_id, coalesce(cast(page_count as varchar), '—') as pages, coalesce(nullif(error, ''), '—') as error, coalesce(nullif(lang, ''), '—') as lang from jobs"))
def _(spark, sf_dir):
    return derived.jobs(spark, sf_dir).select(
        "job_id", fmt.or_dash("page_count").alias("pages"), fmt.or_dash("error").alias("error"), fmt.or_dash("lang").alias("lang")
    )


@query(
    "c7_job_list",
    sql_with(
        "jobs",
        body=f"""select job_id, file_key, file_size, status, submitted_at, started_at, completed_at, page_count, {SHORT_SQL} as error, backend,
          {LABEL_SQL} as status_label, strftime(submitted_at + interval '8' hour, '%Y/%-m/%-d %H:%M:%S') as submitted_text,
          coalesce(strftime(completed_at + interval '8' hour, '%Y/%-m/%-d %H:%M:%S'), '—') as completed_text,
          case when started_at is null or completed_at is null then '—' else '360.0s' end as duration_text,
          {SIZE_SQL.format('file_size')} as size_text, coalesce(cast(page_count as varchar), '—') as pages_text,
          coalesce(nullif({SHORT_SQL}, ''), '—') as error_text, status = 'success' as comparable,
          status in ('success', 'failed', 'skipped') as terminal from jobs order by submitted_at desc""",
    ),
)
def _(spark, sf_dir):
    return views.job_list(derived.jobs(spark, sf_dir), "Asia/Shanghai", with_backend=True)


# ---- results and bundles -------------------------------------------------------------------

REWRITE_SQL = r"""replace(replace(regexp_replace(replace(replace(md, '](http://', '](~h~'), '](https://', '](~s~'),
  '!\[([^\]]*)\]\(([./]*)([^)~]+)\)', concat('![\1](', '{0}', left(target_key, length(target_key) - 3), '/\3)'), 'g'), '](~h~', '](http://'), '](~s~', '](https://')"""


@query(
    "c8_result_view",
    sql_with("jobs", "artifacts", body=f"select job_id, file_key, target_key, {REWRITE_SQL.format('https://store/')} as md from jobs join artifacts using (target_key)"),
)
def _(spark, sf_dir):
    return views.result_view(derived.jobs(spark, sf_dir), derived.artifacts(spark, sf_dir), "https://store/")


GONE_SQL = """case when file_size % 5 = 0 then concat(file_key, '.gone') else file_key end as file_key,
  case when file_size % 7 = 0 then concat(target_key, '.gone') else target_key end as target_key"""


@query(
    "c9_comparison",
    sql_with(
        "files",
        "jobs",
        "artifacts",
        body=f"""select job_id, file_key as title, case when f.key is not null then concat('src://', f.key) end as source_url,
          case when f.key is null then null when contains(lower(f.key), '.pdf') then 'pdf' else 'image' end as source_kind, r.md as result_md
          from (select * replace ({GONE_SQL}) from jobs where status = 'success') j left join files f on f.key = j.file_key
          left join (select target_key, {REWRITE_SQL.format('https://store/')} as md from artifacts) r on r.target_key = j.target_key""",
    ),
)
def _(spark, sf_dir):
    # Some jobs name a source or a result that is no longer there, so that either side can be NULL.
    gone = lambda c, n: F.when(F.col("file_size") % n == 0, F.concat(c, F.lit(".gone"))).otherwise(F.col(c))
    jobs = derived.jobs(spark, sf_dir).withColumns({"file_key": gone("file_key", 5), "target_key": gone("target_key", 7)})
    return views.comparison(jobs, derived.files(spark, sf_dir), derived.artifacts(spark, sf_dir), "src://", "https://store/")


@query(
    "j7_job_images",
    sql_with("jobs", "images", body="select job_id, file_key, key as image_key from jobs join images on starts_with(key, concat(left(target_key, length(target_key) - 3), '/images/'))"),
)
def _(spark, sf_dir):
    return bundle.job_images(derived.jobs(spark, sf_dir), derived.images(spark, sf_dir))


@query(
    "j8_job_objects",
    sql_with(
        "jobs",
        "files",
        "artifacts",
        "images",
        body="""select job_id, file_key as object_key from jobs join files on key = file_key
          union all select job_id, target_key as object_key from jobs join artifacts using (target_key)
          union all select job_id, key as object_key from jobs join images on starts_with(key, concat(left(target_key, length(target_key) - 3), '/images/'))""",
    ),
)
def _(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir)
    results = derived.artifacts(spark, sf_dir).select(F.col("target_key").alias("key"), F.length("md").cast("long").alias("size"))
    parts = bundle.manifest(jobs, jobs, derived.files(spark, sf_dir).drop("doc_id"), results.unionByName(derived.images(spark, sf_dir).select("key", "size")))
    return parts.select("job_id", F.col("source_key").alias("object_key"))


FOLDER_SQL = r"left(regexp_replace(regexp_extract(file_key, '[^/]+$', 0), '(.)\.[^.]+$', '\1'), 80)"
MANIFEST_SQL = sql_with(
    "files",
    "jobs",
    "artifacts",
    "images",
    extra="wanted as (select jobs.* from jobs join (select concat('job-', o_orderkey) as job_id from orders) using (job_id))",
    body=f"""select job_id, 'original' as part, concat({FOLDER_SQL}, '/', regexp_extract(file_key, '[^/]+$', 0)) as arcname, file_key as source_key
        from wanted join files on key = file_key
      union all select job_id, 'markdown', concat({FOLDER_SQL}, '/', regexp_extract(target_key, '[^/]+$', 0)), target_key
        from wanted join artifacts using (target_key)
      union all select job_id, 'image', concat({FOLDER_SQL}, '/images/', regexp_extract(key, '[^/]+$', 0)), key
        from wanted join images on starts_with(key, concat(left(target_key, length(target_key) - 3), '/images/'))""",
)


@query("u1_bundle_manifest", MANIFEST_SQL)
def _(spark, sf_dir):
    return _manifest(spark, sf_dir)


def _manifest(spark, sf_dir):
    """Requested ids come from the orders; some name no job."""
    requested = derived.table(spark, sf_dir, "orders").select(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"))
    results = derived.artifacts(spark, sf_dir).select(F.col("target_key").alias("key"), F.length("md").cast("long").alias("size"))
    stored = results.unionByName(derived.images(spark, sf_dir))
    return bundle.manifest(requested, derived.jobs(spark, sf_dir), derived.files(spark, sf_dir).drop("doc_id"), stored)


@query("k7_bundle_export", f"select part, count(*) as parts, min(arcname) as first_name, max(arcname) as last_name from ({MANIFEST_SQL}) group by part")
def _(spark, sf_dir):
    path = new_path(spark, "bundle")
    _manifest(spark, sf_dir).write.partitionBy("part").parquet(path)
    written = spark.read.parquet(path)
    return written.groupBy("part").agg(
        F.count("*").alias("parts"), F.min("arcname").alias("first_name"), F.max("arcname").alias("last_name")
    )


# ---- summaries and reports -----------------------------------------------------------------


def _results(spark, sf_dir):
    """Finished jobs with a duration of their own, in whole microseconds."""
    jobs = registry.with_status(derived.jobs(spark, sf_dir), *TERMINAL)
    number = F.regexp_extract("job_id", r"(\d+)$", 1).cast("long")
    return jobs.withColumn("duration_us", number * 7919 % 100_000_000)


RESULTS_SQL = """results as (select *, cast(regexp_extract(job_id, '([0-9]+)$', 1) as bigint) * 7919 % 100000000 as duration_us
  from jobs where status in ('success', 'failed', 'skipped'))"""


def _over_results(body: str, more: str = "") -> str:
    return sql_with("files", "jobs", extra=RESULTS_SQL + more, body=body)


@query(
    "a1_status_summary",
    sql_with(
        "jobs",
        body="""select count(*) as total, count(*) filter (where status = 'success') as success, count(*) filter (where status = 'failed') as failed,
          count(*) filter (where status = 'skipped') as skipped from jobs""",
    ),
)
def _(spark, sf_dir):
    return report.summary(derived.jobs(spark, sf_dir))


@query("a1_empty_summary", "select count(*) as total, count(*) as success, count(*) as failed, count(*) as skipped from events where event_type = 'no such type'")
def _(spark, sf_dir):
    return report.summary(registry.with_status(derived.jobs(spark, sf_dir), "no such status"))


@query("a5_upload_tally", sql_with("files", body=f"select count(*) filter (where {SUPPORTED_SQL}) as done, count(*) filter (where not {SUPPORTED_SQL}) as failed, count(*) as total from files"))
def _(spark, sf_dir):
    uploads = catalog.ingest(derived.files(spark, sf_dir).select(F.col("key").alias("name"), "size"))
    return report.tally(uploads, F.col("accepted"))


@query("a6_results_in_order", _over_results("select job_id, file_key, file_size, page_count, duration_us, status, error from results order by completed_at, job_id"))
def _(spark, sf_dir):
    ordered = report.in_order(_results(spark, sf_dir), "completed_at", "job_id")
    return ordered.select("job_id", "file_key", "file_size", "page_count", "duration_us", "status", "error")


REPORT_SQL = _over_results(
    more=""", total as (select count(*) as t, count(*) filter (where status = 'success') as s, count(*) filter (where status = 'failed') as f,
        count(*) filter (where status = 'skipped') as k from results),
      head as (select unnest([repeat('=', 60), 'OCR Processing Summary', repeat('=', 60), concat('Total:   ', t), concat('Success: ', s),
        concat('Failed:  ', f), concat('Skipped: ', k), '', repeat('-', 60),
        'File                               Size  Pages   Duration Status', repeat('-', 60)]) as line, unnest(range(11)) as line_no from total),
      body as (select completed_at, job_id, case when length(file_key) > 28 then concat('...', right(file_key, 25)) else file_key end as name,
        case when file_size < 1024 then format('{:.1f} B', file_size / 1) when file_size < 1048576 then format('{:.1f} KB', file_size / 1024)
             else format('{:.1f} MB', file_size / 1048576) end as size,
        cast(coalesce(page_count, 0) as varchar) as pages, format('{:.2f}s', duration_us / 1e6) as duration, status, error from results)""",
    body="""select 0 as section, null::timestamp as completed_at, null::varchar as job_id, cast(line_no as int) as line_no, line from head
      union all select 1, completed_at, job_id, 0, concat(name, repeat(' ', greatest(0, 30 - length(name))), ' ', lpad(size, greatest(8, length(size))::int, ' '), ' ',
        lpad(pages, 6, ' '), ' ', lpad(duration, 10, ' '), ' ', status) from body
      union all select 1, completed_at, job_id, 1, concat('  Error: ', error) from body where error <> ''
      union all select 2, null, null, 0, repeat('=', 60)""",
)


@query("c6_text_report", REPORT_SQL)
def _(spark, sf_dir):
    return report.report_lines(_results(spark, sf_dir), "completed_at", "job_id")


@query("k8_report_file", f"select line, count(*) as times from ({REPORT_SQL}) group by line")
def _(spark, sf_dir):
    path = new_path(spark, "report")
    report.write_report(report.report_lines(_results(spark, sf_dir), "completed_at", "job_id"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("times"))
