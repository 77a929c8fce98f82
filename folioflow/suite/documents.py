"""Extraction, batch and job runs, and reads and writes of document objects."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from folioflow.functions import fmt, text
from folioflow.operators import registry
from folioflow.operators.extraction import Extracted, UnsupportedFormat, extract
from folioflow.plans import runs
from folioflow.suite import derived
from folioflow.suite.derived import AS_OF, SOURCE_PREFIX, TARGET_PREFIX, sql_with
from folioflow.plans.submission import Defaults
from folioflow.session import new_path
from folioflow.sources import artifacts as stored
from folioflow.sources import catalog
from folioflow.sources.objects import fetch_objects, list_objects, put_objects
from folioflow.suite import query
from folioflow.suite.display import PAGES_SQL
from folioflow.suite.registry import COLUMNS

# ---- extraction over web pages -------------------------------------------------------------


def page_extractor(content: bytes, name: str, lang: str | None, backend: str | None) -> Extracted:
    """Takes UTF-8 pages: the page as Markdown, one layout entry per 2000 characters, two images, not in name order."""
    body = content.decode("utf-8")
    if 'lang="de"' in body:
        raise ValueError(f"no model for {name}")
    if 'lang="es"' in body:
        raise UnsupportedFormat(f"not a page: {name}")
    stem = name.rpartition(".")[0]
    layout = json.dumps({"pdf_info": [{}] * (1 + len(body) // 2000)})
    digest = hashlib.md5(content).hexdigest().encode()
    return Extracted(f"# {stem}\n\n![page](images/{stem}.png)\n\n{body}\n", layout, ((f"{stem}.png", digest), (f"{stem}-0.png", digest)))


PAGE_ENDING = "case page_id % 6 when 0 then '.html' when 1 then '.PDF' else '.png' end"


def _pages(spark, sf_dir):
    number = F.col("page_id")
    ending = F.when(number % 6 == 0, ".html").when(number % 6 == 1, ".PDF").otherwise(".png")
    return derived.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("in/p"), number.cast("string"), ending).alias("key"),
        F.octet_length("html").cast("long").alias("size"),
        F.encode("html", "UTF-8").alias("content"),
    )


PAGES_RUN = f"""with run as (select concat('in/p', page_id, {PAGE_ENDING}) as key, concat('p', page_id) as stem, html,
    cast(octet_length(encode(html)) as bigint) as size,
    case when page_id % 6 = 0 or contains(html, 'lang="es"') then 'skipped' when contains(html, 'lang="de"') then 'failed' else 'success' end as status,
    case when page_id % 6 = 0 then 'Unsupported format: .html'
         when contains(html, 'lang="de"') then concat('no model for p', page_id, {PAGE_ENDING})
         when contains(html, 'lang="es"') then concat('not a page: p', page_id, {PAGE_ENDING}) end as error,
    concat('# p', page_id, chr(10), chr(10), '![page](images/p', page_id, '.png)', chr(10), chr(10), html, chr(10)) as md,
    cast(1 + length(html) // 2000 as int) as pages from pages)"""


@query(
    "e1_guarded_extract",
    PAGES_RUN
    + """ select key, size, status, error, case when status = 'success' then md end as md, case when status = 'success' then pages end as pages,
      case when status = 'success' then concat(stem, '.png:', md5(html)) end as image from run""",
)
def _(spark, sf_dir):
    done = extract(_pages(spark, sf_dir), page_extractor)
    good = F.col("status") == "success"
    first = F.get("images", 0)
    return done.select(
        "key",
        "size",
        "status",
        "error",
        "md",
        F.when(good, fmt.page_count("layout_json")).alias("pages"),
        F.concat(first["name"], F.lit(":"), text.decode_utf8(first["content"])).alias("image"),
    )


def _batch(spark, sf_dir):
    return runs.run_batch(_pages(spark, sf_dir), page_extractor, SOURCE_PREFIX, TARGET_PREFIX)


@query(
    "c2_batch_run",
    PAGES_RUN + """ select key as file_key, size as file_size, case when status = 'success' then pages else 0 end as page_count, status, error from run""",
)
def _(spark, sf_dir):
    return _batch(spark, sf_dir).results.drop("duration_us")


@query(
    "c2_batch_summary",
    PAGES_RUN
    + """ select count(*) as total, count(*) filter (where status = 'success') as success, count(*) filter (where status = 'failed') as failed,
      count(*) filter (where status = 'skipped') as skipped from run""",
)
def _(spark, sf_dir):
    return _batch(spark, sf_dir).summary


@query("c2_batch_artifacts", PAGES_RUN + " select concat('out/', stem, '.md') as target_key, md, pages as page_count from run where status = 'success'")
def _(spark, sf_dir):
    return _batch(spark, sf_dir).artifacts.select("target_key", "md", "page_count")


@query(
    "k2_image_rows",
    PAGES_RUN
    + """ select concat('out/', stem, '.md') as target_key, position, concat('out/', stem, '/images/', stem, ending) as key,
      'image/png' as content_type, md5(html) as content from run, (values (0, '-0.png'), (1, '.png')) as i(position, ending) where status = 'success'""",
)
def _(spark, sf_dir):
    images = stored.explode_images(_batch(spark, sf_dir).artifacts)
    return images.withColumn("content", text.decode_utf8("content"))


# ---- runs over pending jobs ----------------------------------------------------------------

MARK = "\u200b\ufefb"


def text_extractor(content: bytes, name: str, lang: str | None, backend: str | None) -> Extracted:
    """Takes plain text; text with an at sign counts as unreadable."""
    body = content.decode("utf-8")
    if "@" in body:
        raise ValueError(f"{backend} cannot read {name}")
    return Extracted(f"{body}\n{MARK}", json.dumps({"pdf_info": [0] * (1 + body.count("\n"))}))


def _texts(spark, sf_dir):
    body = derived.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return derived.files(spark, sf_dir).join(body, "doc_id").drop("doc_id")


@query(
    "u2_outcome_union",
    sql_with(
        "files",
        body=r"""select key as file_key, size as file_size, case when ending = '' or ending = '.txt' then 'skipped' when contains(text, '@') then 'failed' else 'success' end as status,
          case when ending = '' or ending = '.txt' then concat('Unsupported format: ', ending)
            when contains(text, '@') then concat('pipeline cannot read ', regexp_extract(key, '[^/]+$', 0)) end as error
          from (select f.*, d.text, lower(regexp_extract(key, '\.[^./]+$', 0)) as ending from files f join documents d on d.doc_id = f.doc_id)""",
    ),
)
def _(spark, sf_dir):
    """Skipped, failed and finished documents of one run, as one table."""
    run = runs.run_batch(_texts(spark, sf_dir), text_extractor, SOURCE_PREFIX, TARGET_PREFIX, Defaults("ch", "never", "pipeline"))
    return run.results.select("file_key", "file_size", "status", "error")


def _pending_run(spark, sf_dir):
    jobs = derived.jobs(spark, sf_dir)
    clocks = (AS_OF, AS_OF.replace("00:00:00", "00:01:00"))
    return jobs, runs.run_pending(
        jobs, _texts(spark, sf_dir), text_extractor, *clocks, Defaults("ch", "never", "pipeline"), SOURCE_PREFIX, TARGET_PREFIX
    )


RUN_SQL = """done as (select job_id, file_key, submitted_at, lang, target, text, case when ending = '' or ending = '.txt' then 'skipped'
      when contains(text, '@') then 'failed' else 'success' end as state,
    case when ending = '' or ending = '.txt' then concat('Unsupported format: ', ending)
      when contains(text, '@') then concat(coalesce(nullif(backend, ''), 'pipeline'), ' cannot read ', regexp_extract(file_key, '[^/]+$', 0)) end as problem,
    cast(len(string_split(text, chr(10))) as int) as pages
  from (select jobs.*, d.text, regexp_extract(file_key, '\\.[^./]+$', 0) as ending, concat('out/', d.source, '/f', d.doc_id,
      case when d.doc_id % 8 = 6 then '.v1' else '' end, '.md') as target
    from jobs join files f on f.key = file_key join documents d on d.doc_id = f.doc_id where status = 'pending'))"""

FINAL = {
    "status": "coalesce(state, status)",
    "started_at": f"case when state is not null then timestamp '{AS_OF}' else started_at end",
    "completed_at": f"case when state is not null then timestamp '{AS_OF}' + interval '1' minute else completed_at end",
    "page_count": "case when state = 'success' then pages else page_count end",
    "error": "coalesce(problem, error)",
    "target_key": "case when state = 'success' then target else target_key end",
}


@query(
    "c3_job_lifecycle",
    sql_with(
        "jobs",
        extra=RUN_SQL,
        body="select " + ", ".join(f"{FINAL.get(c, 'jobs.' + c)} as {c}" for c in COLUMNS.split(", "))
        + " from jobs left join (select job_id, state, problem, pages, target from done) d on d.job_id = jobs.job_id",
    ),
)
def _(spark, sf_dir):
    jobs, run = _pending_run(spark, sf_dir)
    return registry.apply_updates(jobs, run.updates)


@query(
    "c3_job_artifacts",
    sql_with(
        "jobs",
        extra=RUN_SQL,
        body="""select target as target_key, concat(text, chr(10), case when lang = 'arabic' then 'لا' else '\u200b\ufefb' end) as md, pages as page_count
          from done where state = 'success' qualify row_number() over (partition by target order by submitted_at desc, job_id desc) = 1""",
    ),
)
def _(spark, sf_dir):
    _, run = _pending_run(spark, sf_dir)
    return run.artifacts.select("target_key", "md", "page_count")


# ---- choosing among found objects ----------------------------------------------------------


def _candidates(spark, sf_dir):
    """Layout files found per user: under the expected path for the latest event, elsewhere for the others."""
    layouts = derived.middle(spark, sf_dir)
    number = F.col("event_id")
    name = F.concat(F.md5(F.col("user_id").cast("string")), F.lit("_middle.json"))
    place = F.when(number % 3 == 0, name).otherwise(F.concat(F.lit("other/"), F.lpad(number.cast("string"), 12, "0"), F.lit("_middle.json")))
    return layouts.withColumn("expected", number % 3 == 0).withColumn("path", F.concat(place, F.lit("#"), F.lpad(number.cast("string"), 12, "0")))


CANDIDATES_SQL = """found as (select *, event_id % 3 = 0 as expected, concat(case when event_id % 3 = 0 then concat(md5(cast(user_id as varchar)), '_middle.json')
    else concat('other/', lpad(cast(event_id as varchar), 12, '0'), '_middle.json') end, '#', lpad(cast(event_id as varchar), 12, '0')) as path from middle)"""


@query(
    "w2_pick_preferred",
    sql_with("middle", extra=CANDIDATES_SQL, body="select user_id, path, middle_json from found qualify row_number() over (partition by user_id order by expected desc, path) = 1"),
)
def _(spark, sf_dir):
    picked = stored.pick_preferred(_candidates(spark, sf_dir), "user_id", "path", F.col("expected"))
    return picked.select("user_id", "path", "middle_json")


@query(
    "s4_layout_page_count",
    sql_with(
        "middle",
        extra=CANDIDATES_SQL,
        body=f"""select doc_id, coalesce(pages, 0) as page_count from documents left join (select user_id, cast({PAGES_SQL} as int) as pages from found
          qualify row_number() over (partition by user_id order by expected desc, path) = 1) on user_id = doc_id""",
    ),
)
def _(spark, sf_dir):
    picked = stored.pick_preferred(_candidates(spark, sf_dir), "user_id", "path", F.col("expected"))
    counts = picked.select(F.col("user_id").alias("doc_id"), fmt.page_count("middle_json").alias("page_count"))
    docs = derived.table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(counts, "doc_id", "left").select("doc_id", F.coalesce("page_count", F.lit(0)).alias("page_count"))


# ---- objects -------------------------------------------------------------------------------


def _stored_markdown(spark, sf_dir):
    """Write every result as an object and give the folder."""
    root = new_path(spark, "objects")
    stored.write_markdown_objects(derived.artifacts(spark, sf_dir), root).write.parquet(new_path(spark, "written"))
    return root


@query("k1_markdown_objects", sql_with("artifacts", body="select target_key as key, octet_length(encode(md)) as size, null::varchar as error from artifacts"))
def _(spark, sf_dir):
    return stored.write_markdown_objects(derived.artifacts(spark, sf_dir), new_path(spark, "objects"))


@query("s3_markdown_scan", sql_with("artifacts", body="select target_key, md from artifacts"))
def _(spark, sf_dir):
    return stored.markdown(spark, _stored_markdown(spark, sf_dir), "out/").select("target_key", "md")


@query("s2_fetch_bytes", sql_with("artifacts", body="select target_key as key, octet_length(encode(md)) as size, md5(md) as digest from artifacts"))
def _(spark, sf_dir):
    """List inside tasks, folder by folder, then fetch by key."""
    root = _stored_markdown(spark, sf_dir)
    folders = derived.table(spark, sf_dir, "documents").select(F.concat(F.lit("out/"), "source").alias("folder")).distinct()
    found = fetch_objects(list_objects(spark, root, folders), root)
    return found.select("key", "size", F.md5("content").alias("digest"))


@query(
    "s5_markdown_or_failed",
    sql_with(
        "artifacts",
        body="""select md5(target_key) as folder, case when doc_id % 10 < 9 then md end as md,
          case when doc_id % 10 = 9 then concat('no Markdown output below ', md5(target_key)) end as error from artifacts""",
    ),
)
def _(spark, sf_dir):
    """Work folders with the expected file, with one elsewhere, with both, and with none."""
    made = derived.artifacts(spark, sf_dir).withColumn("folder", F.md5("target_key"))
    kind, folder = F.col("doc_id") % 10, F.col("folder")
    expected = F.concat(folder, F.lit("/"), folder, F.lit("/"), folder, F.lit(".md"))
    elsewhere = F.concat(folder, F.lit("/a/other.md"))
    objects = F.when(kind < 5, F.array(F.struct(expected.alias("key"), F.col("md"))))
    objects = objects.when(kind < 7, F.array(F.struct(elsewhere.alias("key"), F.col("md"))))
    both = F.array(F.struct(expected.alias("key"), F.col("md")), F.struct(elsewhere.alias("key"), F.lit("second choice").alias("md")))
    rows = made.select(F.explode(objects.when(kind < 9, both)).alias("o")).select("o.*")
    root = new_path(spark, "work")
    put_objects(rows, root, "key", "md").write.parquet(new_path(spark, "written"))
    return stored.work_markdown(spark, root, made.select("folder"))


@query(
    "s6_image_scan",
    PAGES_RUN
    + """ select concat('out/', stem, '/images/', stem, ending) as key, 32::bigint as size, concat('out/', stem, '/images/') as images_prefix
      from run, (values ('-0.png'), ('.png')) as i(ending) where status = 'success'""",
)
def _(spark, sf_dir):
    root = new_path(spark, "objects")
    stored.write_image_objects(_batch(spark, sf_dir).artifacts, root).write.parquet(new_path(spark, "written"))
    return stored.images_below(catalog.all_files(spark, root))
