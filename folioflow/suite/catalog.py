"""Catalog, path and key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import paths, text
from folioflow.suite import derived
from folioflow.suite.derived import AS_OF, SOURCE_PREFIX, TARGET_PREFIX, sql_with
from folioflow.session import new_path
from folioflow.sources import catalog
from folioflow.sources.objects import put_objects
from folioflow.suite import query

SUPPORTED_SQL = "lower(regexp_extract(key, '^.+(\\.[^.]+)$', 1)) in ('.pdf', '.png', '.jpg', '.jpeg', '.tiff')"

#: Forms of a key that differ in how path components and suffixes are read.
VARIANTS = ("{}", "{}/", "{}/.", "{}.", ".{}", "..{}", "a//./{}", "/{}", "//{}", "///{}", "{}/.pdf", "{}/..", "{}.tar.gz")


def _variants(spark, sf_dir):
    forms = [F.concat(F.lit(v.partition("{}")[0]), "key", F.lit(v.partition("{}")[2])) for v in VARIANTS]
    return derived.files(spark, sf_dir).select(F.explode(F.array(*forms)).alias("key"))


VARIANTS_SQL = ", ".join("concat('{}', key, '{}')".format(v.partition("{}")[0], v.partition("{}")[2]) for v in VARIANTS)


def _cut(relative: str) -> str:
    """Views that take a key (after cutting it to ``relative``) apart: parts, name, ending."""
    return rf"""v as (select unnest([{VARIANTS_SQL}]) as key from files), r as (select key, {relative} as rel from v),
      named as (select *, list_filter(string_split(rel, '/'), lambda x: x <> '' and x <> '.') as parts from r),
      last as (select *, coalesce(parts[-1], '') as name from named),
      cut as (select *, regexp_extract(name, '^.+(\.[^.]+)$', 1) as ending from last)"""



def _hidden(key: str) -> str:
    """Every fifth file in a folder, and every seventh of them under a name, that Spark's own sources leave out."""
    return f"""case when doc_id % 5 = 0 then concat('in/_arch/.old/', doc_id, '_', regexp_extract({key}, '[^/]+$', 0))
      when doc_id % 7 = 0 then concat('in/.f', doc_id, '/_', regexp_extract({key}, '[^/]+$', 0)) else {key} end"""


@query(
    "s1_catalog_scan",
    sql_with("files", body=f"select key, size from (select {_hidden('key')} as key, doc_id % 100 as size from files) where {SUPPORTED_SQL}"),
)
def _(spark, sf_dir):
    """Objects with and without hidden names are written, and listed again."""
    root = new_path(spark, "store")
    body = F.repeat(F.lit("x"), (F.col("doc_id") % 100).cast("int")).alias("body")
    files = derived.files(spark, sf_dir).select(F.expr(_hidden("key").replace("'[^/]+$'", "r'[^/]+$'")).alias("key"), body)
    put_objects(files, root, "key", "body").write.parquet(new_path(spark, "written"))
    return catalog.list_files(spark, root, "in/")


@query("p1_suffix", sql_with("files", extra=_cut("key"), body="select key, lower(ending) as suffix from cut"))
def _(spark, sf_dir):
    return _variants(spark, sf_dir).select("key", paths.suffix("key").alias("suffix"))


@query("p2_supported", sql_with("files", body=f"select key, {SUPPORTED_SQL} as supported from files"))
def _(spark, sf_dir):
    return derived.files(spark, sf_dir).select("key", paths.is_supported("key").alias("supported"))


@query("p3_key_prefix", sql_with("files", body="select key, size from files where starts_with(key, 'in/src1')"))
def _(spark, sf_dir):
    return derived.files(spark, sf_dir).where(F.col("key").startswith("in/src1")).select("key", "size")


@query(
    "p4_skipped_rows",
    sql_with(
        "files",
        body=f"""select key, size, case when not ok then 'skipped' end as status, case when not ok then 0 end as page_count,
          case when not ok then concat('Unsupported format: ', lower(regexp_extract(key, '^.+(\\.[^.]+)$', 1))) end as error
          from (select key, size, {SUPPORTED_SQL} as ok from files)""",
    ),
)
def _(spark, sf_dir):
    return catalog.split_supported(derived.files(spark, sf_dir).select("key", "size"))


@query(
    "k3_ingest",
    sql_with(
        "files",
        body=f"""select name, case when ok then concat('in/', name) end as key, case when ok then size end as size, ok as accepted,
          case when not ok then concat('Unsupported format: ', lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1))) end as reason
          from (select regexp_extract(key, '[^/]+$', 0) as name, size, {SUPPORTED_SQL} as ok from files)""",
    ),
)
def _(spark, sf_dir):
    uploads = derived.files(spark, sf_dir).select(paths.file_name("key").alias("name"), "size")
    return catalog.ingest(uploads, SOURCE_PREFIX)


@query(
    "x1_target_key",
    sql_with(
        "files",
        extra=_cut("case when starts_with(key, 'in/') then substr(key, 4) else key end"),
        body="""select key, case when len(parts) > 0 then concat('out/',
          case when starts_with(rel, '//') and not starts_with(rel, '///') then '//' when starts_with(rel, '/') then '/' else '' end,
          array_to_string(list_concat(parts[1:len(parts) - 1], [concat(left(name, length(name) - length(ending)), '.md')]), '/')) end
          as target_key from cut""",
    ),
)
def _(spark, sf_dir):
    return _variants(spark, sf_dir).select("key", paths.target_key("key", SOURCE_PREFIX, TARGET_PREFIX).alias("target_key"))


@query(
    "x1_target_collisions",
    sql_with(
        "files",
        body=r"""select target_key, count(*) as sources, min(key) as first_key, max(key) as last_key from
          (select key, concat('out/', regexp_replace(key, '(.)\.[^./]+$', '\1'), '.md') as target_key from
            (select unnest([replace(key, '.PNG', '.png'), concat(regexp_replace(key, '\.[^./]+$', ''), '.tiff')]) as key from files))
          group by target_key having count(*) > 1""",
    ),
)
def _(spark, sf_dir):
    listed = derived.files(spark, sf_dir)
    scans = F.concat(F.regexp_replace("key", r"\.[^./]+\z", ""), F.lit(".tiff"))
    doubled = listed.select(F.explode(F.array(F.replace("key", F.lit(".PNG"), F.lit(".png")), scans)).alias("key"))
    return catalog.target_collisions(doubled, "", TARGET_PREFIX)


@query(
    "x2_name_and_stem",
    sql_with("files", extra=_cut("key"), body="select key, name, left(name, length(name) - length(ending)) as stem from cut"),
)
def _(spark, sf_dir):
    return _variants(spark, sf_dir).select("key", paths.file_name("key").alias("name"), paths.stem("key").alias("stem"))


@query("x3_artifact_prefix", sql_with("artifacts", body="select target_key, left(target_key, length(target_key) - 3) as prefix from artifacts"))
def _(spark, sf_dir):
    return derived.artifacts(spark, sf_dir).select("target_key", paths.artifact_prefix("target_key").alias("prefix"))


@query("x4_safe_dir", sql_with("files", body=r"select key, md5(regexp_replace(regexp_extract(key, '[^/]+$', 0), '(.)\.[^.]+$', '\1')) as dir from files"))
def _(spark, sf_dir):
    return derived.files(spark, sf_dir).select("key", paths.safe_dir("key").alias("dir"))


@query("x5_image_key", sql_with("artifacts", "images", body="select key, size from images"))
def _(spark, sf_dir):
    return derived.images(spark, sf_dir)


@query(
    "x6_content_type",
    sql_with(
        "files",
        body="""select key, case lower(regexp_extract(key, '\\.[^./]+$', 0)) when '.pdf' then 'application/pdf' when '.jpg' then 'image/jpeg'
          when '.jpeg' then 'image/jpeg' when '.tiff' then 'image/tiff' when '.txt' then 'text/plain' else 'image/png' end as content_type
          from files""",
    ),
)
def _(spark, sf_dir):
    return derived.files(spark, sf_dir).select("key", paths.content_type("key").alias("content_type"))


@query(
    "x7_bundle_folder",
    r"""select doc_id, left(regexp_replace(replace(replace(text, '/', '-'), chr(10), ' '), '(.)\.[^.]+$', '\1'), 80) as folder
      from documents""",
)
def _(spark, sf_dir):
    # Whole texts serve as overlong file names.
    name = F.translate("text", "/\n", "- ")
    return derived.table(spark, sf_dir, "documents").select("doc_id", paths.bundle_folder(name).alias("folder"))


@query("x8_bundle_name", "select event_id, concat('ocr_results_', strftime(ts, '%Y%m%d_%H%M%S')) as bundle from events")
def _(spark, sf_dir):
    return derived.table(spark, sf_dir, "events").select("event_id", paths.bundle_name("ts").alias("bundle"))


@query(
    "x9_job_id",
    sql_with("files", body=f"""select key, sha256(concat('{{"p0":"', key, '","p1":"{AS_OF}"}}')) as job_id from files"""),
)
def _(spark, sf_dir):
    return derived.files(spark, sf_dir).select("key", paths.job_id("key", F.lit(AS_OF)).alias("job_id"))


@query("p16_source_kind", "select page_id, url, case when contains(lower(url), '.pdf') then 'pdf' else 'image' end as kind from pages union all select doc_id as page_id, key as url, case when contains(lower(key), '.pdf') then 'pdf' else 'image' end as kind from (" + derived.FILES + ")")
def _(spark, sf_dir):
    from folioflow.functions import fmt

    urls = derived.table(spark, sf_dir, "pages").select("page_id", "url")
    keys = derived.files(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.col("key").alias("url"))
    return urls.unionByName(keys).withColumn("kind", fmt.source_kind("url"))


@query("t15_utf8", "select doc_id, octet_length(encode(text)) as bytes, md5(text) as digest, text as decoded, concat(text, chr(65533)) as lossy from documents")
def _(spark, sf_dir):
    body = derived.table(spark, sf_dir, "documents").select("doc_id", text.encode_utf8("text").alias("body"))
    broken = F.concat("body", F.to_binary(F.lit("ff"), F.lit("hex")))
    return body.select(
        "doc_id",
        F.octet_length("body").cast("long").alias("bytes"),
        F.md5("body").alias("digest"),
        text.decode_utf8("body").alias("decoded"),
        text.decode_utf8_lossy(broken).alias("lossy"),
    )
