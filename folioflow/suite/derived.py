"""Job, file, layout and result tables derived from the driver's tables, and the same as SQL.

The driver ships no job registry; these views give every operator input that grows with the
tables.  ``SQL`` holds one common-table expression per view, equal to the DataFrame beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import paths

SOURCE_PREFIX, TARGET_PREFIX = "in/", "out/"
AS_OF = "2024-01-31 00:00:00"

#: Characters the clean-up operators must deal with; plain in both dialects, as ``chr`` differs.
INVISIBLE = "\u200b\ufeff\u0007\ttail"
ARABIC_TAIL = "\n\u0645\u0631\u062d\u0628\u0627 \ufefb \ufef5\n"

FILES = """
  select concat('in/', source, '/f', cast(doc_id as string),
    case doc_id % 8 when 0 then '.pdf' when 1 then '.PNG' when 2 then '.jpg' when 3 then '.jpeg'
         when 4 then '.tiff' when 5 then '.txt' when 6 then '.v1.pdf' else '' end) as key,
    n_chars * 256 as size, doc_id
  from documents"""

JOBS = """
  select concat('job-', cast(e.event_id as string)) as job_id, f.key as file_key, f.size as file_size,
    case e.event_type when 'signup' then 'pending' when 'view' then 'running' when 'purchase' then 'success'
         when 'error' then 'failed' else 'skipped' end as status,
    e.ts as submitted_at,
    case when e.event_type = 'signup' or e.event_id % 97 = 0 then null else e.ts + interval '3' minute end as started_at,
    case when e.event_type in ('purchase','error','click') then e.ts + interval '9' minute end as completed_at,
    case when e.event_type = 'purchase' then cast(e.event_id % 7 as int) end as page_count,
    case when e.event_type = 'error' then repeat('engine failed; ', cast(1 + e.event_id % 30 as int)) end as error,
    case when e.event_type = 'purchase' then concat('out/', f.source, '/f', cast(f.doc_id as string),
         case when f.doc_id % 8 = 6 then '.v1' else '' end, '.md') end as target_key,
    case e.event_id % 3 when 0 then 'arabic' when 1 then '' else null end as lang,
    case e.event_id % 5 when 0 then 'auto' when 1 then 'always' when 2 then 'never' when 3 then '' end as arabic_bidi_fix,
    case e.event_id % 4 when 0 then 'pipeline' when 1 then 'vlm-auto-engine' when 2 then 'hybrid-auto-engine' end as backend
  from events e join (select files.*, d.source from files join documents d using (doc_id)) f on f.doc_id = e.user_id"""

MIDDLE = """
  select event_id, user_id, case when event_id % 11 = 0 then 'bad{' when event_id % 13 = 0 then '{"x":1}'
    else concat('{"pdf_info":[', regexp_replace(repeat('{},', cast(event_id % 6 as int)), ',$', ''), ']}') end as middle_json
  from events"""

ARTIFACTS = f"""
  select doc_id, concat('out/', source, '/f', cast(doc_id as string), case when doc_id % 8 = 6 then '.v1' else '' end, '.md')
      as target_key,
    concat(case when doc_id % 3 = 0 then concat('![fig](images/', cast(doc_id as string), '.png) ') else '' end,
           case when doc_id % 5 = 0 then '![w](https://h.example/z.png) ' else '' end,
           text,
           case when doc_id % 4 = 0 then concat(' ![](./images/', cast(doc_id as string), 'b.jpg)') else '' end,
           case when doc_id % 7 = 0 then '{INVISIBLE}' else '' end,
           case when doc_id % 9 = 0 then '{ARABIC_TAIL}' else '' end) as md,
    case doc_id % 3 when 0 then 'arabic' when 1 then 'en' end as lang
  from documents"""

IMAGES = """
  select concat(left(target_key, length(target_key) - 3), '/images/', cast(doc_id as string), '.png') as key, doc_id * 10 as size
  from artifacts where doc_id % 3 = 0
  union all
  select concat(left(target_key, length(target_key) - 3), '/images/', cast(doc_id as string), 'b.jpg') as key, doc_id * 20 as size
  from artifacts where doc_id % 4 = 0"""

_VIEWS = {"files": FILES, "jobs": JOBS, "middle": MIDDLE, "artifacts": ARTIFACTS, "images": IMAGES}
_NEEDS = {"jobs": ("files",), "images": ("artifacts",)}


def sql_with(*names: str, body: str, extra: str = "") -> str:
    """A statement over the named views and ``extra`` ones, all as common-table expressions."""
    ordered: list[str] = []
    for name in names:
        for view in (*_NEEDS.get(name, ()), name):
            if view not in ordered:
                ordered.append(view)
    ctes = [f"{name} as ({_VIEWS[name]})" for name in ordered]
    return f"with {', '.join([*ctes, extra] if extra else ctes)} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(value: Column, cases: dict, default=None) -> Column:
    """``case value when ... end`` over constants."""
    out = None
    for when, then in cases.items():
        then = F.lit(then)
        out = F.when(value == when, then) if out is None else out.when(value == when, then)
    return out.otherwise(F.lit(default)) if default is not None else out


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = _pick(
        F.col("doc_id") % 8, {0: ".pdf", 1: ".PNG", 2: ".jpg", 3: ".jpeg", 4: ".tiff", 5: ".txt", 6: ".v1.pdf"}, ""
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("in/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), ending).alias("key"),
        (F.col("n_chars") * 256).alias("size"),
        "doc_id",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job table: one job per event, on the file of the event's user."""
    events, listed = table(spark, sf_dir, "events"), files(spark, sf_dir)
    kind, number, at = F.col("event_type"), F.col("event_id"), F.col("ts")
    success = kind == "purchase"
    return events.join(listed, events["user_id"] == listed["doc_id"]).select(
        F.concat(F.lit("job-"), number.cast("string")).alias("job_id"),
        F.col("key").alias("file_key"),
        F.col("size").alias("file_size"),
        _pick(kind, {"signup": "pending", "view": "running", "purchase": "success", "error": "failed"}, "skipped").alias("status"),
        at.alias("submitted_at"),
        F.when(~((kind == "signup") | (number % 97 == 0)), at + F.expr("interval 3 minutes")).alias("started_at"),
        F.when(kind.isin("purchase", "error", "click"), at + F.expr("interval 9 minutes")).alias("completed_at"),
        F.when(success, (number % 7).cast("int")).alias("page_count"),
        F.when(kind == "error", F.repeat(F.lit("engine failed; "), (number % 30 + 1).cast("int"))).alias("error"),
        F.when(success, paths.target_key("key", SOURCE_PREFIX, TARGET_PREFIX)).alias("target_key"),
        _pick(number % 3, {0: "arabic", 1: ""}).alias("lang"),
        _pick(number % 5, {0: "auto", 1: "always", 2: "never", 3: ""}).alias("arabic_bidi_fix"),
        _pick(number % 4, {0: "pipeline", 1: "vlm-auto-engine", 2: "hybrid-auto-engine"}).alias("backend"),
    )


def middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout JSON per event: valid, without the key, and broken."""
    number = F.col("event_id")
    entries = F.regexp_replace(F.repeat(F.lit("{},"), (number % 6).cast("int")), ",$", "")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(number % 11 == 0, "bad{")
        .when(number % 13 == 0, '{"x":1}')
        .otherwise(F.concat(F.lit('{"pdf_info":['), entries, F.lit("]}")))
        .alias("middle_json"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted Markdown per document, with images, invisible characters and Arabic lines."""
    doc, number = F.col("doc_id"), F.col("doc_id").cast("string")
    key = F.concat(F.lit("in/"), "source", F.lit("/f"), number, F.when(doc % 8 == 6, ".v1.pdf").otherwise(".pdf"))

    def part(every: int, *pieces: Column) -> Column:
        return F.when(doc % every == 0, F.concat(*pieces)).otherwise(F.lit(""))

    return table(spark, sf_dir, "documents").select(
        "doc_id",
        paths.target_key(key, SOURCE_PREFIX, TARGET_PREFIX).alias("target_key"),
        F.concat(
            part(3, F.lit("![fig](images/"), number, F.lit(".png) ")),
            part(5, F.lit("![w](https://h.example/z.png) ")),
            F.col("text"),
            part(4, F.lit(" ![](./images/"), number, F.lit("b.jpg)")),
            part(7, F.lit(INVISIBLE)),
            part(9, F.lit(ARABIC_TAIL)),
        ).alias("md"),
        _pick(doc % 3, {0: "arabic", 1: "en"}).alias("lang"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image objects the artifacts refer to."""
    made = artifacts(spark, sf_dir).select("doc_id", paths.artifact_prefix("target_key").alias("prefix"))
    doc, number = F.col("doc_id"), F.col("doc_id").cast("string")
    figures = F.array_compact(
        F.array(
            F.when(doc % 3 == 0, F.struct(F.concat(number, F.lit(".png")).alias("name"), (doc * 10).alias("size"))),
            F.when(doc % 4 == 0, F.struct(F.concat(number, F.lit("b.jpg")).alias("name"), (doc * 20).alias("size"))),
        )
    )
    return made.select("prefix", F.explode(figures).alias("f")).select(
        paths.image_key("prefix", F.col("f.name")).alias("key"), F.col("f.size").alias("size")
    )
