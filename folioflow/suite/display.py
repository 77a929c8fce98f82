"""Number, date and layout format queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import fmt
from folioflow.suite import derived
from folioflow.suite.derived import AS_OF, sql_with
from folioflow.suite import query
from folioflow.suite.views import SIZE_SQL

#: Sizes from bytes to terabytes, derived from every order.
SIZES_SQL = "sizes as (select o_orderkey, cast(o_orderkey as bigint) * o_orderkey * (o_custkey + 1) as size from orders)"


def _sizes(spark, sf_dir):
    """The product outgrows a long from some million orders on, a decimal holds it exactly."""
    key, customer = (F.col(c).cast("decimal(19,0)") for c in ("o_orderkey", "o_custkey"))
    return derived.table(spark, sf_dir, "orders").select("o_orderkey", (key * key * (customer + 1)).alias("size"))


@query(
    "n1_report_size",
    f"""with {SIZES_SQL} select o_orderkey, case when size < 1024 then format('{{:.1f}} B', size / 1)
      when size < 1048576 then format('{{:.1f}} KB', size / 1024) when size < 1073741824 then format('{{:.1f}} MB', size / 1048576)
      when size < 1099511627776 then format('{{:.1f}} GB', size / 1073741824) else format('{{:.1f}} TB', size / 1099511627776) end as size_text
      from sizes""",
)
def _(spark, sf_dir):
    return _sizes(spark, sf_dir).select("o_orderkey", fmt.report_size("size").alias("size_text"))


@query("n2_listing_size", f"with {SIZES_SQL} select o_orderkey, {SIZE_SQL.format('size')} as size_text from sizes")
def _(spark, sf_dir):
    return _sizes(spark, sf_dir).select("o_orderkey", fmt.listing_size("size").alias("size_text"))


@query(
    "n3_listing_duration",
    """with spans as (select event_id, ts as started_at, case when event_type = 'signup' then null
        when event_type = 'error' then ts - interval '1' second else ts + to_microseconds(event_id * 1237) end as completed_at from events),
      ms as (select event_id, epoch_us(completed_at) // 1000 - epoch_us(started_at) // 1000 as d from spans)
      select event_id, case when d is null or d < 0 then '—'
        when d % 1000 in (250, 750) then concat(format('{:.1f}', (d + 50) / 1000), 's') else format('{:.1f}s', d / 1000) end as duration from ms""",
)
def _(spark, sf_dir):
    events = derived.table(spark, sf_dir, "events")
    later = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") * 1237 / F.lit(1e6)).cast("decimal(18,6)"))
    kind = F.col("event_type")
    ended = F.when(kind == "signup", None).when(kind == "error", F.col("ts") - F.expr("interval 1 second")).otherwise(later)
    return events.select("event_id", fmt.listing_duration("ts", ended).alias("duration"))


@query("n4_report_duration", "select l_orderkey, l_linenumber, format('{:.2f}s', us / 1e6) as duration from (select *, (l_orderkey * 10007 + l_partkey * 5000) % 400000000 as us from lineitem)")
def _(spark, sf_dir):
    duration_us = (F.col("l_orderkey") * 10007 + F.col("l_partkey") * 5000) % 400_000_000
    return derived.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fmt.report_duration(duration_us).alias("duration"))


@query("n5_short_key", sql_with("artifacts", body="select target_key, case when length(k) > 28 then concat('...', right(k, 25)) else k end as shown from (select target_key, concat('archive/2024/', target_key) as k from artifacts)"))
def _(spark, sf_dir):
    key = F.concat(F.lit("archive/2024/"), "target_key")
    return derived.artifacts(spark, sf_dir).select("target_key", fmt.short_key(key).alias("shown"))


@query(
    "n6_report_line",
    sql_with(
        "files",
        body="""select doc_id, concat(key, repeat(' ', greatest(0, 30 - length(key))), ' ', case when length(s) < 8 then lpad(s, 8, ' ') else s end, ' ',
          lpad(cast(doc_id % 50 as varchar), 6, ' '), ' ', lpad('1.00s', 10, ' '), ' success') as line from (select *, cast(size as varchar) as s from files)""",
    ),
)
def _(spark, sf_dir):
    size, pages = F.col("size").cast("string"), F.col("doc_id") % 50
    line = fmt.report_line(F.col("key"), size, pages, F.lit("1.00s"), F.lit("success"))
    return derived.files(spark, sf_dir).select("doc_id", line.alias("line"))


@query("n7_error_line", sql_with("jobs", body="select job_id, case when error <> '' then concat('  Error: ', error) end as line from jobs"))
def _(spark, sf_dir):
    return derived.jobs(spark, sf_dir).select("job_id", fmt.error_line("error").alias("line"))


@query("n8_parse_iso", "select event_id, case when event_type <> 'error' then epoch_us(ts) end as micros from events")
def _(spark, sf_dir):
    events = derived.table(spark, sf_dir, "events")
    iso = F.when(F.col("event_type") == "error", "not a time").otherwise(fmt.iso_utc("ts"))
    return events.select("event_id", F.unix_micros(fmt.parse_iso(iso)).alias("micros"))


@query("n9_iso_text", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as iso from events")
def _(spark, sf_dir):
    return derived.table(spark, sf_dir, "events").select("event_id", fmt.iso_utc("ts").alias("iso"))


@query("n10_local_date", "select event_id, case when event_type = 'error' then '—' else strftime(ts + interval '8' hour, '%Y/%-m/%-d %H:%M:%S') end as local from events")
def _(spark, sf_dir):
    at = F.when(F.col("event_type") != "error", F.col("ts"))
    return derived.table(spark, sf_dir, "events").select("event_id", fmt.listing_date(at, "Asia/Shanghai").alias("local"))


@query(
    "n11_elapsed_hours",
    f"""select event_id, (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 1e6 / 3600 as hours,
      format('{{:.1f}}', (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 1e6 / 3600) as hours_text from events""",
)
def _(spark, sf_dir):
    events = derived.table(spark, sf_dir, "events")
    now = F.lit(AS_OF).cast(events.schema["ts"].dataType)
    return events.select(
        "event_id", fmt.elapsed_hours("ts", now).alias("hours"), fmt.elapsed_hours_text("ts", now).alias("hours_text")
    )


PAGES_SQL = "case when event_id % 11 = 0 or event_id % 13 = 0 then 0 else event_id % 6 end"


@query("n12_page_count", f"select event_id, cast({PAGES_SQL} as int) as page_count from events")
def _(spark, sf_dir):
    return derived.middle(spark, sf_dir).select("event_id", fmt.page_count("middle_json").alias("page_count"))
