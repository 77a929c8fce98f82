"""What the plans must look like, and that a hot key is reduced before it is shuffled."""

import re

import pytest
from helpers import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioflow import suite
from folioflow.operators import registry
from folioflow.plans import runs, submission, views
from folioflow.suite import derived

#: The only queries that may run Python; all others stay in built-in expressions.
PYTHON = ("t1_", "t5_", "t8_direction_fix", "t9_", "a4_", "e1_", "k1_", "s1_", "s2_", "s5_")

#: These write tables or run streams before they return a plan.
EAGER = ("r", "c2_", "c3_", "k2_", "k4_insert", "k7_", "k8_", "s2_", "s3_", "s5_", "s6_", "s7_", "u2_")

PLAIN = [n for n in suite.QUERIES if not n.startswith(EAGER)]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_its_sql():
    assert set(suite.QUERIES) == set(suite.ORACLE) and set(suite.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_python_only_where_needed(spark, name):
    text = plan(suite.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert bool(re.search("ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas", text)) == name.startswith(PYTHON)


def hot_jobs(spark, rows=200_000):
    """A third of all jobs on one file, written out so that the plan starts at a scan."""
    key = F.when(F.col("id") % 3 == 0, "hot.pdf").otherwise(F.concat(F.lit("f"), F.col("id") % 1000, F.lit(".pdf")))
    return spark.range(0, rows, 1, 8).select(
        F.concat(F.lit("j"), "id").alias("job_id"),
        key.alias("file_key"),
        F.lit(1).cast("bigint").alias("file_size"),
        F.when(F.col("id") % 5 == 0, "running").otherwise("success").alias("status"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("submitted_at"),
    )


def shuffled_rows(spark, frame):
    """Rows written by each shuffle of the executed plan, largest first."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = frame._jdf.queryExecution()
        frame = frame.select("*")
        executed = frame._jdf.queryExecution().executedPlan()
        rows = executed.executeCollect()
        counts = []

        def walk(node):
            metrics = node.metrics()
            if "ShuffleExchange" in node.getClass().getSimpleName():
                counts.append(metrics.apply("shuffleRecordsWritten").value())
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))

        walk(executed)
        assert query is not None and rows is not None
        return sorted(counts, reverse=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize(
    "operator",
    [
        lambda jobs, files: registry.latest_per_key(jobs),
        lambda jobs, files: views.file_listing(files, jobs, show_all=True),
        lambda jobs, files: views.unsubmitted(files, jobs),
        lambda jobs, files: registry.conflicts(files.select(F.col("key").alias("file_key")), jobs),
    ],
)
def test_a_hot_key_is_reduced_before_the_shuffle(spark, tmp_path, operator):
    hot_jobs(spark).write.mode("overwrite").parquet(str(tmp_path / "jobs"))
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    files = jobs.select(F.col("file_key").alias("key"), F.lit(1).cast("bigint").alias("size")).distinct()
    files.write.mode("overwrite").parquet(str(tmp_path / "files"))
    counts = shuffled_rows(spark, operator(jobs, spark.read.parquet(str(tmp_path / "files"))))
    # At most one row per key and map task: 1000 keys and a handful of tasks, against 200,000 rows.
    assert counts and max(counts) <= 10_000


SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "25KB",
    "spark.sql.shuffle.partitions": "32",
}


@pytest.mark.parametrize(
    "operator",
    [
        lambda jobs, files: registry.with_keys(jobs, files.select("key")),
        lambda jobs, files: registry.conflicts(jobs.select("job_id", "file_key"), jobs),
        lambda jobs, files: views.file_sizes(jobs.select("job_id", "file_key"), files),
        lambda jobs, files: submission.decide(
            jobs.select(F.col("job_id").alias("request_id"), "file_key"), files, jobs, derived.AS_OF, submission.Defaults("a", "b", "c")
        ),
        lambda jobs, files: runs.overwritten(jobs.select(F.col("job_id").alias("key"), F.col("file_key").alias("target_key"), F.lit("success").alias("status"))),
    ],
)
def test_the_hot_side_of_a_join_is_split(spark, tmp_path, operator):
    hot_jobs(spark).write.parquet(str(tmp_path / "jobs"))
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    jobs.select(F.col("file_key").alias("key"), F.lit(1).cast("bigint").alias("size")).distinct().write.parquet(str(tmp_path / "files"))
    for key, value in SPLITTING.items():
        spark.conf.set(key, value)
    try:
        frame = operator(jobs, spark.read.parquet(str(tmp_path / "files")))
        counted = frame.agg(*[F.count(c).alias(c) for c in frame.columns])
        counted.collect()
        final = plan(counted).split("Initial Plan")[0]
    finally:
        for key in SPLITTING:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "skew=true" in final


def test_requests_are_shuffled_for_one_join_only(spark):
    """Behind autoBroadcast off: one join on the request side, which adaptive execution can split."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jobs = derived.jobs(spark, SF)
        requests = jobs.select(F.col("job_id").alias("request_id"), "file_key").distinct()
        decided = submission.decide(requests, derived.files(spark, SF), jobs, derived.AS_OF, submission.Defaults("ch", "auto", "pipeline"))
        text = plan(decided)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("LeftOuter") == 1 and text.count("FullOuter") == 1


def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.entry(spark))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("text" not in s and "props" not in s for s in schemas)
    lookup = plan(registry.get_job(spark.read.parquet(f"{SF}/orders.parquet").withColumnRenamed("o_orderstatus", "job_id"), "F"))
    assert "EqualTo(o_orderstatus,F)" in lookup


def test_top_k_needs_no_full_sort(spark):
    text = plan(registry.recent(derived.jobs(spark, SF), 10, "job_id"))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_the_sweep_needs_no_shuffle_of_its_own(spark, make_jobs):
    assert "Exchange" not in plan(registry.sweep(make_jobs({"job_id": "a", "file_key": "x"}), derived.AS_OF))


def test_bucketed_jobs_are_not_shuffled(spark, make_jobs, tmp_path):
    from folioflow.sources import jobs as stored

    rows = [{"job_id": f"{k}", "file_key": f"f{k % 17}", "submitted_at": f"2024-01-01T00:{k % 60:02d}:00+00:00"} for k in range(300)]
    table = stored.save_bucketed(make_jobs(*rows), f"bucketed_{tmp_path.name}", 4, str(tmp_path / "t"))
    latest = registry.latest_per_key(table)
    assert "Exchange" not in latest._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, registry.latest_per_key(make_jobs(*rows)).collect()))
    files = spark.createDataFrame([(f"f{k}", k) for k in range(30)], "key string, size bigint")
    listing = views.file_listing(files.hint("merge"), table, show_all=True)
    listing.collect()
    plan = listing._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 1  # that of the files
