import pytest
from helpers import by
from pyspark.sql import functions as F

from folioflow.operators import registry
from folioflow.schemas import JOB_SCHEMA, align_jobs
from folioflow.sources.jobs import load_jobs, save_jobs


def test_latest_per_key_and_its_tie_break(make_jobs):
    jobs = make_jobs(
        {"job_id": "a1", "file_key": "a", "submitted_at": "2024-01-02T00:00:00+00:00", "status": "failed"},
        {"job_id": "a2", "file_key": "a", "submitted_at": "2024-01-01T00:00:00+00:00"},
        {"job_id": "b1", "file_key": "b"},
        {"job_id": "b2", "file_key": "b", "error": "x"},
    )
    got = by(registry.latest_per_key(jobs), "file_key")
    assert {k: v["job_id"] for k, v in got.items()} == {"a": "a1", "b": "b2"}
    assert got["b"]["error"] == "x" and got["a"]["status"] == "failed"
    keys = jobs.where("file_key = 'a'").select("file_key")
    assert [r["job_id"] for r in registry.latest_for_keys(jobs, keys.union(keys)).collect()] == ["a1"]


def test_orders_limits_and_lookups(make_jobs):
    jobs = make_jobs(*[{"job_id": f"j{i}", "file_key": "k", "submitted_at": f"2024-01-0{i}T00:00:00+00:00"} for i in (2, 1, 3)])
    assert [r["job_id"] for r in registry.newest_first(jobs).collect()] == ["j3", "j2", "j1"]
    assert [r["job_id"] for r in registry.unfinished(jobs).collect()] == ["j1", "j2", "j3"]
    assert [tuple(r) for r in registry.recent(jobs, 2, "job_id").collect()] == [("j3",), ("j2",)]
    assert registry.get_job(jobs, "j2").count() == 1 and registry.get_job(jobs, "none").count() == 0


def test_insert_is_pending_and_refuses_known_and_repeated_ids(make_jobs):
    jobs = make_jobs({"job_id": "a", "file_key": "x", "status": "running"})
    rows = make_jobs({"job_id": "b", "file_key": "y", "file_size": 7, "lang": "ch", "status": "success"})
    rows = rows.select("job_id", "file_key", "file_size", "submitted_at", "lang")
    new = by(registry.insert(jobs, rows), "job_id")["b"]
    assert (new["status"], new["lang"], new["file_size"], new["started_at"], new["page_count"]) == ("pending", "ch", 7, None, None)
    for clash in (rows.withColumn("job_id", F.lit("a")), rows.union(rows)):
        with pytest.raises(Exception, match="duplicate job_id"):
            registry.insert(jobs, clash).collect()
    kept = registry.insert_new(jobs, rows.withColumn("job_id", F.lit("a")))
    assert [r["status"] for r in kept.collect()] == ["running"]


def test_update_writes_nulls_ignores_unknown_fields_and_leaves_others(spark, make_jobs):
    jobs = make_jobs({"job_id": "a", "file_key": "x", "error": "old"}, {"job_id": "b", "file_key": "y", "error": "old"})
    updates = spark.createDataFrame([("a", None, "z", 9)], "job_id string, error string, file_key string, file_size bigint")
    got = by(registry.apply_updates(jobs, updates), "job_id")
    assert got["a"]["error"] is None and got["a"]["file_key"] == "x" and got["a"]["file_size"] == 0
    assert got["b"]["error"] == "old"
    assert registry.apply_updates(jobs, updates.select("job_id", "file_key")) is jobs


def test_updates_fold_in_order_per_field(spark, make_jobs):
    jobs = make_jobs({"job_id": "a", "file_key": "x", "error": "old"})
    rows = [("a", 3, "failed", True, "late", False), ("a", 1, "running", True, "first", True), ("a", 2, "success", True, None, True)]
    updates = spark.createDataFrame(rows, "job_id string, seq int, status string, set_status boolean, error string, set_error boolean")
    got = by(registry.update(jobs, updates, "seq"), "job_id")["a"]
    assert (got["status"], got["error"]) == ("failed", None)


def test_delete_counts_rows_really_removed(spark, make_jobs):
    jobs = make_jobs(*[{"job_id": j, "file_key": "x"} for j in "abc"])
    ids = spark.createDataFrame([("a",), ("a",), ("zz",)], "id string")
    assert registry.deleted_count(jobs, ids).first()["deleted"] == 1
    assert sorted(r["job_id"] for r in registry.delete(jobs, ids).collect()) == ["b", "c"]
    assert registry.deleted_count(jobs, ids.where("false")).first()["deleted"] == 0


def test_conflicts(spark, make_jobs):
    jobs = make_jobs({"job_id": "a", "file_key": "x", "status": "running"}, {"job_id": "b", "file_key": "y"})
    keys = spark.createDataFrame([("x",), ("y",), ("z",)], "file_key string")
    assert [r[0] for r in registry.conflicts(keys, jobs).collect()] == ["x"]
    assert sorted(r[0] for r in registry.conflicts(keys, jobs, "running", "pending").collect()) == ["x", "y"]


NOW = "2024-01-01 10:00:00"


def test_sweep_is_strict_and_touches_running_jobs_only(make_jobs):
    jobs = make_jobs(
        {"job_id": "never", "file_key": "x", "status": "running"},
        {"job_id": "exact", "file_key": "x", "status": "running", "started_at": "2024-01-01T08:00:00+00:00"},
        {"job_id": "late", "file_key": "x", "status": "running", "started_at": "2024-01-01T07:59:59.999999+00:00"},
        {"job_id": "pending", "file_key": "x"},
        {"job_id": "done", "file_key": "x", "status": "success", "started_at": "2023-01-01T00:00:00+00:00"},
    )
    got = by(registry.sweep(jobs, NOW), "job_id")
    assert {k: v["status"] for k, v in got.items()} == {
        "never": "failed", "exact": "running", "late": "failed", "pending": "pending", "done": "success",
    }
    assert got["never"]["error"] == "Task stuck: no started_at timestamp"
    assert got["late"]["error"] == "Task stuck for more than 2.0 hours, automatically marked as failed"
    assert str(got["late"]["completed_at"]) == NOW and got["exact"]["completed_at"] is None
    as_log = by(registry.apply_updates(jobs, registry.stuck_updates(jobs, NOW)), "job_id")
    assert as_log == got


def test_recovery(make_jobs):
    jobs = make_jobs(
        {"job_id": "a", "file_key": "x", "status": "running", "submitted_at": "2024-01-02T00:00:00+00:00"},
        {"job_id": "b", "file_key": "x"},
        {"job_id": "c", "file_key": "x", "status": "failed"},
    )
    assert [(r["job_id"], r["status"]) for r in registry.recovery_queue(jobs).collect()] == [("b", "pending"), ("a", "pending")]
    assert registry.recover(jobs).where("status = 'failed'").count() == 1


def test_options_treat_empty_as_absent(make_jobs):
    jobs = make_jobs({"job_id": "a", "file_key": "x", "lang": "", "backend": "vlm-auto-engine"})
    got = registry.with_options(jobs, "ch", "auto", "pipeline").first()
    assert (got["lang"], got["arabic_bidi_fix"], got["backend"]) == ("ch", "auto", "vlm-auto-engine")


def test_older_tables_gain_the_new_columns(spark):
    old = spark.createDataFrame([("a", "x", 1)], "job_id string, file_key string, n int").withColumn(
        "submitted_at", F.lit("2024-01-01").cast("timestamp")
    )
    got = align_jobs(old)
    assert got.columns == [f.name for f in JOB_SCHEMA.fields]
    assert (got.first()["status"], got.first()["file_size"], got.first()["backend"]) == ("pending", 0, None)


def test_tables_derive_from_one_another(spark, make_jobs, tmp_path):
    root = str(tmp_path / "jobs")
    save_jobs(make_jobs({"job_id": "a", "file_key": "x", "status": "running"}), root)
    save_jobs(registry.recover(load_jobs(spark, root)), root + "-next")
    root += "-next"
    assert load_jobs(spark, root).first()["status"] == "pending"
