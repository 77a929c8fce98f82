import pytest
from helpers import by
from pyspark.sql import functions as F

from folioflow.operators import registry
from folioflow.streaming import streams


def put(root, *names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")


def test_discovery_sees_each_file_once_across_restarts(spark, make_jobs, tmp_path):
    root, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    jobs = make_jobs({"job_id": "1", "file_key": "a/known.pdf"})

    def run(*times):
        streams.discover_on_ticks(ticks(spark, str(tmp_path / "ticks"), *times), str(root), lambda: jobs, out, progress)
        return sorted(r["file_key"] for r in spark.read.option("recursiveFileLookup", True).parquet(out).collect())

    put(root, "a/known.pdf", "a/new.pdf", "a/readme.txt", "_hidden/.x/_y.pdf")
    assert run("2024-01-05 00:00:00") == ["_hidden/.x/_y.pdf", "a/new.pdf"]
    assert run() == ["_hidden/.x/_y.pdf", "a/new.pdf"]
    put(root, "b/later.png")
    assert run("2024-01-05 00:05:00", "2024-01-05 00:10:00") == ["_hidden/.x/_y.pdf", "a/new.pdf", "b/later.png"]
    new = registry.insert(jobs, spark.read.option("recursiveFileLookup", True).parquet(out))
    assert new.where("status = 'pending'").count() == 4


def test_log_and_base_give_the_same_table_as_single_updates(spark, make_jobs, tmp_path):
    base = make_jobs({"job_id": "a", "file_key": "x"}, {"job_id": "b", "file_key": "y"})
    rows = [("a", 1, "running"), ("a", 2, "success"), ("b", 1, "running")]
    source = str(tmp_path / "source")
    for row in rows:
        spark.createDataFrame([row], "job_id string, seq int, status string").write.mode("append").parquet(source)
    stream = streams.read_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    out = str(tmp_path / "log")
    streams.run_to_end(stream, out, str(tmp_path / "progress"))
    got = by(streams.current_jobs(base, spark.read.parquet(out), "seq"), "job_id")
    assert {k: v["status"] for k, v in got.items()} == {"a": "success", "b": "running"}


def test_watching_stops_at_the_first_terminal_state(spark):
    rows = [("a", 1, "running"), ("a", 2, "failed"), ("a", 3, "pending"), ("b", 1, "pending"), ("b", 2, "running")]
    events = spark.createDataFrame(rows, "job_id string, at int, status string")
    got = by(streams.watched_status(events, "at"), "job_id")
    assert (got["a"]["status"], got["a"]["terminal"], got["b"]["status"], got["b"]["terminal"]) == ("failed", True, "running", False)


def ticks(spark, path, *times):
    for at in times:
        spark.createDataFrame([(at,)], "at string").select(F.col("at").cast("timestamp")).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


def test_sweep_marks_jobs_as_ticks_pass_and_replay_changes_nothing(spark, make_jobs, tmp_path):
    jobs = make_jobs(
        {"job_id": "early", "file_key": "x", "status": "running", "started_at": "2024-01-01T00:00:00+00:00"},
        {"job_id": "late", "file_key": "x", "status": "running", "started_at": "2024-01-01T03:00:00+00:00"},
    )
    source, log = str(tmp_path / "ticks"), str(tmp_path / "log")

    def state():
        updates = spark.read.option("recursiveFileLookup", True).parquet(log)
        return {k: v["status"] for k, v in by(streams.current_jobs(jobs, updates, "seq"), "job_id").items()}

    streams.sweep_on_ticks(ticks(spark, source, "2024-01-01 01:00:00", "2024-01-01 03:00:00"), jobs, log, str(tmp_path / "p"))
    assert state() == {"early": "failed", "late": "running"}
    # A lost progress folder replays every batch; each overwrites its own part of the log.
    streams.sweep_on_ticks(ticks(spark, source), jobs, log, str(tmp_path / "p2"))
    assert state() == {"early": "failed", "late": "running"}
    streams.sweep_on_ticks(ticks(spark, source, "2024-01-01 06:00:00"), jobs, log, str(tmp_path / "p"))
    assert state() == {"early": "failed", "late": "failed"}


def test_guard_drops_repeats_within_the_delay(spark, tmp_path):
    source, out = str(tmp_path / "requests"), str(tmp_path / "out")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 01:00:00"), ("c", "2024-01-01 09:00:00"), ("a", "2024-01-01 09:00:00")]
    for key, at in rows:  # a run for each file: files written within one millisecond have no order
        frame = spark.createDataFrame([(key, at)], "file_key string, at string").select("file_key", F.col("at").cast("timestamp").alias("at"))
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, frame.schema)
        streams.run_to_end(streams.guarded_submissions(stream), out, str(tmp_path / "p"))
    got = sorted((r["file_key"], str(r["at"])[11:13]) for r in spark.read.parquet(out).collect())
    assert got == [("a", "00"), ("a", "09"), ("b", "01"), ("c", "09")]


def test_a_crash_in_the_middle_is_resumed_without_loss_or_repeats(spark, tmp_path):
    source, out, progress = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "p")
    for n in range(4):
        spark.createDataFrame([(n,)], "n int").write.mode("append").parquet(source)

    def stream():
        return streams.read_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)

    poisoned = stream().select(F.when(F.col("n") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        streams.run_to_end(poisoned, out, progress)
    assert 0 < spark.read.parquet(out).count() < 4
    streams.run_to_end(stream(), out, progress)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("look_back", [None, 1])
def test_earlier_batches_are_looked_at_as_far_back_as_asked(spark, tmp_path, look_back):
    log = str(tmp_path / "log")
    assert streams._earlier(spark, log, 3, look_back) is None
    for batch in range(4):
        spark.createDataFrame([(batch,)], "n int").write.parquet(f"{log}/batch={batch:012d}")
    assert sorted(r.n for r in streams._earlier(spark, log, 3, look_back).collect()) == ([0, 1, 2] if look_back is None else [2])


def test_a_hot_key_is_reduced_before_the_guard(spark):
    rows = [("hot", f"2024-01-01 00:{k % 60:02d}:00") for k in range(500)] + [("a", "2024-01-01 00:30:00"), ("hot", "2024-01-01 05:00:00")]
    frame = spark.createDataFrame(rows, "file_key string, at string").select("file_key", F.col("at").cast("timestamp").alias("at")).coalesce(1)
    got = sorted((r.file_key, str(r.at)) for r in streams.first_of_batch(frame).collect())
    assert got == [("a", "2024-01-01 00:30:00"), ("hot", "2024-01-01 00:00:00"), ("hot", "2024-01-01 05:00:00")]
