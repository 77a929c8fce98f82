"""Keyed state with timers against the same rules applied to whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.streaming import stateful, streams


def stamp(minute):
    return f"2024-01-{1 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00"


def fed(spark, tmp_path, rows, kinds, parts, run):
    """Rows (minute first) in time order, ``parts`` micro-batches, each a run of its own."""
    source = str(tmp_path / "source")
    rows, size = sorted(rows), -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        frame = spark.createDataFrame([(stamp(r[0]), *r[1:]) for r in rows[k : k + size]], "at string, " + kinds)
        frame.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        run(streams.read_stream(spark, source, spark.read.parquet(source).schema))


def admitted(rows, delay):
    out, until = [], {}
    for minute, key, ended in sorted(rows, key=lambda r: (r[0], r[1], not r[2])):
        if ended:
            until.pop(key, None)
        elif minute >= until.get(key, -1):
            until[key] = minute + delay
            out.append((key, stamp(minute)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4])
def test_guard_admits_again_after_the_end_or_the_delay(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(900), rng.choice("abc"), rng.random() < 0.2) for _ in range(150)] + [(0, "hot", False)] * 200
    out, progress = str(tmp_path / "out"), str(tmp_path / "p")
    fed(spark, tmp_path, rows, "file_key string, done boolean", parts, lambda s: stateful.run_states(stateful.guarded_until_done(s, F.col("done"), 2), progress, out))
    got = sorted((r.file_key, str(r.at)) for r in spark.read.parquet(out).collect())
    assert got == admitted(rows, 120)


@pytest.mark.parametrize("parts", [1, 4])
def test_sweep_fails_each_start_once_at_its_limit(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = sorted({(m, j): (m, j, s) for m, j, s in ((rng.randrange(1500), rng.choice("abcdef"), rng.choice(["running", "running", "success", "failed"])) for _ in range(70))}.values())
    rows.append((1600, "z", "success"))
    out, progress = str(tmp_path / "out"), str(tmp_path / "p")
    fed(spark, tmp_path, rows, "job_id string, status string", parts, lambda s: stateful.run_states(stateful.sweep_by_timers(s, 2), progress, out))
    want = []
    for i, (minute, job, status) in enumerate(rows):
        later = [m for m, j, _ in rows[i + 1 :] if j == job]
        if status == "running" and ((later and later[0] > minute + 120) or (not later and minute + 120 < 1600)):
            want.append((job, stamp(minute), stamp(minute + 120)))
    got = sorted((r.job_id, str(r.started_at), str(r.failed_at)) for r in spark.read.parquet(out).collect())
    assert got == sorted(want) and want


@pytest.mark.parametrize("stop", [False, True])
def test_state_holds_the_last_status_of_each_job(spark, tmp_path, stop):
    rng = random.Random(7)
    rows = [(rng.randrange(500), rng.choice("abcd"), rng.choice(["pending", "running", "success", "failed"]), k) for k in range(60)]
    progress = str(tmp_path / "p")
    fed(spark, tmp_path, rows, "job_id string, status string, n int", 3, lambda s: stateful.run_states(stateful.status_changes(s, F.col("n"), stop), progress, mode="update"))
    want = {}
    for minute, job, status, n in sorted(rows, key=lambda r: (r[0], r[3])):
        if not (stop and want.get(job, ("",))[0] in ("success", "failed", "skipped")):
            want[job] = (status, stamp(minute))
    assert {r.job_id: (r.status, str(r.at)) for r in stateful.held_status(spark, progress).collect()} == want


def test_rows_without_key_or_time_are_left_out(spark, tmp_path):
    frame = spark.createDataFrame([(None, "a"), ("2024-01-01 00:00:00", None), ("2024-01-01 00:00:00", "b")], "at string, file_key string")
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    frame.withColumn("at", F.col("at").cast("timestamp")).write.parquet(source)
    stream = streams.read_stream(spark, source, spark.read.parquet(source).schema)
    stateful.run_states(stateful.guarded_until_done(stream, F.lit(None).cast("boolean"), 1), str(tmp_path / "p"), out)
    assert [r.file_key for r in spark.read.parquet(out).collect()] == ["b"]
