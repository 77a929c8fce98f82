"""Writes whose failure shows, registry commits that do not overwrite each other, and complete listings."""

import sys

import pytest
from helpers import by
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folioflow.operators import registry
from folioflow.operators.extraction import Extracted
from folioflow.plans import runs
from folioflow.plans.submission import Defaults
from folioflow.sources import artifacts, catalog, jobs
from folioflow.sources.objects import from_inventory, list_objects, persistently, put_objects


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fill(root, **objects):
    for name, body in objects.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return str(root)


def extractor(content, name, lang, backend):
    return Extracted(content.decode(), '{"pdf_info": [1, 2]}', (("a/b", b"image"),) if name == "odd.pdf" else (("i.png", b"image"),))


@pytest.fixture
def blocked(tmp_path):
    """Three documents, and a target folder in which one of the results cannot be written."""
    store = fill(tmp_path / "store", **{"in/good.pdf": "one", "in/bad.pdf": "two", "in/notes.txt": "x"})
    (tmp_path / "out/res/bad.md").mkdir(parents=True)
    (tmp_path / "out/res/bad.md/taken").write_text("")
    return store, str(tmp_path / "out")


def test_a_lost_write_fails_its_document_and_no_other(spark, blocked, tmp_path):
    store, out = blocked
    done = runs.run_batch(catalog.documents(spark, store, "in/"), extractor, "in/", "res/").delivered(out, retries=0)
    got = by(done.results, "file_key")
    assert (got["in/good.pdf"]["status"], got["in/good.pdf"]["error"]) == ("success", None)
    assert got["in/bad.pdf"]["status"] == "failed" and got["in/bad.pdf"]["error"].startswith("cannot write res/bad.md: ")
    assert got["in/bad.pdf"]["page_count"] == 2
    assert done.summary.first().asDict() == {"total": 3, "success": 1, "failed": 1, "skipped": 1}
    assert (tmp_path / "out/res/good.md").read_text() == "one" and (tmp_path / "out/res/good/images/i.png").read_bytes() == b"image"


def test_a_lost_write_fails_its_job(spark, blocked, make_jobs):
    store, out = blocked
    table = make_jobs({"job_id": "g", "file_key": "in/good.pdf"}, {"job_id": "b", "file_key": "in/bad.pdf"}, {"job_id": "n", "file_key": "in/notes.txt"})
    run = runs.run_pending(table, catalog.list_files(spark, store), extractor, "2024-01-03 00:00:00", "2024-01-03 00:01:00", Defaults("ch", "never", "pipeline"), "in/", "res/", root=store)
    got = by(registry.apply_updates(table, run.delivered(out, retries=0)), "job_id")
    assert (got["g"]["status"], got["g"]["target_key"], got["g"]["error"]) == ("success", "res/good.md", None)
    assert (got["b"]["status"], got["b"]["target_key"], got["b"]["page_count"]) == ("failed", None, 2)
    assert got["b"]["error"].startswith("cannot write res/bad.md: ")


def test_passing_failures_are_tried_again():
    left = [OSError("throttled"), OSError("throttled")]

    def action():
        if left:
            raise left.pop()
        return "done"

    assert persistently(action, 3, 0) == "done" and not left
    left += [OSError("x")] * 5
    with pytest.raises(OSError):
        persistently(action, 3, 0)
    left[:] = [FileNotFoundError("gone")]
    with pytest.raises(FileNotFoundError):
        persistently(action, 3, 0)
    assert not left


def test_no_name_is_left_out_of_a_listing(spark, tmp_path):
    names = ["a.pdf", "_arch/b.pdf", ".c/d.pdf", "_e.pdf", "x/.f.pdf", "x/y/z/deep.pdf"]
    store = fill(tmp_path / "s", **dict.fromkeys(names, "1"))
    put_objects(spark.createDataFrame([("x/new.md", "text")], "key string, md string"), store, "key", "md").collect()
    assert sorted(r.key for r in catalog.list_files(spark, store).collect()) == sorted(names)
    assert sorted(r.key for r in catalog.all_files(spark, store).collect()) == sorted([*names, "x/new.md"])
    assert sorted(r.key for r in catalog.list_files(spark, store, "x/").collect()) == ["x/.f.pdf", "x/y/z/deep.pdf"]
    assert list_objects(spark, store, ["absent"]).count() == 0
    assert from_inventory(spark.createDataFrame([("a/x", 1), ("b", 2)], "key string, size int"), "a/").count() == 1


def test_wide_trees_go_to_tasks_by_sub_tree(spark, tmp_path):
    names = [f"d{k}/e/f{k}.pdf" for k in range(40)]
    store = fill(tmp_path / "s", **dict.fromkeys(names, "1"))
    assert sorted(r.key for r in catalog.list_files(spark, store).collect()) == sorted(names)


def test_stored_uploads_report_what_was_written(spark, tmp_path):
    uploads = spark.createDataFrame([("a.pdf", bytearray(b"12")), ("b.txt", bytearray(b"1"))], "name string, content binary")
    got = by(catalog.store_uploads(uploads, str(tmp_path), "in/"), "name")
    assert (got["a.pdf"]["key"], got["a.pdf"]["size"], got["a.pdf"]["error"]) == ("in/a.pdf", 2, None)
    assert (got["b.txt"]["size"], got["b.txt"]["error"]) == (None, "Unsupported format: .txt")
    assert (tmp_path / "in/a.pdf").read_bytes() == b"12" and not (tmp_path / "in/b.txt").exists()


def test_unreadable_is_not_absent(spark, tmp_path, monkeypatch):
    root = fill(tmp_path, **{"d1/d1/d1.md": "text", "d1/d1/d1_middle.json": '{"pdf_info": [1]}', "d2/x.txt": ""})
    (tmp_path / "d3/d3").mkdir(parents=True)
    (tmp_path / "d3/d3/d3.md").write_bytes(b"\xff\xfe")
    (tmp_path / "d3/d3/d3_middle.json").symlink_to(tmp_path / "nowhere")
    work = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "folder string")
    md = by(artifacts.work_markdown(spark, root, work), "folder")
    assert (md["d1"]["md"], md["d1"]["error"]) == ("text", None)
    assert md["d2"]["error"] == "no Markdown output below d2" and md["d3"]["error"] == "not UTF-8: d3/d3/d3.md"
    pages = {r.folder: (r.page_count, r.error is None) for r in artifacts.work_page_counts(spark, root, work).collect()}
    assert pages["d1"] == (1, True) and pages["d2"] == (0, True) and pages["d3"] in ((None, False), (0, True))


def test_a_table_on_disk_is_never_overwritten(spark, make_jobs, tmp_path):
    root = str(tmp_path / "jobs")
    jobs.save_jobs(make_jobs({"job_id": "a", "file_key": "x"}), root)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        jobs.save_jobs(jobs.load_jobs(spark, root).limit(0), root)
    assert jobs.load_jobs(spark, root).count() == 1


def test_duplicates_fail_whatever_is_selected(spark, make_jobs):
    table = make_jobs({"job_id": "a", "file_key": "x"})
    again = table.select("job_id", "file_key", "file_size", "submitted_at")
    for look in (lambda d: d.count(), lambda d: d.select("file_key").collect()):
        with pytest.raises(Exception, match="duplicate job_id"):
            look(registry.insert(table, again))
    twice = spark.createDataFrame([("a", "failed"), ("a", "success")], "job_id string, status string")
    doubled = registry.apply_updates(table, twice)
    with pytest.raises(Exception, match="several updates"):
        doubled.select("job_id", "status").collect()
    assert doubled.count() == 1


def test_first_stuck_tick_counts(spark, make_jobs):
    table = make_jobs({"job_id": "a", "file_key": "x", "status": "running", "started_at": "2024-01-01T00:00:00+00:00"}, {"job_id": "n", "file_key": "y", "status": "running"})
    at = [f"2024-01-01 0{h}:00:00" for h in (1, 3, 6)]
    ticks = spark.createDataFrame([(at,)], "t array<string>").select(F.transform("t", lambda x: x.cast("timestamp")).alias("ticks"))
    got = {r.job_id: str(r.completed_at) for r in registry.first_stuck(table, ticks).collect()}
    assert got == {"a": at[1], "n": at[0]}


def test_a_run_folder_goes_with_its_block(spark):
    import os

    from folioflow.session import materialise, run_folder

    with run_folder(spark, "trial") as path:
        assert materialise(spark.range(3), "x").count() == 3
        assert os.listdir(path)
    assert not os.path.exists(path)
