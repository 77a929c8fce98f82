import json
import sys

import pytest
from helpers import by
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folioflow.functions import fmt
from folioflow.operators.extraction import Extracted, UnsupportedFormat, extract
from folioflow.plans import runs
from folioflow.plans.submission import Defaults
from folioflow.sources import artifacts, catalog
from folioflow.sources.objects import fetch_objects, list_objects, put_objects


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fill(root, **files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


def extractor(content, name, lang, backend):
    if b"bad" in content:
        raise ValueError(f"cannot read {name}")
    if b"odd" in content:
        raise UnsupportedFormat("odd one")
    body = content.decode()
    return Extracted(body + "\nﻻ​", json.dumps({"pdf_info": [0] * len(body)}), (("b.png", b"2"), ("a.png", b"1")))


@pytest.fixture
def store(tmp_path):
    return fill(
        tmp_path,
        **{"input/good.pdf": "ok", "input/bad.pdf": "bad", "input/odd.PNG": "odd", "input/notes.txt": "text", "other/file.pdf": "x", "input/sub/a b+%20.jpg": "yes"},
    )


def test_catalog_lists_supported_files_below_a_prefix(spark, store):
    keys = lambda frame: sorted(r["key"] for r in frame.collect())
    assert keys(catalog.list_files(spark, store)) == ["input/bad.pdf", "input/good.pdf", "input/odd.PNG", "input/sub/a b+%20.jpg", "other/file.pdf"]
    assert keys(catalog.list_files(spark, store, "input/")) == ["input/bad.pdf", "input/good.pdf", "input/odd.PNG", "input/sub/a b+%20.jpg"]
    assert keys(catalog.list_files(spark, store, "input/g")) == ["input/good.pdf"]
    assert keys(catalog.list_files(spark, store, "absent/")) == []
    assert by(catalog.all_files(spark, store), "key")["input/notes.txt"]["size"] == 4


def test_an_absent_store_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        catalog.list_files(spark, str(tmp_path / "nowhere"), "in/").collect()


def test_listing_does_not_read_the_files(spark, store):
    plan = catalog.list_files(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_listing_and_fetching_inside_tasks(spark, store):
    listed = list_objects(spark, store, ["input", "other", "absent"])
    assert sorted(r["key"] for r in listed.collect()) == sorted(r["key"] for r in catalog.all_files(spark, store).collect())
    keys = listed.select("key").union(spark.createDataFrame([("gone.pdf",)], "key string"))
    got = by(fetch_objects(keys, store), "key")
    assert bytes(got["input/sub/a b+%20.jpg"]["content"]) == b"yes"
    assert got["gone.pdf"]["content"] is None and got["gone.pdf"]["fetch_error"]


def test_split_and_ingest(spark):
    files = spark.createDataFrame([("a.pdf", 1), ("b.TXT", 2), ("c", 3)], "key string, size bigint")
    got = by(catalog.split_supported(files), "key")
    assert got["a.pdf"]["status"] is None
    assert (got["b.TXT"]["status"], got["b.TXT"]["page_count"], got["b.TXT"]["error"]) == ("skipped", 0, "Unsupported format: .txt")
    assert got["c"]["error"] == "Unsupported format: "
    up = by(catalog.ingest(files.withColumnRenamed("key", "name"), "in/"), "name")
    assert (up["a.pdf"]["key"], up["b.TXT"]["key"], up["b.TXT"]["accepted"]) == ("in/a.pdf", None, False)


@pytest.mark.parametrize("by_key", [False, True])
def test_one_failing_document_never_stops_the_others(spark, store, by_key):
    docs = catalog.documents(spark, store, "input/")
    root = None
    if by_key:
        docs, root = docs.drop("content").union(spark.createDataFrame([("input/gone.pdf", 0)], "key string, size bigint")), store
    got = by(extract(docs, extractor, root), "key")
    assert (got["input/good.pdf"]["status"], got["input/good.pdf"]["md"]) == ("success", "ok\nﻻ​")
    assert (got["input/bad.pdf"]["status"], got["input/bad.pdf"]["error"]) == ("failed", "cannot read bad.pdf")
    assert (got["input/odd.PNG"]["status"], got["input/odd.PNG"]["error"]) == ("skipped", "odd one")
    assert (got["input/notes.txt"]["status"], got["input/notes.txt"]["error"]) == ("skipped", "Unsupported format: .txt")
    assert got["input/sub/a b+%20.jpg"]["status"] == "success"
    assert all(r["duration_us"] >= 0 for r in got.values())
    if by_key:
        assert got["input/gone.pdf"]["status"] == "failed"


def test_batch_end_to_end(spark, store, tmp_path):
    done = runs.run_batch(catalog.documents(spark, store, "input/"), extractor, "input/", "output/", Defaults("arabic", "never", "pipeline"))
    assert done.summary.first().asDict() == {"total": 5, "success": 2, "failed": 1, "skipped": 2}
    results = by(done.results, "file_key")
    assert results["input/good.pdf"]["page_count"] == 2 and results["input/bad.pdf"]["page_count"] == 0
    out = str(tmp_path / "out")
    assert all(r["error"] is None for r in artifacts.write_markdown_objects(done.artifacts, out).collect())
    assert by(artifacts.markdown(spark, out), "target_key")["output/good.md"]["md"] == "ok\nلا"
    images = artifacts.explode_images(done.artifacts).where("target_key = 'output/good.md'").orderBy("position").collect()
    assert [(r["key"], bytes(r["content"])) for r in images] == [("output/good/images/a.png", b"1"), ("output/good/images/b.png", b"2")]
    assert artifacts.write_image_objects(done.artifacts, out).count() == 4


def test_the_last_of_several_sources_of_one_target_wins(spark, tmp_path):
    store = fill(tmp_path, **{"a.pdf": "one", "a.png": "two", "a.tiff": "bad", "b.pdf": "three"})
    done = runs.run_batch(catalog.documents(spark, store), extractor)
    assert {r["target_key"]: r["key"] for r in done.artifacts.collect()} == {"a.md": "a.png", "b.md": "b.pdf"}
    assert done.results.count() == 4
    collisions = catalog.target_collisions(catalog.list_files(spark, store)).collect()
    assert [tuple(r) for r in collisions] == [("a.md", 3, "a.pdf", "a.tiff")]


def test_an_empty_catalog_gives_an_empty_report(spark, store):
    done = runs.run_batch(catalog.documents(spark, store).where("false"), extractor)
    assert done.summary.first().asDict() == {"total": 0, "success": 0, "failed": 0, "skipped": 0}


@pytest.mark.parametrize("by_key", [False, True])
def test_pending_jobs_run_to_their_final_state(spark, store, make_jobs, by_key):
    from folioflow.operators import registry

    jobs = make_jobs(
        {"job_id": "g1", "file_key": "input/good.pdf", "error": "earlier"},
        {"job_id": "g2", "file_key": "input/good.pdf", "lang": "arabic", "submitted_at": "2024-01-02T00:00:00+00:00"},
        {"job_id": "b", "file_key": "input/bad.pdf"},
        {"job_id": "n", "file_key": "input/notes.txt"},
        {"job_id": "gone", "file_key": "input/gone.pdf"},
        {"job_id": "r", "file_key": "input/good.pdf", "status": "running"},
    )
    docs = catalog.documents(spark, store)
    run = runs.run_pending(
        jobs, docs, extractor, "2024-01-03 00:00:00", "2024-01-03 00:01:00", Defaults("ch", "never", "pipeline"), "input/", "output/",
        root=store if by_key else None,
    )
    got = by(registry.apply_updates(jobs, run.updates), "job_id")
    assert {k: v["status"] for k, v in got.items()} == {
        "g1": "success", "g2": "success", "b": "failed", "n": "skipped", "gone": "failed", "r": "running",
    }
    assert (got["g1"]["page_count"], got["g1"]["target_key"], got["g1"]["error"]) == (2, "output/good.md", "earlier")
    assert str(got["g1"]["started_at"]) == "2024-01-03 00:00:00" and got["r"]["started_at"] is None
    assert got["b"]["error"] == "cannot read bad.pdf" and got["b"]["target_key"] is None
    # Two jobs ask for the same file with other options: the one submitted last gives the result.
    assert [(r["target_key"], r["md"]) for r in run.artifacts.collect()] == [("output/good.md", "ok\nلا")]


def test_work_folders_prefer_the_expected_objects(spark, tmp_path):
    root = fill(
        tmp_path,
        **{
            "d1/d1/d1.md": "right", "d1/a.md": "wrong", "d2/x/b.md": "second", "d2/x/c.md": "third", "d3/other.txt": "",
            "d1/d1/d1_middle.json": '{"pdf_info":[1,2,3]}', "d2/z/q_middle.json": "bad{",
            "d1/d1/images/a.png": "1", "d1/images/no.png": "2", "d2/y/images/b.png": "3", "d2/z/images/no.png": "4",
        },
    )
    work = spark.createDataFrame([("d1",), ("d2",), ("d3",), ("d4",)], "folder string")
    md = by(artifacts.work_markdown(spark, root, work), "folder")
    assert [md[f"d{i}"]["md"] for i in (1, 2, 3, 4)] == ["right", "second", None, None]
    assert md["d3"]["error"] and not md["d1"]["error"]
    assert {r[0]: r[1] for r in artifacts.work_page_counts(spark, root, work).collect()} == {"d1": 3, "d2": 0, "d3": 0, "d4": 0}
    assert sorted((r["folder"], r["key"]) for r in artifacts.work_images(spark, root, work).collect()) == [
        ("d1", "d1/d1/images/a.png"), ("d2", "d2/y/images/b.png"),
    ]


def test_one_failed_object_does_not_fail_the_others(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.md", "1"), ("a/x.md/y.md", "2"), ("b.md", None)], "key string, md string").coalesce(1)
    got = by(put_objects(rows, str(tmp_path), "key", "md"), "key")
    assert got["a/x.md"]["error"] is None and got["a/x.md/y.md"]["error"] and got["b.md"]["error"]
    again = put_objects(rows.limit(1), str(tmp_path), "key", "md").collect()
    assert again[0]["error"] is None and (tmp_path / "a/x.md").read_text() == "1"


def test_page_count_of_real_layouts(spark):
    frame = spark.createDataFrame([('{"pdf_info": [{"a": 1}, {"b": [2]}]}',)], "j string")
    assert frame.select(fmt.page_count("j").alias("n")).first()["n"] == 2


def test_large_documents_flush_in_bounded_batches(spark):
    docs = spark.range(40).select(F.concat(F.lit("d"), "id", F.lit(".pdf")).alias("key"), F.lit(1).cast("bigint").alias("size"))
    docs = docs.withColumn("content", F.encode(F.repeat(F.lit("x"), 2_000_000), "UTF-8"))
    assert extract(docs, lambda c, n, l, b: Extracted(c.decode())).agg(F.sum(F.length("md"))).first()[0] == 80_000_000
