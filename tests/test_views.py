from helpers import by

from folioflow.operators import registry
from folioflow.plans import bundle, report, submission, views


def files(spark, *keys):
    return spark.createDataFrame([(k, 10 * (i + 1)) for i, k in enumerate(keys)], "key string, size bigint")


def test_listing_shows_the_latest_state_or_only_new_files(spark, make_jobs):
    jobs = make_jobs(
        {"job_id": "1", "file_key": "a.pdf", "status": "failed"},
        {"job_id": "2", "file_key": "a.pdf", "status": "running", "submitted_at": "2024-01-02T00:00:00+00:00"},
    )
    catalog = files(spark, "a.pdf", "b.pdf")
    got = by(views.file_listing(catalog, jobs, show_all=True), "key")
    assert (got["a.pdf"]["job_status"], got["a.pdf"]["job_id"]) == ("running", "2") and got["b.pdf"]["job_status"] is None
    assert [tuple(r) for r in views.file_listing(catalog, jobs).collect()] == [("b.pdf", 20, None, None)]


DEFAULTS = submission.Defaults("ch", "auto", "pipeline")


def test_submission_accepts_and_refuses(spark, make_jobs):
    jobs = make_jobs({"job_id": "1", "file_key": "busy.pdf", "status": "running"}, {"job_id": "2", "file_key": "a.pdf"})
    rows = [("r1", "a.pdf", "arabic"), ("r2", "a.pdf", ""), ("r3", "busy.pdf", None), ("r4", "x.txt", None), ("r5", "gone.pdf", None)]
    requests = spark.createDataFrame(rows, "request_id string, file_key string, lang string")
    decided = submission.decide(requests, files(spark, "a.pdf", "busy.pdf"), jobs, "2024-01-05 00:00:00", DEFAULTS)
    got = by(decided, "request_id")
    assert [got[f"r{i}"]["code"] for i in range(1, 6)] == [202, 202, 409, 400, 202]
    assert got["r3"]["reason"] == "Job already running for: busy.pdf" and got["r4"]["reason"] == "Unsupported format: .txt"
    assert (got["r1"]["file_size"], got["r5"]["file_size"], got["r1"]["lang"], got["r2"]["lang"]) == (10, 0, "arabic", "ch")
    assert got["r1"]["job_id"] != got["r2"]["job_id"] and got["r3"]["job_id"] is None
    new = submission.accepted_jobs(decided)
    assert new.count() == 3 and registry.insert(jobs, new).count() == 5
    assert submission.accepted_jobs(decided, strict=True).count() == 0
    clean = submission.decide(requests.where("request_id = 'r1'"), files(spark, "a.pdf"), jobs, "2024-01-05 00:00:00", DEFAULTS)
    assert submission.accepted_jobs(clean, strict=True).count() == 1
    assert submission.refused(decided).count() == 2
    assert submission.created_count(decided).first().asDict() == {"created": 3, "rejected": 2, "requested": 5}


def test_bundle_manifest(spark, make_jobs):
    jobs = make_jobs(
        {"job_id": "1", "file_key": "in/doc.pdf", "target_key": "out/doc.md", "status": "success"},
        {"job_id": "2", "file_key": "in/new.pdf", "target_key": ""},
        {"job_id": "3", "file_key": "in/lost.pdf", "target_key": "out/lost.md", "status": "success"},
    )
    stored = files(spark, "out/doc.md", "out/doc/images/a.png", "out/doc/images/sub/b.png", "out/doc/imagesx/c.png", "out/docs/images/d.png")
    wanted = spark.createDataFrame([("1",), ("2",), ("3",), ("none",)], "job_id string")
    got = bundle.manifest(wanted, jobs, files(spark, "in/doc.pdf", "in/new.pdf"), stored)
    assert sorted((r["job_id"], r["arcname"]) for r in got.collect()) == [
        ("1", "doc/doc.md"), ("1", "doc/doc.pdf"), ("1", "doc/images/a.png"), ("1", "doc/images/b.png"), ("2", "new/new.pdf"),
    ]


def test_results_and_comparison(spark, make_jobs):
    jobs = make_jobs(
        {"job_id": "1", "file_key": "a.pdf", "target_key": "out/a.md", "status": "success"},
        {"job_id": "2", "file_key": "b.png", "target_key": "out/b.md", "status": "success"},
        {"job_id": "3", "file_key": "a.pdf", "status": "running"},
    )
    results = spark.createDataFrame([("out/a.md", "# T\n![f](images/x.png)")], "target_key string, md string")
    assert [tuple(r) for r in views.result_view(jobs, results, "s3://b/").select("job_id", "md").collect()] == [
        ("1", "# T\n![f](s3://b/out/a/images/x.png)")
    ]
    got = by(views.comparison(jobs, files(spark, "b.png"), results, "src/"), "job_id")
    assert set(got) == {"1", "2"}
    assert (got["1"]["source_url"], got["1"]["source_kind"], got["1"]["title"]) == (None, None, "a.pdf") and got["1"]["result_md"]
    assert (got["2"]["source_url"], got["2"]["source_kind"], got["2"]["result_md"]) == ("src/b.png", "image", None)


def test_job_list_columns(make_jobs):
    jobs = make_jobs(
        {"job_id": "1", "file_key": "a.pdf", "file_size": 2048, "status": "success", "page_count": 3,
         "started_at": "2024-01-01T00:00:00+00:00", "completed_at": "2024-01-01T00:00:02.500000+00:00"},
        {"job_id": "2", "file_key": "b.pdf", "status": "failed", "error": "e" * 400, "submitted_at": "2024-01-02T00:00:00+00:00"},
    )
    rows = views.job_list(jobs, with_backend=True).collect()
    assert [r["job_id"] for r in rows] == ["2", "1"] and "backend" in rows[0]
    assert (rows[1]["size_text"], rows[1]["duration_text"], rows[1]["pages_text"], rows[1]["error_text"]) == ("2.0 KB", "2.5s", "3", "—")
    assert len(rows[0]["error"]) == 301 and rows[0]["status_label"] == "失败" and rows[0]["terminal"] and not rows[0]["comparable"]
    assert "backend" not in views.job_list(jobs).columns


def test_report_text(spark, tmp_path):
    rows = [
        (1, "a/very/long/path/to/a/document-name.pdf", 1048576, 5, 3_450_000, "success", None),
        (2, "b.pdf", 0, None, 5_000, "failed", "engine failed"),
        (3, "c.txt", 12, 0, 0, "skipped", ""),
    ]
    results = spark.createDataFrame(
        rows, "seq int, file_key string, file_size bigint, page_count int, duration_us bigint, status string, error string"
    )
    lines = report.report_lines(results, "seq")
    want = [
        "=" * 60, "OCR Processing Summary", "=" * 60, "Total:   3", "Success: 1", "Failed:  1", "Skipped: 1", "", "-" * 60,
        f"{'File':<30} {'Size':>8} {'Pages':>6} {'Duration':>10} {'Status'}", "-" * 60,
        f"{'...path/to/a/document-name.pdf'[:0] + '...' + rows[0][1][-25:]:<30} {'1.0 MB':>8} {5:>6} {'3.45s':>10} success",
        f"{'b.pdf':<30} {'0.0 B':>8} {0:>6} {0.005:>9.2f}s failed", "  Error: engine failed",
        f"{'c.txt':<30} {'12.0 B':>8} {0:>6} {'0.00s':>10} skipped", "=" * 60,
    ]
    assert [r["line"] for r in lines.collect()] == want
    path = str(tmp_path / "report")
    report.write_report(lines, path)
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == want
