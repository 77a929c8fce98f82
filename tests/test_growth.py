"""Queries on keys and sizes that only larger tables have."""

from pyspark.sql import functions as F

from folioflow import suite
from folioflow.functions import text
from folioflow.operators.extraction import Extracted, extract
from folioflow.session import BATCHES, DEFAULTS, bounded, run_folder
from folioflow.sources import artifacts
from folioflow.sources.objects import fetch_objects, put_objects, remove_folders
from folioflow.suite import stores

suite.load()


def test_sizes_beyond_a_long(spark, tmp_path):
    keys = [(1, 1), (9_000_000, 899_999), (None, 5), (149_999, 14_999), (3, 10**15)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")

    def shown(name):
        return {r["o_orderkey"]: r["size_text"] for r in suite.QUERIES[name](spark, str(tmp_path)).collect()}

    exact = {k: k * k * (c + 1) for k, c in keys if k}
    assert exact[9_000_000] > 2**63
    report, listing = shown("n1_report_size"), shown("n2_listing_size")
    assert report[9_000_000] == f"{exact[9_000_000] / 1024**4:.1f} TB" and listing[9_000_000] == "69522857666015.63 MB"  # a tie, half up
    assert report[149_999] == f"{exact[149_999] / 1024**4:.1f} TB" and report[3] == f"{exact[3] / 1024**4:.1f} TB"
    assert (report[1], listing[1]) == ("2.0 B", "2 B") and (report[None], listing[None]) == (None, "—")


def test_discovered_files_take_no_room(spark, tmp_path):
    import os
    from datetime import datetime

    numbers = [0, 1, 30_000_002, 40_000_008, 16_000_000_000]
    documents = [(n, "some text", "en", "web", 9) for n in numbers]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(1, datetime(2024, 1, 1), 40_000_008, "signup")]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    with run_folder(spark) as folder:
        found = suite.QUERIES["r1_file_discovery"](spark, str(tmp_path)).collect()
        held = [os.lstat(f"{at}/{name}").st_blocks * 512 for at, _, names in os.walk(folder.removeprefix("file:")) for name in names]
    assert sorted(r["file_size"] for r in found) == [0, 1, 30_000_002, 16_000_000_000]
    assert len(held) > len(numbers)
    assert sum(held) < 10_000_000


def test_arrow_batches_are_bounded_in_any_session(spark):
    held = {name: spark.conf.get(name) for name in BATCHES}
    rows = spark.createDataFrame([("a.pdf", 1, b"x")], "key string, size long, content binary")
    uses = {
        "nfkc": lambda: text.nfkc(F.lit("x")),
        "direction": lambda: text.fix_direction(F.lit("x"), "auto", lambda line: line),
        "extract": lambda: extract(rows, lambda *_: Extracted("x")),
        "put": lambda: put_objects(rows, "file:///nowhere"),
        "fetch": lambda: fetch_objects(rows.select("key"), "file:///nowhere", tasks=1),
    }
    try:
        for name, use in uses.items():
            spark.conf.set(BATCHES[0], "64m")
            spark.conf.set(BATCHES[1], "10000")
            use()
            assert [spark.conf.get(b).removesuffix("b") for b in BATCHES] == [DEFAULTS[b] for b in BATCHES], name
        spark.conf.set(BATCHES[0], "1m")
        spark.conf.set(BATCHES[1], "7")
        bounded(spark)
        assert [spark.conf.get(b).removesuffix("b") for b in BATCHES] == ["1m", "7"]
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def test_objects_of_one_folder_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "out").mkdir()
    for i in range(60):
        (tmp_path / "out" / f"{i}.md").write_text(f"text {i}")
    (tmp_path / "out" / "bad.md").write_bytes(b"\xff")
    found = artifacts.markdown(spark, f"file://{tmp_path}", "out/").withColumn("task", F.spark_partition_id()).collect()
    assert {r["target_key"]: r["md"] for r in found} == {f"out/{i}.md": f"text {i}" for i in range(60)} | {"out/bad.md": None}
    assert [r["error"] for r in found if r["error"]] == ["not UTF-8"]
    assert len({r["task"] for r in found}) > 4


def test_work_folders_are_listed_once(spark, tmp_path):
    for name in ("a/a/images", "a/b/images", "c/x/images"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "1.png").write_bytes(b"x")
    (tmp_path / "a/a/a.md").write_text("hello")
    work = spark.createDataFrame([("a",), ("c",), ("none",)], "folder string")
    images = artifacts.work_images(spark, f"file://{tmp_path}", work)
    assert sorted(r["key"] for r in images.collect()) == ["a/a/images/1.png", "c/x/images/1.png"]
    assert "MapInArrow" not in images._jdf.queryExecution().executedPlan().toString()
    md = artifacts.work_markdown(spark, f"file://{tmp_path}", work)
    assert {r["folder"]: r["md"] for r in md.collect()} == {"a": "hello", "c": None, "none": None}
    assert md._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_work_folders_do_not_lie_on_disk_all_at_once(spark, tmp_path, monkeypatch):
    import os

    documents = [(n, f"{n} é" * (n % 5)) for n in range(120)] + [(4, None), (None, "no folder"), (8, "8 é" * 3)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stores, "SHARE_ROWS", 10, raising=False)
    seen, operator = [], artifacts.work_images

    def watched(session, root, work):
        seen.append((sorted(os.listdir(root.removeprefix("file:"))), [r["folder"] for r in work.collect()]))
        return operator(session, root, work)

    monkeypatch.setattr(artifacts, "work_images", watched)
    with run_folder(spark) as folder:
        found = suite.QUERIES["s6_work_images"](spark, str(tmp_path)).collect()
        left = [name for _, folders, names in os.walk(folder.removeprefix("file:")) for name in folders + names if name.endswith(".png") or name[:1] == "w" and name[1:].isdigit()]
    wanted = []
    for number, text in documents:
        places = {0: ("w{0}/w{0}/images/b.png", "w{0}/w{0}/images/a.png"), 1: ("w{0}/a/images/c.png", "w{0}/a/images/d.png"), 3: ()}
        places[2] = places[0]
        for place in places[number % 4] if number is not None else ():
            wanted.append((f"w{number}", place[-5:], place.format(number)))
    assert sorted((r["folder"], r["name"], r["key"]) for r in found) == sorted(wanted)
    assert {(r["key"], r["size"]) for r in found if r["folder"] not in ("w4", "w8")} == {
        (key, len((documents[int(folder[1:])][1]).encode())) for folder, _, key in wanted if folder not in ("w4", "w8")
    }
    assert sorted(f for _, work in seen for f in work if f) == sorted(f"w{n}" for n, _ in documents if n is not None)
    assert len(seen) > 4 and max(len(there) for there, _ in seen) < 60
    assert not left


def test_folders_are_removed_with_all_below_them(spark, tmp_path):
    for name in ("root/a/b/c", "root/d", "root/e", "beside"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "1.png").write_bytes(b"x")
    folders = spark.createDataFrame([("a",), ("a",), ("d",), ("none",), ("",), (None,)], "folder string")
    for _ in range(2):
        remove_folders(folders, f"file://{tmp_path}/root")
        assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.png")) == ["beside/1.png", "root/e/1.png"]
