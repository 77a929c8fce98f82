"""The object source lists when an action runs and takes filters; the sink writes once and takes a failed write back."""

import os

import pytest
from pyspark.sql import functions as F

from folioflow.sources import objectstore


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, files in os.walk(root) for f in files}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "store"
    for name in ("a/x.md", "a/b/y.md", "a/b/.hidden", "a/b/_z.txt", "ab/x.md", "top.md", "c/d/e/f/g.md"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(name * 2)
    return str(base)


def jobs_run(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.mark.parametrize("tasks", [1, 3, 256])
def test_lists_every_name(spark, root, tasks):
    frame = objectstore.registered(spark).read.format(objectstore.NAME).option("root", root).option("tasks", tasks).load()
    assert {r.key: r["size"] for r in frame.collect()} == {k: len(v) for k, v in tree(root).items()}


def test_no_job_before_the_action_and_filters_in_the_scan(spark, root):
    before = jobs_run(spark)
    frame = objectstore.objects(spark, root).where(F.col("key").startswith("a/b/") & F.col("key").endswith(".md") & (F.col("size") > 3))
    assert jobs_run(spark) == before
    assert [r.key for r in frame.collect()] == ["a/b/y.md"]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(key, a/b/)" not in plan.split("BatchScan")[0] and "size" in plan.split("BatchScan")[0]


@pytest.mark.parametrize(
    "condition, keys",
    [
        ("key = 'a/x.md'", ["a/x.md"]),
        ("key in ('a/x.md', 'none', 'ab/x.md')", ["a/x.md", "ab/x.md"]),
        ("key in ('a/x.md', 'top.md') and startswith(key, 'a')", ["a/x.md"]),
        ("key = 'a/x.md' and key = 'top.md'", []),
        ("startswith(key, 'a') and startswith(key, 'a/b')", ["a/b/.hidden", "a/b/_z.txt", "a/b/y.md"]),
        ("startswith(key, 'a') and startswith(key, 'b')", []),
        ("startswith(key, 'c/d') or key = 'top.md'", ["c/d/e/f/g.md", "top.md"]),
        ("startswith(key, 'nowhere/at/all')", []),
        ("key is null", []),
        ("key > 'c'", ["c/d/e/f/g.md", "top.md"]),
    ],
)
def test_any_filter_gives_what_it_says(spark, root, condition, keys):
    assert sorted(r.key for r in objectstore.objects(spark, root).where(condition).collect()) == keys


def test_content_and_errors(spark, root):
    rows = {r.key: bytes(r.content).decode() for r in objectstore.objects(spark, root, content=True).collect()}
    assert rows == tree(root)
    with pytest.raises(Exception, match="no such root"):
        objectstore.objects(spark, root + "-absent").collect()


def test_written_once_whatever_is_evaluated(spark, tmp_path):
    root, seen = str(tmp_path / "out"), spark.sparkContext.accumulator(0)
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".md")).alias("key"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("content"))
    assert rows.count() == 40 and not os.path.exists(root)
    objectstore.store(rows, root)
    assert tree(root) == {f"d/{i}.md": "é" * i for i in range(40)} and seen.value == 0
    assert os.listdir(tmp_path) == ["out"]  # no staging folder is left
    assert {r.key: r["size"] for r in objectstore.objects(spark, root).collect()} == {f"d/{i}.md": 2 * i for i in range(40)}


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    root = str(tmp_path / "out")
    objectstore.store(spark.createDataFrame([("a", "old"), ("b", "old")], "key string, content string"), root)
    rows = [(k, "new") for k in "acdef"] + [("g", None)]
    with pytest.raises(Exception, match="without key or content"):
        objectstore.store(spark.createDataFrame(rows, "key string, content string").repartitionByRange(3, "key"), root)
    assert tree(root) == {"a": "old", "b": "old"} and os.listdir(tmp_path) == ["out"]
    objectstore.store(spark.createDataFrame([("a", b"new"), ("x/y", b"")], "key string, content binary"), root)
    assert tree(root) == {"a": "new", "b": "old", "x/y": ""}
    with pytest.raises(Exception, match="mode append"):
        spark.createDataFrame([("a", "z")], "key string, content string").write.format(objectstore.NAME).option("root", root).mode("overwrite").save()
    objectstore.store(spark.createDataFrame([], "key string, content string"), root)
    assert tree(root) == {"a": "new", "b": "old", "x/y": ""}


@pytest.mark.parametrize("part", [1, 7, 10**6])
def test_parts_of_objects(spark, root, part):
    from folioflow.sources.objects import fetch_parts

    open(os.path.join(root, "empty"), "w").close()
    keys = objectstore.objects(spark, root).union(spark.createDataFrame([("gone", 3)], "key string, size bigint"))
    got = {}
    for r in sorted(fetch_parts(keys, root, part, retries=0).collect(), key=lambda r: (r.key, r.part)):
        if r.key == "gone":
            assert r.content is None and r.fetch_error
            continue
        assert r.offset == r.part * part and len(r.content) <= part
        got[r.key] = got.get(r.key, "") + bytes(r.content).decode()
    assert got == tree(root)
