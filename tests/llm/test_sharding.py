"""Shards: weights, growth and slots against a plain count."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from folioflow.llm import sharding


def test_place(spark):
    texts = ["", None, "abc", "naïve 🙂", "x" * 3000]
    rows = [(i % 900 if i else None, texts[i % 5]) for i in range(1000)] + [(7, "same")] * 800
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("clash"))
    got = sharding.place(sharding.sizes(docs), "doc_id", [1.0] * 40).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.place(sharding.sizes(docs.limit(0)), "doc_id", [1.0] * 3).count() == 0


def test_growth_agrees_with_the_grown_set_and_weights_count(spark):
    keys = spark.range(20000)
    rows = keys.select(
        sharding.shard_of(F.col("id"), [1.0] * 9).alias("old"),
        sharding.grown_shard_of(F.col("id"), [1.0] * 9).alias("grown"),
        sharding.shard_of(F.col("id"), [1.0] * 10).alias("new"),
        sharding.shard_of(F.col("id"), [1.0, 3.0, 0.0]).alias("heavy"),
    ).collect()
    assert all(r.grown == r.new and r.new in (r.old, 9) for r in rows)
    assert abs(sum(r.new == 9 for r in rows) - 2000) < 250
    assert abs(sum(r.heavy == 1 for r in rows) - 15000) < 400 and not any(r.heavy == 2 for r in rows)


def test_rows_of_a_hot_key_are_numbered_in_many_buckets(spark):
    rows = spark.range(5000).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("id").alias("size"))
    placed = sharding.place(rows, "doc_id", [1.0] * 4).collect()
    assert len({r.shard for r in placed}) == 1 and sorted(r.slot for r in placed) == list(range(5000))
    assert [r.size for r in sorted(placed, key=lambda r: r.slot)] != list(range(5000))  # one bucket would be in order
    assert rows.select(sharding.bucket_of(rows.columns).alias("b")).distinct().count() > 900
