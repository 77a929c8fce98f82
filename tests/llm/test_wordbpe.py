"""Distinct-word BPE against the library that defines its ids, and chunks of every kind."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from folioflow.llm import chunks, wordbpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=wordbpe.rank_table(RANKS), special_tokens={})


def test_words_of_any_bytes_merge_as_in_the_library(library):
    ranks, rng = wordbpe.rank_table(RANKS), random.Random(5)
    signs = ["a", "e", "t", "h", " ", "'", "s", "1", "0", "é", "ß", "日", "本", "🙂", "́", "-", "=", "\n", "\t", " ", "İ", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(1, 40)))
        found = [w for part in wordbpe.words(regex.compile(PATTERN), text) for w in part]
        assert "".join(found) == text
        assert [i for w in found for i in wordbpe.merged(w.encode(), ranks)] == library.encode_ordinary(text)
    assert wordbpe.merged(b"a" * 5000, ranks) == library.encode_ordinary("a" * 5000)


@pytest.mark.parametrize("window", [3, 7, 40])
def test_parts_of_a_text_give_the_words_of_the_whole(monkeypatch, window):
    monkeypatch.setattr(wordbpe, "WINDOW", window)
    pattern, rng = regex.compile(PATTERN), random.Random(window)
    for _ in range(500):
        text = "".join(rng.choices("ab  \n'slre.1", k=rng.randrange(0, 120)))
        assert [w for part in wordbpe.words(pattern, text) for w in part] == pattern.findall(text)


def test_whole_texts_as_in_the_library(spark, odd, library):
    got = wordbpe.encode(odd, RANKS, PATTERN, keep=("doc_id", "text")).collect()
    assert len(got) == odd.count()
    for row in got:
        assert row["ids"] == library.encode_ordinary(row["text"] or "")


@pytest.mark.parametrize("size", [1, 700, 10**9])
def test_chunks_of_any_size_give_the_same(spark, odd, library, monkeypatch, size):
    monkeypatch.setattr(chunks, "CHUNK", size)
    monkeypatch.setattr(wordbpe, "CHUNK", size)
    monkeypatch.setattr(wordbpe, "STRETCH", size // 10 + 1)
    got = wordbpe.digests(odd.repartition(3, "doc_id"), RANKS, PATTERN).collect()
    import hashlib

    def want(text):
        ids = library.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r["doc_id"], *want(r["text"])) for r in odd.select("doc_id", "text").collect()), key=key)


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    monkeypatch.setattr(wordbpe, "CHUNK", 3000)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two two three").alias("text")).repartition(7)
    held = wordbpe.exploded(docs, PATTERN, "text", ["doc_id"], 5)
    calls = spark.sparkContext.accumulator(0)
    merge = wordbpe.merged

    def counted(word, ranks):
        calls.add(1)
        return merge(word, ranks)

    monkeypatch.setattr(wordbpe, "merged", counted)
    rows = wordbpe.encoded_words(held.repartition(5, "chunk"), wordbpe.rank_table(RANKS)).collect()
    assert sum(len(chunks.unpacked(r["lengths"])) for r in rows) == 3 * held.count() and calls.value == 3


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(50256) for _ in range(rng.randrange(60))]) for i in range(200)] + [(200, None), (201, [])]
    given = spark.createDataFrame(rows, "doc_id int, ids array<int>").withColumn("decoded", F.lit(1))
    tokens = wordbpe.token_table(spark, RANKS)
    got = {r["doc_id"]: bytes(r["decoded"]) for r in wordbpe.decode(given, tokens, keep=("doc_id",)).collect()}
    assert got == {i: library.decode_bytes(ids or []) for i, ids in rows}
    packed = given.select("doc_id", F.lit(np.array([1, 2, 50255], "<u4").tobytes()).alias("ids"))
    assert {bytes(r["decoded"]) for r in wordbpe.decode(packed, tokens).collect()} == {library.decode_bytes([1, 2, 50255])}
    with pytest.raises(Exception, match="without a token"):
        wordbpe.decode(spark.createDataFrame([(1, [50256])], "doc_id int, ids array<int>"), tokens).collect()


def test_empty_tables_and_rows_without_words(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert wordbpe.digests(empty, RANKS, PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    assert {r["n_tokens"] for r in wordbpe.digests(nothing, RANKS, PATTERN).collect()} == {0}


def test_a_very_long_text_among_others(spark, library):
    long = " ".join(f"word{i % 977}'s  {i}" for i in range(400_000))
    docs = spark.createDataFrame([(1, "short"), (2, long), (3, "end")], "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r["ids"] for r in wordbpe.encode(docs, RANKS, PATTERN).collect()}
    assert got == {1: library.encode_ordinary("short"), 2: library.encode_ordinary(long), 3: library.encode_ordinary("end")}


def test_packed_sequences():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 70_000):
        sequence = rng.integers(0, 1 << 20, n)
        assert chunks.unpacked(chunks.packed(sequence)).tolist() == sequence.tolist()


def test_chunks_are_shuffled_once(spark, odd):
    found = wordbpe.encode(odd, RANKS, PATTERN, keep=("doc_id",))
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_packed_words():
    rng = random.Random(2)
    for n in (0, 1, 40):
        given = sorted({rng.randbytes(rng.randrange(1, 9)) for _ in range(n)})
        assert wordbpe._unpacked_words(wordbpe._packed_words(given)) == given


@pytest.mark.parametrize("buckets", [1, 3, 500])
def test_any_number_of_buckets(spark, odd, library, buckets):
    for row in wordbpe.encode(odd, RANKS, PATTERN, keep=("text",), buckets=buckets).collect():
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
