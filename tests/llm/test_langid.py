"""Languages: held-out accuracy, and the counts behind a vector."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import langid


def vector(letters, text):
    points = [ord(c) if c.isalpha() else 0 for c in f"\0{text.lower()}\0"]
    points = [p for k, p in enumerate(points) if p or not k or points[k - 1]]
    total = np.zeros(letters.dimensions)
    for gram, n in Counter(zip(points, points[1:], points[2:])).items():
        bound = np.ones(letters.dimensions)
        for k, p in enumerate(reversed(gram)):
            bound = bound * np.roll(letters.vector(p), k)
        total += n * bound
    return total


def test_counts_bundle_bound_ngrams():
    letters = langid.Letters(64)
    texts = ["Ab, ab  c!", "", "日本語", "x", "été ÉTÉ 12"]
    table, vectors = letters.counts(texts, np.arange(5), 5)
    sums = table @ vectors
    for i, text in enumerate(texts):
        assert np.array_equal(sums[i], vector(letters, text) if text else np.zeros(64)), text
    many = ["".join(chr(0x4E00 + (k * k + j) % 400) for k in range(50)) for j in range(4)]  # more letters than the dense table takes
    table, vectors = letters.counts(many, np.arange(4), 4)
    assert all(np.array_equal((table @ vectors)[i], vector(letters, t)) for i, t in enumerate(many))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    got = langid.predict(docs, langid.learn(docs.where(~out))).where(out).toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_odd_rows(spark, odd, monkeypatch):
    prototypes = langid.learn(odd)
    assert sorted(prototypes) == ["en", "fr", "ja"]
    whole = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(odd, prototypes).collect()}
    for (_, text), (pred, score) in whole.items():
        assert (pred == "und") == (text is None or not any(map(str.isalpha, text))) and 0 <= score <= 1
    assert langid.predict(odd, prototypes).count() == odd.count()
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.predict(odd.limit(0), prototypes).count() == 0 and langid.learn(odd.limit(0)) == {}
    monkeypatch.setattr(langid, "PART", 1000)
    cut = {(r.doc_id, r.text): r.lang_pred for r in langid.predict(odd, prototypes).collect()}
    assert sum(cut[k] == whole[k][0] for k in cut) >= len(cut) - 1


@pytest.mark.parametrize("part", [3, 10, 64])
def test_parts_of_a_long_text_have_the_n_grams_of_the_whole(monkeypatch, part):
    import random

    rng, letters = random.Random(part), langid.Letters(16)
    for _ in range(60):
        text = "".join(rng.choices("abcÀİΣß  .1²_\n日", k=rng.randrange(200)))
        monkeypatch.setattr(langid, "PART", 10**9)
        table, vectors = letters.counts([text], np.array([0]), 1)
        monkeypatch.setattr(langid, "PART", part)
        sums = 0
        for held, whose, ends in langid._parts([text]):
            own, bound = letters.counts(held, np.zeros(len(held), int), 1, ends)
            sums = sums + (own @ bound).sum(axis=0)
        assert np.allclose((table @ vectors).sum(axis=0), sums)
