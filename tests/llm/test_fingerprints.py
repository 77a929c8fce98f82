"""I-Match fingerprints: the lexicon, the signatures and the comparison with the next document."""

import hashlib
import math
from collections import Counter

from folioflow.llm import fingerprints as fp


def test_lexicon_counts_all_documents(spark, odd, monkeypatch):
    monkeypatch.setattr(fp, "HELD_TERMS", 50)
    texts = [r.text or "" for r in odd.select("text").collect()]
    counts = Counter(t for text in texts for t in fp.terms(text))
    want = sorted(t for t, n in counts.items() if 0.5 <= math.log(len(texts) / n) <= 2.5)
    assert fp.lexicon(odd, idf_low=0.5, idf_high=2.5) == want
    assert len(want) <= sum(counts.values()) / len(texts) * math.exp(2.5)
    assert fp.lexicon(odd.limit(0)) == []


def test_signatures_follow_the_terms_of_each_part():
    words = sorted(f"w{k}" for k in range(300))
    parts = fp.Parts(words)
    shares = [sum(int(m) >> p & 1 for m in parts.mask) / 300 for p in range(fp.PARTS)]
    assert shares[0] == 1.0 and abs(sum(shares[1:11]) / 10 - 1 / 16) < 0.02 and sum(shares[-10:]) / 10 < 0.01
    assert parts.signatures("w1")[:8] != fp.NO_TERM and fp.likeness(parts.signatures("w1"), parts.signatures("w2")) == 0.0
    one = parts.signatures("w3, W1 w2! zzz w1")
    assert one == parts.signatures("w1 w2 w3 other") and len(one) == 8 * fp.PARTS
    assert fp.likeness(one, one) == 1.0 and fp.likeness(one, parts.signatures("w9 w10 w11")) < 0.3
    assert fp.likeness(parts.signatures("no term"), parts.signatures("other text")) == 0.0
    assert parts.signatures("") == parts.signatures("") != parts.signatures("x")
    text = " ".join(words[:200])
    assert 0 < fp.likeness(parts.signatures(text), parts.signatures(" ".join(words[20:200]))) < 1


def brute(rows, words):
    parts = fp.Parts(words)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0), reverse=True)
    out = []
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        other = text[: len(text) - third] + following[:third]
        own, edited, next_ = map(parts.signatures, (text, other, following))
        out.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), own, edited, fp.likeness(own, edited), fp.likeness(own, next_)))
    return sorted(out, key=str)


def test_against_next(spark, corpus):
    rows = [(i, t) for i, t, _ in corpus] + [(1000, ""), (1001, None), (1002, "é🙂" * 500), (-4, "short"), (None, "last in order")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, head string").repartition(3)
    words = fp.lexicon(docs)
    got = sorted(map(tuple, fp.against_next(docs, words).collect()), key=str)
    assert got == brute(rows, words)
    near = [(r[5], r[6]) for r in got if r[1] > 200]
    assert sum(a > b for a, b in near) > 0.8 * len(near)
    one = docs.where("doc_id = 1000 or doc_id = 1002")
    assert sorted(map(tuple, fp.against_next(one, words).collect()), key=str) == brute([r for r in rows if r[0] in (1000, 1002)], words)
    assert fp.against_next(docs.limit(0), words).count() == 0
    single = docs.where("doc_id = 5")
    assert [r.near_next for r in fp.against_next(single, words).collect()] == [1.0]


def test_repeated_ids_and_clashing_columns(spark, odd):
    words = fp.lexicon(odd)
    assert fp.against_next(odd, words).count() == odd.count()
    prints = fp.fingerprints(odd, words)
    by_text = {}
    for r in prints.collect():
        by_text.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_near_copies_that_hold_a_third_of_the_rows_stay_near(spark, corpus):
    shared = " ".join(f"common{k}" for k in range(400))
    rows = [(i, t) for i, t, _ in corpus[:120]] + [(10_000 + k, f"{shared} odd{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = fp.lexicon(docs)
    assert not any(w.startswith("common") for w in words)
    got = [r for r in fp.against_next(docs, words).collect() if r.doc_id >= 10_000]
    assert len(got) == 60 and sum(r.near_next for r in got) / 60 > 0.8 and sum(r.near_edited > 0 for r in got) >= 59
    parts = fp.Parts(words)
    assert fp.likeness(parts.signatures(shared + " x"), parts.signatures(shared + " y")) > 0.8
    assert parts.signatures("...") != parts.signatures("!!!") and parts.signatures("") == parts.signatures("")
