"""The pipeline's rows against its stages done one after the other in plain Python."""

import hashlib
import re
import struct
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from folioflow.llm import decontam, langid, pii
from folioflow.llm.queries import vocabulary
from test_decontam import fewest, plain
from test_langid import vector
from test_pii import PATTERNS, luhn
from test_simhash import labels, print_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def mask(text):
    """Base kinds only, in the order of the operator."""
    for kind in ("email", "card", "ip", "phone"):
        def shown(m, kind=kind):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
            bad |= kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
            bad |= kind == "phone" and not 9 <= len(digits) <= 15
            return m[0] if bad else f"[{kind.upper()}]"

        text = re.sub(PATTERNS[kind], shown, text)
    return text


def test_rows_equal_a_plain_version(spark, tmp_path):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{sf}/documents.parquet' where length(text) < 1500 order by doc_id limit 60").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet' where length(text) < 200").fetchall()
    rows += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "12 34 !!", "en", "s", 8), (1003, rows[0][1], None, "s", 1), (1004, f"see {items[0][1]} there", None, "s", 9)]
    rows += [(1005, rows[1][1] + " mail x.y@mail.example.com card 4111 1111 1111 1111 ip 10.1.2.3 call +1 (743) 555-3824", "en", "s", 9)]
    base = f"{tmp_path}/sf"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}

    kept = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    prints = sorted({print_of(r[1]) for r in kept})
    root, groups = dict(zip(prints, labels(prints, 2))), defaultdict(list)
    for r in kept:
        groups[root[print_of(r[1])]].append(r)
    kept = [min(g, key=lambda r: r[0]) for g in groups.values()]
    index = decontam.Index([(i, decontam.normal(t)) for i, t in items])
    known = [("".join(map(chr, s)), b) for s, b in zip(index.signs, index.budget.tolist())]
    kept = [r for r in kept if not any(fewest(item, plain(r[1])) <= b for item, b in known)]
    library = Tokenizer.from_file(vocabulary())
    assert sorted(got) == sorted(r[0] for r in kept) and {1003, 1004} & set(got) == set() and 1005 in got
    for r in kept:
        text = mask(r[1])
        ids = library.encode(text, add_special_tokens=False).ids
        row = got[r[0]]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages(spark, odd):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd.selectExpr("doc_id", "text", "lang", "source", "length(text) as n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == columns, name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
    named = corpus_pipeline.language(spark, docs.withColumn("lang", corpus_pipeline.F.expr("if(doc_id = 3, null, lang)")), "").where("doc_id = 3").first()
    assert named.lang in ("en", "fr", "ja")


def test_language_stage_agrees_with_plain_vectors(spark, corpus):
    letters = langid.Letters()
    rows = [(i, t, g) for i, t, g in corpus[:40]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    prototypes = langid.learn(docs)
    sums = {g: sum(vector(letters, t) for _, t, h in rows if h == g) for g in prototypes}
    assert all(np.array_equal(prototypes[g], sums[g]) for g in sums)
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for r in langid.predict(docs, prototypes).collect():
        own = vector(letters, r.text)
        best = max(sorted(sums), key=lambda g: cosine(own, sums[g]))
        assert r.lang_pred == best and abs(r.score - max(0, cosine(own, sums[best]))) < 1e-6


assert pii.BASE == tuple(PATTERNS)
