"""Secret scans: candidates against Python's expressions, features by hand, the forest on held-out findings."""

import random
import re

from pyspark.sql import functions as F

from folioflow.llm import secrets

PYTHON = secrets.CANDIDATE.replace(r"(?<=[=:]\x20?[\x22'])", r"(?:(?<=[=:]\x20[\x22'])|(?<=[=:][\x22']))")


def test_candidates(spark, odd):
    rows = [(r.doc_id, r.source, r.text) for r in odd.collect()]
    rows += [(200, "p", "x = 'short12' y: \"hunter2hunter2\" Ab12Cd34Ef56Gh78 averyveryverylongwordindeed 1234567890123456 🙂 a1" + "b" * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = sorted((tuple(r) for r in secrets.findings(docs).collect()), key=str)
    want = []
    for i, path, text in rows:
        found = list(re.finditer(PYTHON, text or ""))
        edges = [0, *[x for m in found for x in m.span()], len(text or "")]
        for k, m in enumerate(found):
            want.append((i, path, m.start(), m[0], text[edges[2 * k] : m.start()][-60:], text[m.end() : edges[2 * k + 3]][:60]))
    assert got == sorted(want, key=str) and len(got) > 6
    assert secrets.findings(docs.limit(0)).count() == 0


def test_features(spark):
    found = spark.createDataFrame([(1, "p", 0, "thewater99", 'token = "', '"'), (2, None, 0, "A1b2-C3d4xyz", "", "")], "doc_id bigint, path string, start bigint, value string, before string, after string")
    words = spark.createDataFrame([("the",), ("water",), ("ate",), ("xyz",)], "word string")
    got = {r.doc_id: r for r in secrets.described(found, words).collect()}
    assert got[1].covered == 0.8 and got[2].covered == 0.25
    assert got[1].transitions == 1 / 9 and got[2].transitions == 9 / 11
    assert got[1].features[0] == 10 and got[1].features[5] == got[1].features[6] == 1 and got[2].features[5] == 0


def test_forest_on_held_out_findings(spark, monkeypatch):
    random.seed(2)
    hexes = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for k in range(400):
        if k % 2:
            rows.append((k, "src/config", 0, hexes(40), 'the token = "', '"', 1.0))
        else:
            rows.append((k, "docs/text", 0, random.choice(["internationalisation1", "4111111111111111", "thewaterundertheground2"]), "we saw ", " there", 0.0))
    rows += [(900, "p", 0, "unlabelled12345", "", "", None)]
    found = spark.createDataFrame(rows, "doc_id bigint, path string, start bigint, value string, before string, after string, label double")
    words = spark.createDataFrame([(w,) for w in ("inter", "nation", "water", "ground", "under", "the")], "word string")
    described = secrets.described(found, words)
    forest = secrets.fit(described.where("doc_id % 4 < 2"), most=150)
    scored = forest.score(described.where("doc_id % 4 >= 2 and label is not null")).collect()
    assert sum((r.probability >= 0.5) == (r.label == 1.0) for r in scored) > 0.97 * len(scored)
    again = secrets.fit(described.where("doc_id % 4 < 2"), most=150).score(described).select("doc_id", "probability")
    assert again.exceptAll(forest.score(described).select("doc_id", "probability")).isEmpty()
    assert secrets.fit(described.limit(0)).score(described).agg(F.max("probability")).first()[0] == 0.0
    assert secrets.fit(described.where("label = 1.0")).score(described).agg(F.min("probability")).first()[0] == 1.0


def test_dictionary(spark, odd):
    words = {r.word for r in secrets.dictionary(odd, share=0.3).collect()}
    texts = [r.text or "" for r in odd.collect()]
    def has(word, text):
        return word in re.findall(r"[^\W\d_]+", text.lower())
    assert words and all(3 <= len(w) and sum(has(w, t) for t in texts) >= 0.3 * len(texts) for w in words)
    assert secrets.dictionary(odd.limit(0)).count() == 0
    long = spark.createDataFrame([(k, "unimaginatively long words count") for k in range(3)], "doc_id int, text string")
    assert "unimaginatively" in {r.word for r in secrets.dictionary(long).collect()}


def test_query_holds_on_the_quarter_it_did_not_learn_from(spark):
    from folioflow.llm import langid
    from folioflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_secret_scan"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lower("text").alias("t"))
    told = got.join(truth, "doc_id").where(langid.held_out(F.col("doc_id")))
    told = told.withColumn("secret", F.expr("""regexp_like(substring(t, greatest(start - 8, 1), start - greatest(start - 8, 1) + 1), 'token = "$')""")).toPandas()
    assert len(told) > 80 and (told.secret == told.is_secret).mean() > 0.97


def test_values_are_whole(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.sflKx_w5c.a1"
    long, closing = "k9$" * 400, "Ab12!" * 30_000
    whole = {
        'token = "abcdef123456$xyzTAIL"': "abcdef123456$xyzTAIL",
        'say "Passw0rd1234!moreSecret" now': "Passw0rd1234!moreSecret",
        f"jwt: '{jwt}'": jwt,
        'key="QUJDREVGR0hJSktMTU5P12=="': "QUJDREVGR0hJSktMTU5P12==",
        f'blob = "{long}"': long,
        f'blob = "{closing}"': closing,
        "password=Hunter2!x and more": "Hunter2!x",
        f"password={closing}": closing,
        "login(password=Hunter2!x), then": "Hunter2!x",
        "http://a/?id=5&token=abc123def456&x=1": "abc123def456",
        'API-Key: "it\'s a pass phrase"': "it's a pass phrase",
        'secret = "abc\\"1234567890$"': 'abc\\"1234567890$',
        "'password' => 'Passw0rd1234!x'": "Passw0rd1234!x",
        "AUTH=Ab12Cd34Ef56$xyzTAIL next": "Ab12Cd34Ef56$xyzTAIL",
        'token = "0123456789abcdef"': "0123456789abcdef",
    }
    docs = spark.createDataFrame([(k, "p", t) for k, t in enumerate(whole)], "doc_id bigint, source string, text string")
    got = {}
    for r in secrets.findings(docs).collect():
        got.setdefault(r.doc_id, []).append(r.value)
    assert {t: got.get(k) for k, t in enumerate(whole)} == {t: [v] for t, v in whole.items()}
    words = spark.createDataFrame([("ab",), ("pass",), ("phrase",)], "word string")
    assert secrets.described(secrets.findings(docs), words).where("value = \"it's a pass phrase\"").first().covered == 10 / 18


def test_labels_say_only_what_the_rule_can_judge(spark):
    rows = [("password = ", "hunter22xyz", 1.0), ("see ", "AKIA" + "ABCD1234" * 2, 1.0), ("bearer ", "ghp_" + "a1B2" * 9, 1.0), ("x", "eyJhbGci.eyJzdWIi.sflK", 1.0)]
    rows += [("the ", "internationalisation", 0.0), ("a ", "some/long/path/of/words", 0.0), ("no ", "4845168114407329", 0.0), ("id ", "9f86d081884c7d65", None), ("secret: ", "correcthorsebatterystaple", None), ("", "", None)]
    got = spark.createDataFrame([(i, b, v) for i, (b, v, _) in enumerate(rows)], "i int, b string, v string").select("i", secrets.weak_label(F.col("b"), F.col("v")).alias("l"))
    assert {r.i: r.l for r in got.collect()} == {i: label for i, (_, _, label) in enumerate(rows)}


def test_held_out_precision_and_recall_by_kind(spark):
    """Planted findings of several kinds: the forest learns from the even documents and is asked about the odd ones."""
    import random
    import string

    rng = random.Random(9)
    some = lambda signs, n: "".join(rng.choices(signs, k=n))
    word = lambda: some("etaoinshrdlu", rng.randrange(3, 9))
    alnum = string.ascii_letters + string.digits
    kinds = {
        "named": lambda: (f'password = "{some(alnum, 15)}7"', True),
        "access key": lambda: (f"key {('AKIA' + some(string.ascii_uppercase + string.digits, 15))}3 here", True),
        "prefixed": lambda: (f"use ghp_{some(alnum, 35)}1 now", True),
        "long word": lambda: (f"the {''.join(word() for _ in range(6))} said", False),
        "path": lambda: (f"in {'/'.join(word() for _ in range(6))} lies", False),
    }
    rows, truth = [], {}
    for k in range(600):
        kind = list(kinds)[k % 5]
        text, secret = kinds[kind]()
        rows.append((k, f"p{k % 3}", f"{word()} {word()} {text} {word()}"))
        truth[k] = kind, secret
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = secrets.described(secrets.findings(docs), secrets.dictionary(docs))
    learnt = found.where("doc_id div 5 % 2 = 0").withColumn("label", secrets.weak_label(F.col("before"), F.col("value")))
    told = secrets.fit(learnt).score(found.where("doc_id div 5 % 2 = 1")).select("doc_id", "probability").collect()
    for kind in kinds:
        own = [r.probability >= 0.5 for r in told if truth[r.doc_id][0] == kind]
        assert len(own) >= 50, kind
        right = sum(o == kinds[kind]()[1] for o in own) / len(own)
        assert right >= 0.9, (kind, right)
