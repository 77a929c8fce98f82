"""Benchmark leaks against an alignment of every item with every document."""

import os
import random

import pytest

from folioflow.llm import decontam


def plain(text):
    out = "".join(c if c.isalnum() else " " for c in text.lower())
    return " ".join(out.split(" ")).strip() if "  " not in out else " ".join(w for w in out.split(" ") if w)


def fewest(item, text):
    """Fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edit(text, edits, seed):
    random.seed(seed)
    signs = list(text)
    for _ in range(edits):
        k, kind = random.randrange(len(signs)), random.randrange(3)
        signs[k : k + 1] = {0: [], 1: ["q"], 2: [signs[k], "w"]}[kind]
    return "".join(signs)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while seven wizards brew potions."),
    (2, "A shorter question about rivers, hills & fields?"),
    (3, "In dem Fluss schwimmen große Fische, und am Ufer stehen alte Bäume; abends kommt Nebel auf, morgens scheint die Sonne wieder."),
    (4, "tiny"),
    (5, None),
    (6, "repeat repeat repeat repeat repeat repeat repeat repeat repeat repeat repeat"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, start string")


def test_normal_and_places():
    for text in ["", "...", "A--b  c!", " x ", "İstanbul ΑΣ ß", "日本 語"]:
        signs = decontam.normal(text)
        assert "".join(map(chr, signs)) == plain(text)
        where = decontam.places(text)
        assert len(where) == len(signs) and all(text[w].lower()[:1].isalnum() == (s != 32) or len(text[w].lower()) > 1 for w, s in zip(where, signs))


@pytest.mark.parametrize("part", [1 << 17, 600])
def test_every_occurrence_within_the_budget_is_found(part, monkeypatch):
    monkeypatch.setattr(decontam, "PART", part)
    known = [(i, decontam.normal(t)) for i, t in ITEMS if t and len(t) > 30]
    index = decontam.Index(known)
    filler = "Some other words stand here, none of them from an item. " * 6
    texts = []
    for seed in range(60):
        item = ITEMS[seed % 3][1]
        texts.append(filler[: seed * 5] + edit(item, seed % 16, seed) + filler[seed * 3 :])
    texts += ["", filler, " ".join(t for _, t in ITEMS if t), ITEMS[5][1] * 4]
    found = index.search([decontam.normal(t) for t in texts])
    for text, regions in zip(texts, found):
        got = {index.ids[r[0]] for r in regions}
        for k, (id_, signs) in enumerate(known):
            edits = fewest("".join(map(chr, signs)), plain(text))
            assert (id_ in got) == (edits <= index.budget[k]), (text, id_, edits)
            if id_ in got:
                assert min(r[3] for r in regions if r[0] == k) == edits
    assert all(len({r[0] for r in f}) >= 1 for f in found[-2:])


def test_leaks_and_clean(spark, items):
    leak = "Intro -- " + ITEMS[0][1].upper().replace(" ", "  ") + " outro"
    rows = [(1, leak), (1, leak), (2, "nothing of the kind"), (3, None), (None, ITEMS[1][1]), (4, ""), (5, "x " * 100_000 + ITEMS[2][1] + " y" * 9)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int")
    got = [(r.doc_id, r.item_id, r.edits, r.region) for r in decontam.leaks(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 0, leak[9:-7])] * 2 + [(None, 2, 0, ITEMS[1][1][:-1]), (5, 3, 0, ITEMS[2][1][:-1])], key=str)
    for r in decontam.leaks(docs, items).collect():
        assert dict(rows)[r.doc_id][r.start : r.end] == r.region
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [2, 3, 4]
    assert decontam.clean(docs, items.limit(0)).count() == len(rows) and decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), items).count() == 0


def test_blocks_change_nothing(spark, items, monkeypatch):
    docs = spark.createDataFrame([(k, f"so {t} so") for k, t in ITEMS], "doc_id bigint, text string")
    whole = sorted(decontam.leaks(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK", 10)
    assert sorted(decontam.leaks(docs, items).collect()) == whole and decontam.clean(docs, items).count() == 1


def test_short_items_and_parts_of_long_ones(spark):
    long = " ".join(f"{w} number {k * k} stands" for k, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()))
    known = [(1, "Who won it?"), (2, "東京は日本の首都ですか"), (3, long), (4, "who")]
    benchmark = spark.createDataFrame(known, "item_id bigint, text string")
    cut = len(long) * 15 // 100
    rows = [(1, "then: who -- won it, he asked"), (2, "then who won items"), (3, "昔から東京は日本の首都ですかと言う"), (4, "see " + long[:-cut]), (5, long[cut:] + " so"), (6, "x " + long + " y")]
    rows += [(7, long[:50]), (8, "a" * 200_000 + " who won it")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end) for r in decontam.leaks(docs, benchmark).collect())
    alone = [g for g in got if g[1] == 4]
    assert alone == [(1, 4, 6, 9), (2, 4, 5, 8), (8, 4, 200_001, 200_004)]
    got = [g for g in got if g[1] != 4]
    assert [g[:2] for g in got] == [(1, 1), (3, 2), (4, 3), (5, 3), (6, 3), (8, 1)]
    assert got[1][2:] == (3, 14) and got[4][2:] == (2, 2 + len(long)) and got[5][2:] == (200_001, 200_011)
    assert got[2][3] - got[2][2] > 0.7 * len(long) and got[3][3] - got[3][2] > 0.7 * len(long)
    assert sorted(r.doc_id for r in decontam.clean(docs, benchmark).collect()) == [7]


def test_partial_quotes_against_brute_force():
    """Items of every length, of which documents quote 85 % or more in one piece, with up to 3 % edits in it."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    known = [(k, decontam.normal(prose(60)[: 24 + 4 * k].strip())) for k in range(90)]
    search, quotes, clean = decontam.Search(known), [], [decontam.normal(prose(70)) for _ in range(200)]
    for k, signs in known:
        text = "".join(map(chr, signs))
        for _ in range(4):
            size = -(-len(text) * rng.randrange(85, 101) // 100)
            at = rng.randrange(len(text) - size + 1)
            quotes.append((k, edit(text[at : at + size], rng.randrange(1 + size * 3 // 100), rng.random())))
    found = search.search([decontam.normal(f"{prose(9)} {quote} {prose(12)}") for _, quote in quotes])
    whole = [(k, quote) for k, quote in quotes if len(known[k][1]) >= 36]
    caught = sum(any(r[0] == k for r in regions) for (k, _), regions in zip(quotes, found) if len(known[k][1]) >= 36)
    # Brute force: the quote is there, so the fewest edits of the quote in its document are 0; all are to be found.
    assert caught / len(whole) >= 0.95, (caught, len(whole))
    assert sum(map(bool, search.search(clean))) == 0


def test_runs_where_the_package_is_not_on_the_path(tmp_path):
    """Tasks get their functions by value: workers have neither the repository on their path nor as working folder."""
    import subprocess
    import sys

    script = tmp_path / "run.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.queries()["op2_benchmark_leaks"](spark, "/root/testdata/sf0.001").count() > 0
print("ran", entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count())
"""
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ran " in done.stdout, done.stderr[-2000:]
