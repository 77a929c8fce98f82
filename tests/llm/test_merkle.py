"""Merkle manifests against trees built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioflow.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, arity):
    """Root, and for each node what stands before and after it at every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, path in zip(at, paths):
            run = own - own % arity
            path.append(("".join(nodes[run:own]), "".join(nodes[own + 1 : run + arity])))
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        at = [own // arity for own in at]
    return nodes[0], paths


def brute(rows, arity):
    """Sorted (doc_id, leaf, subroot, root, path) of rows of the covered columns."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = []
    for group in order:
        own = sorted(groups[group], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        done.append((own, *tree([h for _, h in own], arity)))
    root, tops = tree([subroot for _, subroot, _ in done], arity) if done else (None, [])
    out = [(i, h, subroot, root, path + top) for (own, subroot, paths), top in zip(done, tops) for (i, h), path in zip(own, paths)]
    return sorted(out, key=str)


def seen(frame):
    shown = lambda b: bytes(b).hex()
    return sorted(((r["doc_id"], shown(r["leaf"]), shown(r["subroot"]), shown(r["root"]), [(shown(s["before"]), shown(s["after"])) for s in r["path"]]) for r in frame.collect()), key=str)


COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sample(n, langs):
    rows = [(i * 7 % n if i % 11 else None, f"s{i % 3}" if i % 5 else None, langs[i * i % len(langs)], i if i % 4 else None, f"Text {i} Ä" if i % 6 else None) for i in range(n)]
    return rows + rows[: n // 3]  # a third of the rows twice


@pytest.mark.parametrize("arity", [2, 3, 8])
@pytest.mark.parametrize("n, langs", [(1, ["en"]), (9, [None, "de", "", "Z", "é"]), (160, ["en", None, "fr"])])
def test_as_in_plain_python(spark, arity, n, langs):
    rows = sample(n, langs)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert seen(merkle.manifest(docs, arity=arity)) == brute(rows, arity)


def test_one_tree_of_many_partitions(spark):
    rows = [(i, None, "en", None, str(i)) for i in range(700)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert seen(merkle.manifest(docs)) == brute(rows, 8)


def test_a_change_shows_and_nothing_else_does(spark):
    rows = [(i, "s", "en" if i % 3 else None, 4, "Text ß" if i % 2 else "text") for i in range(120)]
    got = {r["doc_id"]: r for r in merkle.digests(spark.createDataFrame(rows, COLUMNS)).collect()}
    import zlib

    for i, *_, text in rows:
        tampered = zlib.crc32(str(i).encode()) % 3 == 0 and text != text.lower()
        assert got[i]["verified"] == (not tampered) == (got[i]["folded_root"] == got[i]["root"])


def test_odd_rows_repeats_and_clashing_columns(spark, odd):
    given = odd.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(1) for c in ("leaf", "root", "path", "tree", "place", "n", "digest", "kept")})
    rows = [tuple(r) for r in given.select(*merkle.COVERED).collect()]
    assert seen(merkle.manifest(given)) == brute(rows, 8)
    kept = merkle.manifest(given, keep={"doc_id": F.col("doc_id"), "tree": F.col("tree")})
    assert kept.columns == ["doc_id", "tree", "leaf", "subroot", "root", "path"] and kept.count() == len(rows)


def test_empty_tables_and_an_arity_of_one(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert merkle.digests(empty).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(empty, arity=1)
