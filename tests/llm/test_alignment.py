"""Alignment of two tokenizers against pairs found by walking over both."""

import collections
import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from folioflow.llm import alignment
from folioflow.llm.bpe import byte_signs

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def walk():
    """Ids, links (places and bytes), groups and pairs in one group of a text; None if the bytes are not kept."""
    first = tokenizers.Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    signs = {sign: byte for byte, sign in enumerate(byte_signs())}

    def run(text):
        if not text:
            return None
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(signs[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
        owner_a = [i for i, t in enumerate(bytes_a) for _ in t]
        owner_b = [j for j, t in enumerate(bytes_b) for _ in t]
        links = sorted((i, j, n) for (i, j), n in collections.Counter(zip(owner_a, owner_b)).items())
        groups, i, j = [], 0, 0
        after_a, after_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
        for end in sorted({*ends_a} & {*ends_b}):
            to_i, to_j = after_a[end], after_b[end]
            groups.append((range(i, to_i), range(j, to_j)))
            i, j = to_i, to_j
        return a, b, links, groups

    return run


def expected(texts, walk):
    found = [walk(t) for t in texts]
    counts = collections.Counter(p for f in found if f for p in {(f[0][i], f[1][j]) for i, j, _ in f[2]})
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, "", 0, 0))
            continue
        a, b, links, groups = f
        pairs = [(a[i], b[j]) for i, j, _ in links]
        shown = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest()
        out.append((len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), digest, sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs)))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "n_best", "count_sum"]
ODD = ["", "a", " ", "  lead", "tail  ", "tab\tnew\nline", "▁ mark", "<s></s><unk><0x41>", "<|endoftext|>", "日本語 🙂", "é é ﬁ", "naïve​word", "x" * 3000, "-=" * 500, "\u0000nul", "ÀÉÎ", "....", "1234567890" * 20]


def test_products_against_dense_matrices():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m, k = rng.integers(0, 8, 3)
        a, b = rng.random((n, m)) < 0.4, rng.random((m, k)) < 0.4
        rows = lambda x: alignment.Rows(np.concatenate(([0], np.cumsum(x.sum(1)))).astype(np.int64), np.nonzero(x)[1], x.shape[1])
        r, c, v = alignment.product(rows(a), rows(b))
        dense = a.astype(int) @ b.astype(int)
        assert [tuple(x) for x in zip(r, c, v)] == [(i, j, dense[i, j]) for i, j in zip(*np.nonzero(dense))]
        assert alignment.product_sizes(rows(a), rows(b)).tolist() == dense.sum(1).tolist()
        t = alignment.transposed(rows(a))
        assert [np.asarray(x).tolist() for x in t[:2]] == [np.asarray(x).tolist() for x in rows(a.T)[:2]]


@pytest.mark.parametrize("segment", [1, 50, 10**6])
def test_links_and_groups_of_odd_texts(spark, walk, monkeypatch, segment):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*ODD, None])], "doc_id int, text string, links int")
    got = {r["doc_id"]: r for r in alignment.alignments(docs, *FILES, keep=("doc_id",), shared=True).collect()}
    for i, text in enumerate([*ODD, None]):
        want = walk(text) or ([], [], [], [])
        assert (got[i]["a_ids"], got[i]["b_ids"]) == (want[0], want[1])
        assert [tuple(x) for x in got[i]["links"]] == want[2]
        assert [tuple(x) for x in got[i]["groups"]] == [(x[0], y[0]) for x, y in want[3]]
        assert sorted(tuple(x) for x in got[i]["shared"]) == sorted((p, q) for x, y in want[3] for p in x for q in y)


@pytest.mark.parametrize("size", [1, 2000, 10**9])
def test_counts_over_the_corpus(spark, walk, corpus, monkeypatch, size):
    monkeypatch.setattr(alignment, "CHUNK", size)
    texts = [*ODD, None, *[t for _, t, _ in corpus[:25]], *[corpus[0][1]] * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3, "doc_id")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.scored(docs, *FILES).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts, walk)


def test_odd_rows(spark, odd, walk):
    rows = [r["text"] for r in odd.select("text").collect()]
    got = alignment.scored(odd.withColumn("n_a", F.lit("x")).repartition(2), *FILES)
    assert {"fingerprint", "source", "n_a"} <= set(got.columns) and dict(got.dtypes)["n_a"] == "bigint"
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(expected(rows, walk))


def test_empty_tables_and_rows_without_tokens(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.scored(empty, *FILES).count() == 0 and alignment.alignments(empty, *FILES).count() == 0
    nothing = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    assert {tuple(r[c] for c in COLUMNS) for r in alignment.scored(nothing, *FILES).collect()} == {(0, 0, 0, 0, 0, "", 0, 0)}


def test_the_first_tokenizer_is_that_of_the_library(corpus):
    import random

    rng = random.Random(8)
    library = tokenizers.Tokenizer.from_file(FILES[0])
    library.encode_special_tokens = True
    definition = open(FILES[0], encoding="utf-8").read()
    assert alignment.ranked_by_id(definition)
    given = json.loads(definition)
    given["model"]["merges"] = given["model"]["merges"][::-1]
    assert not alignment.ranked_by_id(json.dumps(given))
    signs = "ab' slt1,.\n\t é日🙂\u00a0\u3000\x1c\x85\u2028"
    texts = [*ODD, *[t for _, t, _ in corpus if t]] + ["".join(rng.choices(signs, k=30)) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(500)]
    for ranked in (False, True):
        both = alignment.Tokenizers(definition, open(FILES[1], "rb").read(), ranked)
        for text in texts:
            assert both._first(" " + text) == library.encode(" " + text, add_special_tokens=False).ids
