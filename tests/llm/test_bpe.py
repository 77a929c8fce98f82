"""Byte-pair encoding against the tokenizers library."""

import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import bpe
from folioflow.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe._definition(vocabulary()))


def ids(codec, text):
    packed = codec.encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def check(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(codec, text) == want
    assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)


ODD = ["", " ", "\n", "  a", "a  ", "it's we'll I'D", "<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endof", "\x1c\x1d\x85  x", "áé", "١٢٣ ½", "日本語 テキスト", "🙂🙂‍", "x" * 5000, " " * 3000, "ab" * 4000, "\r\n\r\n\t x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, library, text):
    check(codec, library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["the", " and", "'ll", "  ", "\n", "<|endoftext|>", "12", "!?", "é"])), max_size=12).map("".join))
def test_any_text(codec, library, text):
    check(codec, library, text)


def test_every_code_point(codec, library):
    step = 500
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c < 0x30000]
    for k in range(0, len(points), step):
        text = "".join(f"a{chr(c)} {chr(c)}1" for c in points[k : k + step])
        check(codec, library, text)


def test_windows_change_nothing(codec, library, monkeypatch):
    text = "It's they'll   go\n\n  12 34 naïve  words!!  " * 50 + "z" * 400 + " " * 90
    want = library.encode(text, add_special_tokens=False).ids
    for window in (7, 8, 13, 64):
        monkeypatch.setattr(bpe, "WINDOW", window)
        assert ids(codec, text) == want


def test_pieces_in_use_are_merged_once_however_many_others_come(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    codec = bpe.Codec(bpe._definition(vocabulary()))
    merged, packed = [], codec.packed
    monkeypatch.setattr(codec, "packed", lambda piece: merged.append(piece) or packed(piece))
    for i in range(600):
        check(codec, library, f"x{i:o} ever \u00e9{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}")
    assert merged.count(" ever") == 1
    assert len(codec.known) + len(codec.older) <= 2 * 50


def test_query_form(spark, library):
    texts = ["some text", None, "", "some text", "café <|endoftext|> x"]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.digests(docs, vocabulary()).collect()}
    assert len(got) == 5
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        row = got[i or None]
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rows = bpe.encode(docs, vocabulary(), keep=("doc_id", "n_tokens")).collect()
    assert {r.doc_id: r.ids for r in rows}[4] == library.encode(texts[4]).ids
    assert bpe.digests(docs.limit(0), vocabulary()).count() == 0
