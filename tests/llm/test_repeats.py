"""Repeated passages against a count of every window, and suffix arrays against all pairs of suffixes."""

import hashlib
import random
import tracemalloc
from collections import Counter

import pytest

from folioflow.llm import repeats
from folioflow.llm.suffixes import Suffixes


def brute_groups(strings, least):
    places = [(i, o) for i, s in enumerate(strings) for o in range(len(s)) if len(s) - o >= least]

    def common(a, b):
        x, y, k = strings[a[0]][a[1] :], strings[b[0]][b[1] :], 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        return k

    out = set()
    for a in places:
        for length in {common(a, b) for b in places if b != a}:
            if length >= least:
                group = tuple(sorted(p for p in places if p == a or common(a, p) >= length))
                heads = sum(o == 0 for _, o in group)
                if len({strings[i][o - 1] for i, o in group if o}) + heads > 1:
                    out.add((length, group))
    return out


def test_maximal_repeat_groups():
    random.seed(1)
    for t in range(150):
        strings = [bytes(random.choice(b"ab" if t % 2 else b"abc") for _ in range(random.randint(0, 30))) for _ in range(random.randint(1, 4))]
        strings += strings[:1] if t % 5 == 0 else []
        least = random.randint(1, 5)
        found, want = Suffixes(strings, least), brute_groups(strings, least)
        assert {(n, tuple(g)) for n, g in found.groups()} == want
        covered = {(int(o), k) for o, at, n in zip(*found.covered()) for k in range(at, at + n)}
        assert covered == {(i, k) for n, group in want for i, o in group for k in range(o, o + n)}


def brute(texts, least):
    whole = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + least] for b in whole for p in range(len(b) - least + 1))
    out = []
    for b in whole:
        mark = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                mark[p : p + least] = b"\1" * least
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefghé") for _ in range(random.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(40), prose(9) + "\n"
    out = [prose(random.randint(0, 60)) + passage[random.randint(0, 60) :] + prose(random.randint(0, 60)) for _ in range(25)]
    out += [out[0], out[0], None, "", "", "a" * 900, "ab" * 300 + prose(20), line * 12, prose(30) + line * 7 + prose(5), prose(900) * 2, "é" * 400]
    out += [prose(80) for _ in range(8)]
    return out


@pytest.mark.parametrize("kinds, block, part", [(2000, 1_500_000, 4_000_000), (4, 900, 4_000_000), (1, 1, 150)])
def test_remove(spark, monkeypatch, kinds, block, part):
    monkeypatch.setattr(repeats, "KINDS", kinds)
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "PART", part)
    all_ = texts()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(all_)], "doc_id bigint, text string, n_bytes int")
    got = {r.doc_id: r for r in repeats.remove(docs, least=120).collect()}
    assert len(got) == len(all_)
    for i, want in enumerate(brute(all_, 120)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) == want, (i, all_[i])
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_odd_rows(spark, odd):
    rows = [r.text for r in odd.collect()]
    got = Counter((r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in repeats.remove(odd, keep_bytes=False).collect())
    assert got == Counter(brute(rows, 400))
    assert repeats.remove(odd.limit(0)).count() == 0


def test_a_block_is_compared_in_bounded_memory():
    """A worker for each core holds a block's suffix array; it was some 145 bytes for each byte."""
    random.seed(4)
    passage = random.randbytes(400)
    strings = [random.randbytes(a) + passage + random.randbytes(352 - a) for a in random.choices(range(353), k=400)]
    tracemalloc.start()
    try:
        assert len(Suffixes(strings, 400).covered()[0]) >= 400
        assert tracemalloc.get_traced_memory()[1] < 90 * sum(map(len, strings))
    finally:
        tracemalloc.stop()


def test_blocks_keep_keys_whole_and_exceed_the_bound_for_one_key_only(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 100)
    sizes = {1: [60, 30], 2: [99], 3: [80, 80, 80], 4: [1], 5: [10], 6: [89], 7: [1]}
    rows = [{"key": k, "content": b"x" * n} for k, all_ in sizes.items() for n in all_]
    found = list(repeats._blocks(iter(rows)))
    assert [sorted({r["key"] for r in b}) for b in found] == [[1], [2], [3], [4, 5, 6], [7]]
    assert [r for b in found for r in b] == rows
    assert list(repeats._blocks(iter([]))) == []


@pytest.mark.parametrize("most", [1, 3000])
def test_an_anchor_of_many_bytes_is_halved(spark, monkeypatch, most):
    halved = []
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "_halved", lambda contents, least, f=repeats._halved: halved.append(contents) or f(contents, least))
    random.seed(6)
    passage = "".join(random.choices("abcdefgh ", k=160))
    all_ = ["".join(random.choices("ijklmnop ", k=150)) + passage + "".join(random.choices("qrstuvwx ", k=150)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(all_)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in repeats.remove(docs, least=120, keep_bytes=False).collect()}
    for i, want in enumerate(brute(all_, 120)):
        assert (got[i].n_bytes, got[i].n_removed, len(got[i].removed), got[i].kept_sha256) == want
    assert halved
