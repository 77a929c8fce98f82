"""SimHash components against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from folioflow.llm import simhash
from folioflow.llm.components import stars


def print_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(prints, radius):
    least = list(range(len(prints)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", None, "One", "one two", "A b C d", "é x  y\tz\x0bw", "a b c " * 500, "x" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == print_of(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 17)
    assert simhash.fingerprint(text) == whole == print_of(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_near_finds_every_pair(radius, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    random = np.random.default_rng(radius)
    base = random.integers(0, 2**63, 8, dtype=np.uint64)
    prints = np.unique(base[random.integers(0, 8, 300)] ^ np.bitwise_or.reduce(np.uint64(1) << random.integers(0, 64, (300, 4)).astype(np.uint64), axis=1))
    unit = np.sort(random.integers(0, 3, len(prints)))
    got = {(int(a), int(b)) for x, y in simhash.near(prints, unit, np.zeros(len(prints), np.int64), radius) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if i != j and unit[i] == unit[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize("block", [4096, 7])
def test_links_keep_components_also_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    random = np.random.default_rng(5)
    prints = {0, 1, 3, 7, 2**63, 2**63 + 1}
    for base in random.integers(0, 2**63, 12).tolist():
        for _ in range(12):
            prints.add(base ^ sum({1 << int(b) for b in random.integers(0, 64, random.integers(0, 4))}))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "__fp bigint")
    root = {r.node: r.root for r in stars(simhash.links(frame, 2)).collect()}
    want = Counter(Counter(labels(prints, 2)).values())
    assert Counter(Counter(root.get(p, p) for p in signed).values()) == want


def test_components(spark, corpus, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    found = simhash.components(odd).collect()
    assert len(found) == len(rows)
    prints = sorted({print_of(t) for _, t in rows})
    root = dict(zip(prints, labels(prints, 2)))
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[print_of(t)]] = min(i, least.get(root[print_of(t)], i))
    want = Counter((i, print_of(t), least.get(root[print_of(t)])) for i, t in rows)
    assert Counter((r.doc_id, r["__fp"] % 2**64, r.component_id) for r in found) == want
    kept = simhash.keep_one(odd).collect()
    assert len(kept) == len(set(root.values())) and sorted(r.doc_id for r in kept) == sorted(least.values())
    assert kept[0].asDict().keys() == odd.limit(1).collect()[0].asDict().keys()
    assert simhash.components(odd.limit(0)).count() == 0 and simhash.keep_one(odd.limit(0)).count() == 0


def test_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(-5, 139), (7, 7)]
    root = {r.node: r.root for r in stars(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(root[i] == 0 for i in range(41)) and all(root[k] == -5 for k in [100, *range(101, 140)])
