"""SimHash near-duplicates by bit-sliced comparison.

Distinct fingerprints meet in groups that agree in two of ``radius + 2`` parts of the 64 bits, as any two within the radius
do.  In a group, fingerprints are stored as bit planes, 64 fingerprints to a machine word; one fingerprint is compared with
a word of others by adding the planes of differing bits into carry-save counters, and a word is abandoned once all its
distances exceed the radius.  Groups give spanning edges, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.components import stars
from folioflow.llm.frames import with_fields
from folioflow.session import materialise

SEED = 42
#: Fingerprints of a group that one task compares; larger groups are compared block by block, each pair of blocks a task's unit.
BLOCK = 4096
#: (fingerprint, word) pairs whose counters are held at a time.
PAIRS = 200_000
#: Shingles of a text hashed at a time.
SHINGLES = 100_000
#: Planes added between two looks at which words can be abandoned.
LOOK = 8

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits of a text, unsigned: those set in over half of the XXH64 of its word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    take = min(words, len(found))
    starts, ends = starts[: len(found) - take + 1].tolist(), ends[take - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), SHINGLES):
        hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[k : k + SHINGLES], ends[k : k + SHINGLES])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` without the text, with ``__fp`` (the fingerprint as a signed 64-bit number)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = np.array([fingerprint(t.as_py(), words) for t in batch.column("__text")], np.uint64).view(np.int64)
            rest = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(own)], names=[*rest, "__fp"])

    given = docs.withColumn("__text", F.col(text)).drop(text, "__fp")
    kept = given.drop("__text")
    return given.mapInArrow(run, with_fields(kept, __fp="bigint"))


def exceed(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits whose counter, least plane first, is above ``radius``."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above, equal = above | equal & counters[k], equal & ~counters[k]
    return above


def near(prints: np.ndarray, unit: np.ndarray, side: np.ndarray, radius: int):
    """Pairs of indices within ``radius``, in pieces.

    ``prints`` (uint64) are sorted by (``unit``, ``side``); within a unit, side 0 is compared with side 1, or with itself
    where no side 1 is there.
    """
    if not len(prints):
        return
    block = unit * 2 + side
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    within = np.arange(len(prints)) - np.repeat(first, np.diff(np.append(first, len(prints))))
    lane = (within % 64).astype(np.uint64)
    heads = np.flatnonzero(lane == 0)
    planes = [np.bitwise_or.reduceat(((prints >> np.uint64(b)) & np.uint64(1)) << lane, heads) for b in range(64)]
    used = np.bitwise_or.reduceat(np.uint64(1) << lane, heads)
    word_unit, word_side = unit[heads], side[heads]
    # words each fingerprint of side 0 meets: those of side 1, or its own unit's
    units = np.unique(unit)
    last_side = np.zeros(len(units), np.int64)
    np.maximum.at(last_side, np.searchsorted(units, word_unit), word_side)
    lo = np.searchsorted(word_unit * 2 + word_side, units * 2 + last_side)
    hi = np.searchsorted(word_unit * 2 + word_side, units * 2 + last_side, side="right")
    asking = np.flatnonzero(side == 0)
    which = np.searchsorted(units, unit[asking])
    many = (hi - lo)[which]
    total = np.concatenate(([0], np.cumsum(many)))
    at = 0
    while at < len(asking):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        here = many[at:upto]
        row = np.repeat(asking[at:upto], here)
        word = np.repeat(lo[which[at:upto]], here) + np.arange(len(row)) - np.repeat(np.cumsum(here) - here, here)
        yield from _compare(prints, planes, used, heads, row, word, radius)
        at = upto


def _compare(prints, planes, used, heads, row, word, radius):
    counters = [np.zeros(len(row), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = ~used[word]
    query = prints[row]
    for b in range(64):
        carry = planes[b][word] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        for k, plane in enumerate(counters):
            counters[k], carry = plane ^ carry, plane & carry
        over |= carry
        if b % LOOK == LOOK - 1:
            over |= exceed(counters, radius)
            live = over != ALL
            if not live.all():
                counters = [c[live] for c in counters]
                over, query, row, word = over[live], query[live], row[live], word[live]
            if not len(row):
                return
    close = ~over
    hit, lane = np.nonzero(np.unpackbits(close.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    a, b = row[hit], heads[word[hit]] + lane
    other = a != b
    yield a[other], b[other]


def forest(n: int, pairs) -> np.ndarray:
    """Label of each of ``n`` items: the least item it is linked with."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for side in (label[a], label[b], a, b):
                np.minimum.at(new, side, low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
    while not np.array_equal(label[label], label):
        label = label[label]
    return label


def _parts(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of ``radius + 2`` parts of 64 bits."""
    cuts = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(print_: Column, radius: int) -> Column:
    """One key for each two parts: ``struct(pair, value)``."""

    def part(low: int, bits: int) -> Column:
        return F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << bits) - 1))

    pairs = combinations(_parts(radius), 2)
    return F.array(*[F.struct(F.lit(i).alias("pair"), F.shiftleft(part(*a), b[1]).bitwiseOR(part(*b)).alias("value")) for i, (a, b) in enumerate(pairs)])


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a``, ``b`` that span the links (at most ``radius`` differing bits) of distinct ``__fp``; 0 <= radius < 62.

    Complete whatever the size of a group: a group of over ``BLOCK`` is dealt into blocks, every two of which meet in one task.
    """
    keyed = prints.select("__fp", F.explode(_keys(F.col("__fp"), radius)).alias("k")).select("__fp", "k.pair", "k.value")
    sizes = keyed.groupBy("pair", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["pair", "value"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    shared = shared.withColumn("own", F.pmod(F.xxhash64("__fp"), F.col("blocks")).cast("int"))
    units = shared.select("__fp", "pair", "value", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("__fp", "pair", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    dealt = units.repartition("pair", "value", "i", "j").sortWithinPartitions("pair", "value", "i", "j", "side")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None

        def spanning(rows):
            cols = {n: rows.column(n).to_numpy() for n in rows.schema.names}
            change = np.zeros(rows.num_rows, bool)
            for n in ("pair", "value", "i", "j"):
                change[1:] |= cols[n][1:] != cols[n][:-1]
            unit = np.cumsum(change)
            prints_ = cols["__fp"].astype(np.int64).view(np.uint64)
            label = forest(len(prints_), near(prints_, unit, cols["side"].astype(np.int64), radius))
            moved = np.flatnonzero(label != np.arange(len(label)))
            signed = prints_.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            # keep the last unit back: it may go on in the next batch
            last = held.slice(held.num_rows - 1, 1).to_pylist()[0]
            same = pc.and_(pc.and_(pc.equal(held["pair"], last["pair"]), pc.equal(held["value"], last["value"])), pc.and_(pc.equal(held["i"], last["i"]), pc.equal(held["j"], last["j"])))
            cut = pc.index(same, True).as_py()
            if cut > 100_000 or (cut and held.num_rows > 200_000):
                yield spanning(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield spanning(held.combine_chunks())

    return dealt.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def components(docs: DataFrame, text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``__fp``, ``__root`` (a fingerprint of the component) and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links.  NULL and empty texts have fingerprint 0 and are linked
    like any other; NULL ids never are the smallest, a component with no other has a NULL id.  Equal fingerprints are one
    node, so copies are never paired.
    """
    prints = materialise(fingerprints(docs.select("doc_id", F.col(text).alias("__t")), "__t", words), "simhash")
    nodes = prints.groupBy("__fp").agg(F.min("doc_id").alias("least"))
    roots = stars(materialise(links(prints.select("__fp").distinct(), radius), "simhash-links"))
    rooted = nodes.join(roots.select(F.col("node").alias("__fp"), "root"), "__fp", "left")
    rooted = rooted.select("__fp", "least", F.coalesce("root", "__fp").alias("__root"))
    least = rooted.groupBy("__root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "__root").drop("least"), "__fp").select("doc_id", "__fp", "__root", "component_id")


def shown(print_: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def keep_one(docs: DataFrame, text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest ``doc_id`` (of repeated ones, any alike row)."""
    labelled = components(docs, text, words, radius)
    chosen = labelled.groupBy("__root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__fp")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("__id"), F.col("c.__fp").alias("__print"))
    printed = fingerprints(docs.withColumn("__t", F.col(text)), "__t", words)
    met = printed.join(chosen, (F.col("__fp") == F.col("__print")) & F.col("doc_id").eqNullSafe(F.col("__id")), "inner")
    first = Window.partitionBy("__fp", "doc_id").orderBy(F.xxhash64(text))
    return met.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").select(*docs.columns)
