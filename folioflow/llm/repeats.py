"""Removal of long repeated byte strings by enhanced suffix arrays.

Every window of ``least`` bytes belongs to one anchor, the least hash of the ``GRAM``-byte strings in it, so equal windows
have equal anchors.  The windows of one anchor in a row make a run, whose bytes are stored once.  Runs whose anchor occurs
once repeat nothing; runs that are equal as a whole are repeats without a look at their bytes; the bytes of other runs that
share an anchor (the ends of shared passages) meet in blocks, whose suffix arrays give the maximal repeats.  An anchor of
too many different runs, or of too many bytes in them, has them halved until they are equal as a whole, differ in their
anchors, or are few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.frames import with_fields
from folioflow.llm.suffixes import Suffixes
from folioflow.session import bounded, materialise

LEAST = 400
GRAM = 48
#: Different runs of one anchor that one task compares; more are halved first.
KINDS = 2000
#: Bytes of different runs of one anchor that one task compares; more are halved first.
MOST = 1_600_000
#: Bytes of a block of several anchors that gets one suffix array; a larger anchor gets a block of its own.
BLOCK = 500_000
#: Windows of a text worked on at a time.
PART = 1_000_000

#: Columns that stand for a text.
TEXT = ("__t1", "__t2")
_RUN = ("at", "n", "off", "times", "anchor", "u1", "u2")
_CONTENT = ("__t1", "__t2", "key", "u1", "u2", "weight", "at", "n", "off", "low", "high")


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place."""
    power, size, whole, done = data.astype(np.uint64), 1, None, 0
    n = len(data) - GRAM + 1
    while True:
        if GRAM & size:
            part = power[done : done + n]
            whole, done = part if whole is None else whole * np.uint64(0x165667B19E3779F9) + (part ^ (part >> np.uint64(29))), done + size
        if done == GRAM:
            return whole * np.uint64(0xD6E8FEB86659FD93) ^ (whole >> np.uint64(32))
        power = power[:-size] * np.uint64(0x9E3779B97F4A7C15) + (power[size:] ^ (power[size:] >> np.uint64(29)))
        size *= 2


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: of the end of one stretch of ``width`` and the beginning of the next."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    begin = np.minimum.accumulate(rows, axis=1).ravel()
    end = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(end[:n], begin[width - 1 : width - 1 + n])


def runs(data: bytes, least: int = LEAST) -> list[tuple[int, int, int, int, int, int, int]]:
    """(first window, windows, bytes from there to the anchor, times, anchor, hash, hash) of the runs of a text; equal ones
    in a row count as one with times."""
    from xxhash import xxh3_128_intdigest

    out: list[tuple[int, int, int, int, int, int, int]] = []
    low = np.uint64((1 << 23) - 1)
    for part in range(0, max(0, len(data) - least + 1), PART):
        stop = min(len(data) - least + 1, part + PART)
        hashes = _grams(np.frombuffer(data, np.uint8, stop - part + least - 1, part))
        keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        at = (_least_in_windows(keyed, least - GRAM + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        counts = np.diff(np.append(first, len(at)))
        anchors = hashes[at[first]].view(np.int64)
        offsets = at[first] - first
        for s, n, off, anchor in zip((first + part).tolist(), counts.tolist(), offsets.tolist(), anchors.tolist()):
            whole = xxh3_128_intdigest(data[s : s + n - 1 + least])
            u1, u2 = (whole & (1 << 64) - 1) - (1 << 63), (whole >> 64) - (1 << 63)
            if out and out[-1][1] == n and out[-1][5:] == (u1, u2):
                out[-1] = (*out[-1][:3], out[-1][3] + 1, *out[-1][4:])
            else:
                out.append((s, n, off, 1, anchor, u1, u2))
    return out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the two hashes that stand for a text; NULL counts as empty."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({TEXT[0]: F.xxhash64(content), TEXT[1]: F.xxhash64(F.lit(7), content)})


def _runs(keyed: DataFrame, text: str, least: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, *r) for i, t in enumerate(batch.column("x")) for r in runs((t.as_py() or "").encode(), least)]
            if rows:
                who, *rest = zip(*rows)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in TEXT], *[pa.array(c, pa.int64()) for c in rest]], names=[*TEXT, *_RUN])

    texts = keyed.select(*TEXT, F.col(text).alias("x")).where(F.octet_length("x") >= least)
    return texts.mapInArrow(run, ", ".join(f"{c} bigint" for c in (*TEXT, *_RUN)))


def _bytes_of(kinds: DataFrame, keyed: DataFrame, text: str, least: int) -> DataFrame:
    """``kinds`` with the bytes of their runs, taken from one copy of each text."""
    once = keyed.where(F.octet_length(text) >= least).groupBy(*TEXT).agg(F.first(text).alias("x"))

    listed = kinds.groupBy(*TEXT).agg(F.collect_list(F.struct(*_CONTENT[2:])).alias("all"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows, content = [], []
            for t1, t2, all_, value in zip(*(batch.column(c).to_pylist() for c in (*TEXT, "all")), batch.column("x")):
                data = value.as_py().encode()
                rows.extend((t1, t2, *(r[c] for c in _CONTENT[2:])) for r in all_)
                content.extend(data[r["at"] : r["at"] + r["n"] - 1 + least] for r in all_)
            yield _contents(rows, content)

    return listed.join(once, [*TEXT]).mapInArrow(cut, _schema())


def _schema() -> str:
    return ", ".join(f"{c} bigint" for c in _CONTENT) + ", content binary"


def _contents(rows: list[tuple], content: list[bytes]):
    import pyarrow as pa

    columns = list(zip(*rows)) or [()] * len(_CONTENT)
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(content, pa.binary())], names=[*_CONTENT, "content"])


def _blocks(rows: Iterable[dict]) -> Iterator[list[dict]]:
    """``rows``, sorted by key, in blocks of whole keys; over ``BLOCK`` bytes have only blocks of one key."""
    held: list[dict] = []
    size = 0
    for _, own in groupby(rows, lambda r: r["key"]):
        more = list(own)
        length = sum(len(r["content"]) for r in more)
        if held and size + length > BLOCK:
            yield held
            held, size = [], 0
        held += more
        size += length
    if held:
        yield held


def _compared(contents: DataFrame, least: int) -> DataFrame:
    """``__t1``, ``__t2``, ``start``, ``end`` of repeats in runs of weight 1; all runs of a key meet in one block."""
    dealt = contents.repartition("key").sortWithinPartitions("key")

    def run(batches):
        import pyarrow as pa

        def block(rows):
            found = Suffixes([r["content"] for r in rows], least)
            out = []
            for owner, offset, length in zip(*(c.tolist() for c in found.covered())):
                r = rows[owner]
                if r["weight"] == 1:
                    out.append((r[TEXT[0]], r[TEXT[1]], r["at"] + offset, r["at"] + offset + length))
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*TEXT, "start", "end"])

        for held in _blocks(row for batch in batches for row in batch.to_pylist()):
            yield block(held)

    return dealt.mapInArrow(run, "__t1 bigint, __t2 bigint, start bigint, `end` bigint")


def _halved(contents: DataFrame, least: int) -> DataFrame:
    """Both halves of each run, cut at the same place relative to the anchor, so that equal windows stay in equal halves.

    A half has windows that begin ``low`` up to ``high - 1`` bytes before the anchor; its key is the hash of the old key and of
    the bytes that all windows of such a half share.
    """

    def run(batches):
        from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

        for batch in batches:
            rows, content = [], []
            for r in batch.to_pylist():
                middle, data, n, off = (r["low"] + r["high"]) // 2, r["content"], r["n"], r["off"]
                cut = min(n, max(0, off - middle + 1))
                for a, b, low, high in ((0, cut, middle, r["high"]), (cut, n, r["low"], middle)):
                    if a < b:
                        own, shared = data[a : b - 1 + least], data[off - low : off - high + 1 + least]
                        whole = xxh3_128_intdigest(own)
                        key = xxh3_64_intdigest(shared + low.to_bytes(4, "little"), r["key"] & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                        rows.append((r[TEXT[0]], r[TEXT[1]], key, (whole & (1 << 64) - 1) - (1 << 63), (whole >> 64) - (1 << 63), r["weight"], r["at"] + a, b - a, off - a, low, high))
                        content.append(own)
            yield _contents(rows, content)

    return contents.mapInArrow(run, _schema())


def _whole(rows: DataFrame, least: int) -> DataFrame:
    return rows.select(*TEXT, F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + least).alias("end"))


def spans(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``__t1``, ``__t2`` (hashes of a text) and ``__spans`` (``start``, ``end`` bytes) of the repeats of every text that has some.

    A repeat is a string of ``least`` bytes (over ``GRAM``) that also starts elsewhere in ``docs``, in the same text or
    another; copies of a text are others.  Spans may overlap and touch.
    """
    bounded(docs.sparkSession)
    keyed = _keyed(docs, text)
    found = materialise(_runs(keyed, text, least), "runs")
    counts = found.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select("anchor")
    shared = materialise(found.join(counts, "anchor"), "shared-runs")
    kinds = shared.groupBy("anchor", "n", "u1", "u2").agg(F.sum("times").alias("weight"), F.min(F.struct(*TEXT, "at", "off")).alias("one"))
    many = kinds.where("weight > 1").select("anchor", "n", "u1", "u2")
    equal = shared.join(many, ["anchor", "n", "u1", "u2"])
    parts = [_whole(equal.withColumn("n", F.col("n") * F.col("times")), least)]
    reach = F.lit(least - GRAM + 1).cast("long")
    kinds = kinds.select(F.col("anchor").alias("key"), "n", "u1", "u2", "weight", "one.*", F.lit(0).cast("long").alias("low"), reach.alias("high"))
    mixed = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("weight") == 1).cast("long")).alias("single")).where("kinds > 1 and single > 0")
    contents = materialise(_bytes_of(kinds.join(mixed.select("key"), "key"), keyed, text, least), "contents")
    while True:
        size = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") - 1 + least).alias("bytes"))
        few = (F.col("kinds") <= KINDS) & (F.col("bytes") <= MOST)
        parts.append(_compared(contents.join(size.where(few).select("key"), "key"), least))
        crowded = materialise(contents.join(size.where(~few).select("key"), "key"), "crowded")
        if crowded.isEmpty():
            break
        halves = materialise(_halved(crowded, least), "halves")
        total = halves.groupBy("key", "n", "u1", "u2").agg(F.sum("weight").alias("sum"), F.min(F.struct(*TEXT, "at")).alias("one"))
        again = total.where("sum > 1").select("key", "n", "u1", "u2")
        parts.append(_whole(halves.where("weight = 1").join(again, ["key", "n", "u1", "u2"]), least))
        # One run of each kind goes on, as a counterpart if it is settled; keys without open ones are done.
        first = halves.join(total, ["key", "n", "u1", "u2"]).where("one.__t1 = __t1 and one.__t2 = __t2 and one.at = at")
        first = first.withColumn("weight", F.col("sum")).select(*_CONTENT, "content")
        left = total.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("sum") == 1).cast("long")).alias("single")).where("kinds > 1 and single > 0")
        contents = materialise(first.join(left.select("key"), "key"), "contents")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy(*TEXT).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))


def _joined(spans_: list[dict]) -> list[list[int]]:
    """Spans as disjoint ones that do not touch."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans_):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def remove(docs: DataFrame, text: str = "text", least: int = LEAST, keep_bytes: bool = True) -> DataFrame:
    """``docs`` without the text, with ``n_bytes``, ``removed`` (disjoint ``start``, ``end`` in bytes), ``n_removed``,
    ``kept_sha256`` and, if asked for, ``kept`` (the bytes left, which need not be valid UTF-8 at a cut).

    NULL counts as empty, shorter texts lose nothing; columns with those names are replaced.
    """
    given = _keyed(docs.drop("n_bytes", "removed", "n_removed", "kept_sha256", "kept"), text)
    found = spans(docs, text, least)
    met = given.withColumn("__x", F.col(text)).drop(text).join(found, [*TEXT], "left").drop(*TEXT)
    rest = met.drop("__x", "__spans")
    kinds = {"n_bytes": "bigint", "removed": "array<struct<start:bigint,end:bigint>>", "n_removed": "bigint", "kept_sha256": "string"}
    kinds |= {"kept": "binary"} if keep_bytes else {}
    names = rest.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value, spans_ in zip(batch.column("__x"), batch.column("__spans").to_pylist()):
                data, cut = (value.as_py() or "").encode(), _joined(spans_ or ())
                edges = [0, *[x for pair in cut for x in pair], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if cut else data
                removed = [{"start": a, "end": b} for a, b in cut]
                rows.append((len(data), removed, len(data) - len(kept), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.string(), pa.binary())
            own = [pa.array(c, t) for c, t in zip(columns, types)][: len(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *own], names=[*names, *kinds])

    return met.mapInArrow(run, with_fields(rest, **kinds))
