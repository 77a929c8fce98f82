"""I-Match document fingerprints with randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a chosen band.  Beside the whole lexicon, random parts
of it are drawn, from one in 16 of its terms down to one in 512.  A document keeps its terms of a part, sorted and distinct,
and their hash is one signature; the fingerprint is all signatures.  Any edit changes the first one; the sparser a part, the
more edits its signature survives, and the longer a text must be to have one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.frames import with_fields

#: Band of ln(documents / documents with the term): terms of 10 % down to 0.1 % of all documents.  A document has D distinct
#: terms on average, so the lexicon has at most D * exp(IDF_HIGH) terms, however many documents there are.
IDF_LOW, IDF_HIGH = 2.302, 6.908
#: A part of level j holds one in 2**j terms; DRAWS parts of each level.
LEVELS, DRAWS = range(4, 10), 10
#: The whole lexicon and the drawn parts.
PARTS = 1 + len(LEVELS) * DRAWS
#: Distinct terms a task counts before it hands them on.
HELD_TERMS = 1_000_000
NO_TERM = "00000000"
#: A text keeps to the lexicon if this share of its distinct terms is in it: a third replaced by other text changes neither side.
BANDED = 0.35

_TERM = re.compile(r"[^\W_]+")


def terms(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term``, ``n`` (documents with it).  NULL texts count as empty."""

    def run(batches):
        import pyarrow as pa

        def rows(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(terms(value.as_py() or ""))
                if len(counts) > HELD_TERMS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return docs.select(text).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> list[str]:
    """Terms within the band, sorted; see ``IDF_LOW`` for their greatest number."""
    every = docs.count()
    idf = F.ln(F.lit(every) / F.col("n"))
    banded = frequencies(docs, text).where(idf.between(idf_low, idf_high))
    return sorted(r["term"] for r in banded.select("term").collect())


def _drawn(terms_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term, and a bit for each part that it is in."""
    digests = [hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8 + 2 * DRAWS).digest() for t in terms_]
    mask = np.ones(len(terms_), np.uint64)
    for draw in range(DRAWS):
        drawn = np.array([int.from_bytes(d[8 + 2 * draw : 10 + 2 * draw], "little") for d in digests], np.int64)
        for k, level in enumerate(LEVELS):
            mask |= (drawn % (1 << level) == 0).astype(np.uint64) << np.uint64(1 + k * DRAWS + draw)
    return np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64), mask


class Parts:
    """The randomised parts of a lexicon."""

    def __init__(self, lexicon: list[str]) -> None:
        self.place = {t: i for i, t in enumerate(lexicon)}
        self.hash, self.mask = _drawn(lexicon)

    def signatures(self, text: str) -> str:
        """Eight digits for each part, zeros where the text has no term of it.

        A text of which less than ``BANDED`` of the terms is in the lexicon (a member of a large group of copies, a short text of
        common words) has the parts drawn from all its own terms; one without any term has the hash of the text in every place.
        """
        from xxhash import xxh32_hexdigest

        every, get = terms(text), self.place.get
        if not every:
            return xxh32_hexdigest(text.encode("utf-8", "replace")) * PARTS
        own = np.array(sorted(p for t in every if (p := get(t)) is not None), np.int64)
        hashes, masks = (self.hash[own], self.mask[own]) if len(own) >= BANDED * len(every) else _drawn(sorted(every))
        chosen = (masks[None, :] >> np.arange(PARTS, dtype=np.uint64)[:, None]) & np.uint64(1) == 1
        part, term = np.nonzero(chosen)
        data, cuts = hashes[term].tobytes(), np.searchsorted(part, np.arange(PARTS + 1)) * 8
        return "".join(xxh32_hexdigest(data[a:b]) if b > a else NO_TERM for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def likeness(one: str, other: str) -> float:
    """Share of equal signatures among the parts of which either text has a term."""
    if one == other:
        return 1.0
    pairs = [(one[k : k + 8], other[k : k + 8]) for k in range(0, 8 * PARTS, 8)]
    told = [a == b for a, b in pairs if a != NO_TERM or b != NO_TERM]
    return sum(told) / len(told)


def fingerprints(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; a NULL text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kept = docs.drop("fingerprint")

    def run(batches):
        import pyarrow as pa

        parts = Parts(shared.value)
        for batch in batches:
            own = pa.array([parts.signatures(t.as_py() or "") for t in batch.column(text)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(run, with_fields(kept, fingerprint="string"))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _packed(batches):
    """``text`` compressed by itself: the shuffle's own compression leaves about half as much again."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([pack(t.as_py().encode()) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed, batch.column("tie")], names=["doc_id", "text", "tie"])


def _unpacker():
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return lambda data: unpack(data).decode()


def against_next(docs: DataFrame, words: list[str]) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likenesses; the next document is that of descending ``doc_id``.

    The last document's next is the first (one document is its own).  NULL ids come last, repeated ids follow the hash of
    their texts, NULL texts are empty.  Texts are shuffled once, compressed, by range of ids; a task goes through its rows in
    order and keeps back only the last, which needs the first of the next range: one row of each range meets in a small window.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    given = given.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    kind = dict(docs.dtypes)["doc_id"]
    packed = given.mapInArrow(_packed, f"doc_id {kind}, text binary, tie bigint")
    # A stated number, so that both readers below see the same ranges.
    dealt = packed.repartitionByRange(ranges, *order)
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [part.split()[0] for part in schema.split(", ")]

    def compared(parts, ids, rows):
        import pyarrow as pa

        out = []
        for text, print_, following, next_print in rows:
            other = edited(text, following)
            other_print = parts.signatures(other) if other != text else print_
            digest = hashlib.sha256(other.encode()).hexdigest()
            out.append((len(text), digest, print_, other_print, likeness(print_, other_print), likeness(print_, next_print)))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        return pa.RecordBatch.from_arrays([ids, *columns], names=names)

    def inner(batches):
        """Every row of a range but the last."""
        import pyarrow as pa

        parts, held, kind_, unpack = Parts(shared.value), None, None, _unpacker()
        for batch in batches:
            kind_, rows, ids = batch.schema.field("doc_id").type, [], []
            for id_, value in zip(batch.column("doc_id"), batch.column("text")):
                text = unpack(value.as_py())
                print_ = parts.signatures(text)
                if held:
                    ids.append(held[0])
                    rows.append((held[1], held[2], text, print_))
                held = (id_.as_py(), text, print_)
            yield compared(parts, pa.array(ids, kind_), rows)

    def ends(batches):
        """The first and the last row of a range."""
        import pyarrow as pa
        from pyspark import TaskContext

        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first if first is not None else batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            place = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([place, last.column("doc_id"), last.column("text"), first.column("text")], names=["place", "doc_id", "text", "head"])

    def outer(batches):
        parts, unpack = Parts(shared.value), _unpacker()
        for batch in batches:
            texts, following = (list(map(unpack, batch.column(c).to_pylist())) for c in ("text", "following"))
            yield compared(parts, batch.column("doc_id"), [(t, parts.signatures(t), f, parts.signatures(f)) for t, f in zip(texts, following)])

    sorted_ = dealt.sortWithinPartitions(*order)
    one_each = sorted_.mapInArrow(ends, f"place int, doc_id {kind}, text binary, head binary")
    along = Window.orderBy("place")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("head").over(along), F.first("head").over(whole))
    last = one_each.withColumn("following", following).select("doc_id", "text", "following")
    return sorted_.mapInArrow(inner, schema).union(last.mapInArrow(outer, schema))
