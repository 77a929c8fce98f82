"""Byte-level BPE by distinct words: explode pre-tokens with their places, encode each distinct word of the corpus once, join
the ids back and reassemble by place; decoding joins the table of token bytes.

A chunk of documents names each of its distinct words once, whatever the number of its places, so the commonest word is
shuffled as often as there are chunks.  Places stay with the chunk; words go by their hash, sorted and packed, to the task that
encodes them, and only ids come back.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from folioflow.llm.chunks import chunk_row, chunk_schema, chunks, one_list, packed, ragged, unpacked
from folioflow.llm.frames import with_fields

#: Bytes of a chunk: the longer, the less often a common word is shuffled.
CHUNK = 5_000_000
#: Places whose ids are put in order at a time (more only where a document has more).
STRETCH = 200_000
#: Code points split at a time, so that a very long text never stands in memory as a list of all its words.
WINDOW = 1_000_000


def rank_table(path: str) -> dict[bytes, int]:
    """Bytes and rank (which is the id) of every token of a rank file: one pair a line, the bytes in base 64."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def words(pattern, text: str) -> Iterator[list[str]]:
    """All matches of a compiled pattern, a part of the text at a time.

    The last two matches of a part may go on beyond it (a run of signs, or an apostrophe before its letters) and are left to the
    next one.
    """
    start, width = 0, WINDOW
    while start + width < len(text):
        found = list(pattern.finditer(text, start, start + width))[:-2]
        if not found:  # words longer than the part
            width *= 2
            continue
        yield [match[0] for match in found]
        start, width = found[-1].end(), WINDOW
    yield pattern.findall(text, start)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: adjacent parts whose joined bytes have the lowest rank merge first, leftmost among equals.

    A part is the bytes from its start to ``end[start]``; an offer is stale if one of its two parts has changed since.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if end[start] != middle or end[middle] != stop:
            continue
        end[start], end[middle] = stop, -1
        if stop < n:
            before[stop] = start
        for left in (before[start], start):
            if left >= 0 and (right := end[left]) < n and (rank := ranks.get(word[left : end[right]])) is not None:
                heapq.heappush(heap, (rank, left, right, end[right]))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


class _Numbers(dict):
    """A number for every key, in the order of their first sight."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _packed_words(all_: list[bytes]) -> bytes:
    """Words in order: their number, lengths and bytes, compressed."""
    lengths = np.array([len(w) for w in all_], "<u4")
    return zlib.compress(len(all_).to_bytes(4, "little") + lengths.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(all_))


def _unpacked_words(data: bytes) -> list[bytes]:
    whole = zlib.decompress(data)
    n = int.from_bytes(whole[:4], "little")
    lengths = np.ascontiguousarray(np.frombuffer(whole, np.uint8, 4 * n, 4).reshape(4, n).T).view("<u4").ravel()
    ends = (np.cumsum(lengths, dtype=np.int64) + 4 + 4 * n).tolist()
    return [whole[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _by_class(classes: np.ndarray) -> np.ndarray:
    """Words (by bucket and bytes) in the order of their numbers: frequent ones, by powers of two, first."""
    return np.argsort(-classes.astype(np.int64), kind="stable")


def exploded(docs: DataFrame, pattern: str, text: str, keep: list[str], buckets: int) -> DataFrame:
    """Chunks of documents: their distinct words in ``packs`` (one for each bucket of hashes), the ``classes`` of their frequencies,
    the number of the word at each of the ``places``, and the ``members``.  NULL counts as empty."""

    def run(batches):
        import pyarrow as pa
        import regex

        compiled = regex.compile(pattern)
        for number, batch in chunks(batches, "__text", CHUNK):
            numbers, parts, sizes = _Numbers(), [], []
            for value in batch.column("__text"):
                have = 0
                for found in words(compiled, value.as_py() or ""):
                    parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                    have += len(found)
                sizes.append(have)
            sequence, parts = np.concatenate(parts) if parts else np.zeros(0, np.int32), []
            of_bucket: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
            for word, k in numbers.items():
                own = word.encode()
                of_bucket[zlib.crc32(own) % buckets].append((own, k))
            numbers.clear()
            for own in of_bucket:
                own.sort()
            order = np.array([k for own in of_bucket for _, k in own], np.int64)
            counts = np.bincount(sequence, minlength=len(order))[order] if len(order) else np.zeros(0, np.int64)
            classes = np.frexp(counts)[1].astype(np.uint8)
            rank = np.empty(len(order), np.int64)
            rank[order[_by_class(classes)]] = np.arange(len(order))
            packs = pa.array([_packed_words([w for w, _ in own]) if own else None for own in of_bucket], pa.binary())
            kept = pa.StructArray.from_arrays([batch.column(c) for c in keep], names=keep)
            members = pa.StructArray.from_arrays([kept, pa.array(sizes, pa.int32())], names=["kept", "size"])
            blobs = [pa.array([b], pa.binary()) for b in (zlib.compress(classes.tobytes()), packed(rank[sequence]))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one_list(packs), *blobs, one_list(members)], names=["chunk", "packs", "classes", "places", "members"])

    given = docs.select(*keep, docs[text].alias("__text"))
    schema = chunk_schema(docs.select(*keep).schema, "int")
    head = _parse_datatype_string("chunk bigint, packs array<binary>, classes binary, places binary")
    return given.mapInArrow(run, StructType([*head.fields, schema["members"]]))


def encoded_words(held: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``chunk``, ``bucket``, ``lengths`` and ``ids`` (packed) of the words of every pack of every chunk.

    Packs of a bucket meet in one task, which encodes each distinct word once for all of them.  The ranks are one file of fixed
    size and broadcast.
    """
    shared = held.sparkSession.sparkContext.broadcast(ranks)

    def explode(batches):
        import pyarrow as pa

        for batch in batches:
            for number, packs in zip(batch.column("chunk").to_pylist(), batch.column("packs")):
                rows = [(number, bucket, pack) for bucket, pack in enumerate(packs.as_py()) if pack is not None]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "pack"])

    def run(batches):
        import pyarrow as pa

        table, known, before = shared.value, {}, None
        for batch in batches:
            rows = []
            for number, bucket, pack in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "pack"))):
                if bucket != before:
                    known, before = {}, bucket
                lengths, ids = [], []
                for word in _unpacked_words(pack):
                    own = known.get(word)
                    if own is None:
                        own = known[word] = merged(word, table)
                    lengths.append(len(own))
                    ids.extend(own)
                rows.append((number, bucket, packed(np.array(lengths)), packed(np.array(ids))))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "lengths", "ids"])

    rows = held.mapInArrow(explode, "chunk bigint, bucket int, pack binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk bigint, bucket int, lengths binary, ids binary")


def _kept(keep: tuple[str, ...] | None, frame: DataFrame, *own: str) -> list[str]:
    return list(keep) if keep is not None else [c for c in frame.columns if c not in own]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] | None = None, binary: bool = False, buckets: int | None = None) -> DataFrame:
    """The kept columns (all but the text, if none are named) and ``ids`` of every text: array of int, or, as
    ``binary``, little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded by itself; strings of special tokens are plain text.  NULL and empty texts have no
    ids, repeated rows give a row each, a column ``ids`` is replaced.

    Words are dealt to ``buckets`` (as many as shuffle partitions, if no number is given), the distinct words of one of which stand
    in memory.  Chunks are shuffled once; their words are taken from, and their ids come back to, the same shuffled rows.  ``docs`` must come
    in an order that a repeated task has again, as a scan does: write shuffled rows first.
    """
    keep = _kept(keep, docs, text, "ids")
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = exploded(docs, pattern, text, keep, buckets).repartition("chunk")
    back = encoded_words(held, rank_table(ranks)).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "lengths", "ids")).alias("found"))
    met = held.join(back, "chunk", "left")
    # The order of a repeated task must be that of the first one for whoever numbers these rows.
    met = met.sortWithinPartitions("chunk")
    schema = with_fields(docs.select(*keep), ids="binary" if binary else "array<int>")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                members = batch.column("members")[row].values
                kept, held_sizes = members.field("kept"), members.field("size").to_numpy()
                order = _by_class(np.frombuffer(zlib.decompress(batch.column("classes")[row].as_py()), np.uint8)).astype(np.int32)
                lengths, flat = _found(batch.column("found")[row].as_py())
                starts, places = np.cumsum(lengths) - lengths, unpacked(batch.column("places")[row].as_py())
                ends = np.concatenate(([0], np.cumsum(held_sizes)))
                for a, b in _stretches(ends):
                    word = order[places[ends[a] : ends[b]]]
                    sizes = lengths[word]
                    ids = flat[ragged(starts[word], sizes)]
                    cuts = np.concatenate(([0], np.cumsum(sizes)))[ends[a : b + 1] - ends[a]]
                    if binary:
                        raw = ids.astype("<u4").tobytes()
                        own = pa.array([raw[4 * x : 4 * y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())
                    else:
                        own = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*[kept.field(c).slice(a, b - a) for c in keep], own], names=[*keep, "ids"])

    return met.mapInArrow(run, schema)


def _stretches(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Members, from one to before another, that have about ``STRETCH`` places together."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + STRETCH, "right")) - 1)
        yield a, b
        a = b


def _found(packs: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word of a chunk has, and all ids, in the order of buckets."""
    packs = sorted(packs or (), key=lambda p: p["bucket"])
    joined = [np.concatenate([unpacked(p[c]) for p in packs]) if packs else np.zeros(0, np.int64) for c in ("lengths", "ids")]
    return joined[0].astype(np.int64), joined[1].astype(np.int32)


def token_table(spark: SparkSession, ranks: str) -> DataFrame:
    """``id`` and ``token`` (bytes) of every token of a rank file."""
    return spark.createDataFrame([(i, bytearray(token)) for token, i in rank_table(ranks).items()], "id int, token binary")


def decode(encoded: DataFrame, tokens: DataFrame, ids: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns and ``decoded`` (bytes) of every row's ``ids`` (array of int, or packed); NULL and no ids give no bytes.

    ``tokens`` is a table of token bytes (``id``, ``token``), one row a token of one vocabulary, so it is broadcast; an id that it
    does not hold fails the query.  The distinct ids of a chunk are exploded with their places, joined, and reassembled by
    place in the task that exploded them: no shuffle.
    """
    keep = _kept(keep, encoded, ids, "decoded")
    binary = dict(encoded.dtypes)[ids] == "binary"

    def explode(batches):
        import pyarrow as pa

        for number, batch in chunks(batches, "__ids"):
            values = batch.column("__ids")
            if binary:
                sizes = [len(v.as_py() or b"") // 4 for v in values]
                flat = np.frombuffer(b"".join(v.as_py() or b"" for v in values), "<u4").astype(np.int64)
            else:
                sizes = [len(v) if v.is_valid else 0 for v in values]
                flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            distinct, sequence = np.unique(flat, return_inverse=True)
            yield chunk_row(number, pa.array(distinct, pa.int32()), sequence, [batch.column(c) for c in keep], keep, sizes)

    given = encoded.select(*keep, encoded[ids].alias("__ids")).mapInArrow(explode, chunk_schema(encoded.select(*keep).schema, "int"))
    rows = given.select("places", "members", F.posexplode_outer("items").alias("k", "item"))
    first = F.coalesce("k", F.lit(0)) == 0
    rows = rows.select(*[F.when(first, F.col(c)).alias(c) for c in ("places", "members")], "k", "item")
    met = rows.join(F.broadcast(tokens.select(F.col("id").alias("item"), "token")), "item", "left")

    def reassemble(batches):
        import pyarrow as pa

        def whole(members, places, bytes_):
            sequence, out, at = unpacked(places).tolist(), [], 0
            for size in members.field("size").to_pylist():
                out.append(b"".join(map(bytes_.__getitem__, sequence[at : at + size])))
                at += size
            return pa.RecordBatch.from_arrays([*[members.field("kept").field(c) for c in keep], pa.array(out, pa.binary())], names=[*keep, "decoded"])

        members, places, bytes_ = None, None, []
        for batch in batches:
            of = batch.column("members")
            for row, (k, token) in enumerate(zip(batch.column("k").to_pylist(), batch.column("token").to_pylist())):
                if of[row].is_valid:
                    if members is not None:
                        yield whole(members, places, bytes_)
                    members, places, bytes_ = of[row].values, batch.column("places")[row].as_py(), []
                if k is None:
                    continue
                if token is None or k != len(bytes_):
                    raise ValueError("an id without a token" if token is None else "rows of a chunk out of order")
                bytes_.append(token)
        if members is not None:
            yield whole(members, places, bytes_)

    return met.select("places", "members", "k", "token").mapInArrow(reassemble, with_fields(encoded.select(*keep), decoded="binary"))


def digests(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text, encoded and decoded again."""
    ids = encode(docs, ranks, pattern, text, keep=("doc_id",), binary=True)
    named = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    back = decode(named, token_table(docs.sparkSession, ranks))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
