"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked list of symbols; decoding by joining strings."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

#: Distinct pieces whose ids a task keeps; then those not seen among the last so many go.
CACHE = 300_000
#: Code points split at a time, so that a very long text never stands in memory as a list of all its pieces.
WINDOW = 1_000_000
#: What counts as white space for this split.
SPACE = r"\u0009-\u000d \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split of byte-level vocabularies before their merges (fixed values).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies, by their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file; made anew in each task."""

    def __init__(self, definition: str) -> None:
        import regex

        given = json.loads(definition)
        vocab = given["model"]["vocab"]
        signs = {s: b for b, s in enumerate(byte_signs())}
        strings = {i: bytes(signs[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        strings |= {i: content.encode() for content, i in self.added.items()}
        self.strings = np.full(max(strings) + 1, None, object)
        for i, string in strings.items():
            self.strings[i] = string
        self.of_byte = [vocab[s] for s in byte_signs()]
        # By rank, the pair and what it becomes; by left symbol, the rank of each right one (none after the last symbol, -1).
        self.left, self.right, self.joined = [], [], []
        ranks: dict[int, dict[int, int]] = {}
        for rank, pair in enumerate(given["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.left.append(vocab[left])
            self.right.append(vocab[right])
            self.joined.append(vocab[left + right])
            ranks.setdefault(vocab[left], {})[vocab[right]] = rank
        nothing: dict[int, int] = {}
        self.rank_with = [ranks.get(i, nothing).get for i in range(len(self.strings))]
        self.rank_of_bytes = [[self.rank_with[i](j) for j in self.of_byte] for i in self.of_byte]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge adjacent symbols, at first one for each byte, lowest rank first, leftmost among equals, until no pair has a rank.

        The heap holds rank and place in one integer; an entry is stale if either symbol has changed or gone since.
        """
        n, pairs = len(data), self.rank_of_bytes
        bits = n.bit_length()
        symbols = [self.of_byte[b] for b in data]
        heap = [rank << bits | i for i, (a, b) in enumerate(zip(data, data[1:])) if (rank := pairs[a][b]) is not None]
        if not heap:
            return symbols
        heapq.heapify(heap)
        pop, push, place = heapq.heappop, heapq.heappush, (1 << bits) - 1
        left, right, joined, rank_with = self.left, self.right, self.joined, self.rank_with
        symbols.append(-1)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        while heap:
            entry = pop(heap)
            i, rank = entry & place, entry >> bits
            if symbols[i] != left[rank] or symbols[j := after[i]] != right[rank]:
                continue
            symbols[i] = whole = joined[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if (rank := rank_with[whole](symbols[k])) is not None:
                push(heap, rank << bits | i)
            if (h := before[i]) >= 0 and (rank := rank_with[symbols[h]](whole)) is not None:
                push(heap, rank << bits | h)
        return [s for s in symbols if s >= 0]

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        return array("I", self.merge(piece.encode())).tobytes()

    def _ids(self, piece: str) -> bytes:
        """``packed``, kept for short pieces: the last ``CACHE`` ones, and those before them until as many new ones have come."""
        have = self.known.get(piece)
        if have is None:
            have = self.older.pop(piece, None) or self.packed(piece)
            if len(piece) <= 100:
                if len(self.known) >= CACHE:
                    self.known, self.older = {}, self.known
                self.known[piece] = have
        return have

    def _plain(self, text: str, start: int, stop: int) -> Iterator[bytes]:
        findall = self.pattern.findall
        while start < stop:
            upto = min(stop, start + WINDOW)
            pieces = findall(text, start, upto) if upto == stop == len(text) else self._cut(text, start, upto, stop)
            start += sum(map(len, pieces))
            out = list(map(self.known.get, pieces))
            if None in out:
                out = [self._ids(p) if have is None else have for p, have in zip(pieces, out)]
            yield b"".join(out)

    def _cut(self, text: str, start: int, upto: int, stop: int) -> list[str]:
        """Pieces from ``start``: of a part that ends before the text, without the last ones, which may go on beyond it."""
        part = text[start:upto]
        pieces = self.pattern.findall(part)
        while upto < stop and len(pieces) <= 2:  # one piece longer than the part
            upto = min(stop, upto + (upto - start))
            pieces = self.pattern.findall(text[start:upto])
        return pieces if upto == stop else pieces[:-2]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; strings of added tokens become their ids."""
        out, at = [], 0
        for mark in self.marks.finditer(text) if self.marks else ():
            out.extend(self._plain(text[at : mark.start()], 0, mark.start() - at))
            out.append(array("I", [self.added[mark[0]]]).tobytes())
            at = mark.end()
        rest = text[at:] if at else text
        out.extend(self._plain(rest, 0, len(rest)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(self.strings[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


def _definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (array of int) and ``decoded`` of every text; NULL counts as empty and has no ids.

    ``vocabulary`` is read on the driver (one file of fixed size) and broadcast.  No shuffle; each text is a row of its own,
    whatever else is repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_definition(vocabulary))

    def run(batches):
        import pyarrow as pa

        codec = Codec(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                packed = [codec.encode(t or "") for t in part.column("__text").to_pylist()]
                ids = pa.array([array("i", p) for p in packed], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids, pa.array([codec.decode(p) for p in packed])], names=[*keep, "ids", "decoded"])

    given = docs.select(*keep, docs[text].alias("__text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return given.mapInArrow(run, f"{kinds}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text; ids and text stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(_definition(vocabulary))

    def run(batches):
        import pyarrow as pa

        codec = Codec(shared.value)
        for batch in batches:
            counts, ids, texts = [], [], []
            for value in batch.column("__text"):
                packed = codec.encode(value.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(codec.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", docs[text].alias("__text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
