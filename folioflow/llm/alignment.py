"""Alignment of two tokenizers by products of token-byte incidence matrices.

The tokens of both cover the same bytes.  With A (tokens of the first by bytes) and B (tokens of the second by bytes), the
entries of A Bᵀ are the pairs of tokens that overlap and by how many bytes.  Offsets where tokens of both end cut the bytes into
groups; the product of the group incidences gives the pairs of tokens that share a group.  Products are Gustavson's: row by
row, of matrices held as row starts and column indices.

Counts over all documents need every document's distinct pairs twice, so pairs are numbered within chunks of documents: chunks
are written, their distinct pairs are summed up by pair and come back to the chunk with their counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

from folioflow.llm.bpe import PATTERN, byte_signs
from folioflow.llm.chunks import chunks, one_list, ragged
from folioflow.llm.frames import with_fields
from folioflow.llm.wordbpe import words
from folioflow.session import materialise

#: Words whose ids a task keeps; then it starts anew.
KNOWN = 300_000
#: Bytes of a chunk: its tokens stand in memory as numbers, several for each.
CHUNK = 2_000_000
#: Bytes whose incidences stand in memory at a time (more only where a single group is longer).
SEGMENT = 1_000_000
_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


class Rows(NamedTuple):
    """A matrix of zeros and ones: ``columns[starts[i]:starts[i + 1]]`` are the ones of row ``i``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int


def incidence(lengths: np.ndarray) -> Rows:
    """Tokens by bytes, of tokens that cover their bytes one after the other."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return Rows(starts, np.arange(starts[-1]), int(starts[-1]))


def membership(group: np.ndarray, groups: int) -> Rows:
    """Tokens by groups."""
    return Rows(np.arange(len(group) + 1), group, groups)


def transposed(m: Rows) -> Rows:
    """Columns by rows, by counting."""
    order = np.argsort(m.columns, kind="stable")
    owner = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    return Rows(np.concatenate(([0], np.cumsum(np.bincount(m.columns, minlength=m.width)))), owner[order], len(m.starts) - 1)


def product(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the entries of A B, by row and column.

    Each row of A gathers the rows of B that its columns name; equal columns are summed up.
    """
    lengths = (b.starts[1:] - b.starts[:-1])[a.columns]
    columns = b.columns[ragged(b.starts[a.columns], lengths)]
    rows = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), lengths)
    key = rows * max(1, b.width) + columns
    if len(key) and (key[1:] < key[:-1]).any():
        key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    values = np.diff(np.append(first, len(key)))
    return key[first] // max(1, b.width), key[first] % max(1, b.width), values


def product_sizes(a: Rows, b: Rows) -> np.ndarray:
    """How many terms each row of A B sums up: entries, where no two of them fall together."""
    terms = np.concatenate(([0], np.cumsum((b.starts[1:] - b.starts[:-1])[a.columns])))
    return np.diff(terms[a.starts])


def grouped(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the groups, and the group of each token of A and of B."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return ends, np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray, ends: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token of A, token of B and shared bytes of all that overlap; a stretch of whole groups at a time."""
    out, at, a0, b0 = [], 0, 0, 0
    while a0 < len(a_lengths):
        last = max(at, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEGMENT)) - 1)
        a1, b1 = int(np.searchsorted(a_group, last, "right")), int(np.searchsorted(b_group, last, "right"))
        rows, columns, shared = product(incidence(a_lengths[a0:a1]), transposed(incidence(b_lengths[b0:b1])))
        out.append((rows + a0, columns + b0, shared))
        at, a0, b0 = last + 1, a1, b1
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def ranked_by_id(a: str) -> bool:
    """Whether ids alone say how a byte-level vocabulary merges: merges make ascending ids, and every token merges to itself.

    Adjacent parts that make up a token are then always a merge of the vocabulary: parts of a text that end where a token does
    merge as the token alone does, and a token that is left in two such parts would not merge to itself.
    """
    import tokenizers

    given, model = json.loads(a)["model"], tokenizers.Tokenizer.from_str(a).model
    pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in given["merges"])
    made = [given["vocab"][left + right] for left, right in pairs]
    signs = set(byte_signs())
    own = (token for token in given["vocab"] if signs.issuperset(token))
    return made == sorted(set(made)) and all([t.value for t in model.tokenize(token)] == [token] for token in own)


class Tokenizers:
    """Both tokenizers in a task, made from the contents of their files.

    Where the first one's ids say how it merges (see ``ranked_by_id``), its texts are encoded by ranks, else word by word.
    """

    def __init__(self, a: str, b: bytes, ranked: bool = False) -> None:
        import regex
        import sentencepiece
        import tokenizers

        given = json.loads(a)
        if given.get("normalizer") or (given.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("the first tokenizer must be byte-level, without a normalizer")
        self.model, self.pattern = None if ranked else tokenizers.Tokenizer.from_str(a).model, regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        signs = {sign: byte for byte, sign in enumerate(byte_signs())}
        self.signs = "".join(byte_signs())
        vocabulary = given["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(s in signs for s in token):
                self.a_bytes[i] = bytes(signs[s] for s in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))
        self.ranks = None
        if ranked:
            import tiktoken

            self.ranks = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes) if t}, special_tokens={})
        # What a token is in the text of the groups: with a comma, or with the sign that ends its side.
        a_ids, b_ids = range(len(self.a_bytes)), range(len(self.b_bytes))
        self.shown = [*(f"{i}," for i in a_ids), *(f"{i}|" for i in a_ids), *(f"{i}," for i in b_ids), *(f"{i};" for i in b_ids)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; none where one of them does not keep the bytes of a space and the text."""
        have = [k for k, text in enumerate(texts) if text]
        given = [texts[k] for k in have]
        a_out, b_out = [[] for _ in texts], [[] for _ in texts]
        for k, text, b in zip(have, given, self.b.encode(given, num_threads=1)):
            whole, a = b" " + text.encode(), self._first(" " + text)
            if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
                a_out[k], b_out[k] = a, b
        return a_out, b_out

    def _first(self, text: str) -> list[int]:
        """Ids of the first tokenizer; without ranks its model sees each word once as long as the task remembers it."""
        if self.ranks:
            return self.ranks.encode_ordinary(text)
        known, ids = self.known, []
        for found in words(self.pattern, text):
            for word in set(found).difference(known):
                signs = "".join(map(self.signs.__getitem__, word.encode()))
                known[word] = [token.id for token in self.model.tokenize(signs)]
            ids.extend(chain.from_iterable(map(known.__getitem__, found)))
            if len(known) > KNOWN:
                known.clear()
        return ids


class Aligned:
    """The alignment of several texts, one after the other on one axis of bytes."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str | None]) -> None:
        a, b = tokenizers.ids(texts)
        self.tokenizers = tokenizers
        self.n_a, self.n_b = (np.array([len(ids) for ids in all_], np.int64) for all_ in (a, b))
        self.a, self.b = (np.fromiter((i for ids in all_ for i in ids), np.int64, int(n.sum())) for all_, n in ((a, self.n_a), (b, self.n_b)))
        a_sizes, b_sizes = tokenizers.a_sizes[self.a], tokenizers.b_sizes[self.b]
        ends, self.a_group, self.b_group = grouped(a_sizes, b_sizes)
        self.groups = len(ends)
        self.link_a, self.link_b, self.shared_bytes = overlaps(a_sizes, b_sizes, ends, self.a_group, self.b_group)
        self.a_at, self.b_at = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        # Groups and links of each text: it ends where its last token of A does.
        self.group_at = np.searchsorted(self.a_group, np.arange(self.groups + 1))
        self.groups_to = np.searchsorted(self.group_at, self.a_at)
        self.links_to = np.searchsorted(self.link_a, self.a_at)

    def sharing(self) -> tuple[Rows, Rows]:
        """The factors whose product has an entry for each pair of tokens that share a group."""
        return membership(self.a_group, self.groups), transposed(membership(self.b_group, self.groups))

    def counts(self) -> dict[str, np.ndarray]:
        """Tokens, groups, links, and pairs that share a group, of each text."""
        shared = np.concatenate(([0], np.cumsum(product_sizes(*self.sharing()))))
        return dict(zip(_COUNTS, (self.n_a, self.n_b, np.diff(self.groups_to), np.diff(self.links_to), np.diff(shared[self.a_at]))))

    def shown(self) -> Iterator[str]:
        """Groups of each text: ids of A by commas, a bar, ids of B by commas; groups by semicolons."""
        sizes_a, sizes_b = (np.bincount(g, minlength=self.groups) for g in (self.a_group, self.b_group))
        upto_a, upto_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        many_a, many_b = len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (self.a_group, self.b_group))
        out[np.arange(len(self.a)) + (upto_b - sizes_b)[self.a_group]] = self.a + many_a * last_a
        out[np.arange(len(self.b)) + upto_a[self.b_group]] = 2 * many_a + self.b + many_b * last_b
        cuts = (self.a_at + self.b_at).tolist()
        for start, stop in zip(cuts, cuts[1:]):
            yield "".join(map(self.tokenizers.shown.__getitem__, out[start:stop].tolist()))[:-1]


def _files(docs: DataFrame, a: str, b: str):
    """The two files, read on the driver (their sizes are fixed) and broadcast."""
    with open(a, encoding="utf-8") as first, open(b, "rb") as second:
        definition = first.read()
        return docs.sparkSession.sparkContext.broadcast((definition, second.read(), ranked_by_id(definition)))


def alignments(docs: DataFrame, a: str, b: str, text: str = "text", keep: tuple[str, ...] | None = None, shared: bool = False) -> DataFrame:
    """The kept columns (all but the text, if none are named) and the alignment of every text: ``a_ids``, ``b_ids``, ``links``
    (places ``a`` and ``b`` of overlapping tokens, ``bytes``), ``groups`` (places ``a`` and ``b`` where each begins) and, if asked
    for, ``shared`` (all pairs of places in one group, which are many where a group is long).

    The first tokenizer (a JSON definition) gets a space and the text, the second (a piece model) the text, to which it adds
    the space.  NULL and empty texts, and those whose bytes one of the two does not keep, have no tokens.  Columns with the new
    names are replaced, repeated rows give a row each.  No shuffle.
    """
    new = ("a_ids", "b_ids", "links", "groups", "shared")
    keep = list(keep) if keep is not None else [c for c in docs.columns if c not in (text, *new)]
    files = _files(docs, a, b)
    kinds = {"a_ids": "array<int>", "b_ids": "array<int>", "links": "array<struct<a:int,b:int,bytes:int>>", "groups": "array<struct<a:int,b:int>>"}
    kinds |= {"shared": "array<struct<a:int,b:int>>"} if shared else {}

    def run(batches):
        import pyarrow as pa

        tokenizers = Tokenizers(*files.value)

        def lists(upto, *columns, names=None):
            arrays = [pa.array(c, pa.int32()) for c in columns]
            return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays(arrays, names=names) if names else arrays[0])

        for _, batch in chunks(batches, "__text", CHUNK):
            got = Aligned(tokenizers, batch.column("__text").to_pylist())
            own_a, own_b = (np.arange(int(at[-1])) - np.repeat(at[:-1], np.diff(at)) for at in (got.a_at, got.b_at))
            first_a, first_b = (np.searchsorted(g, np.arange(got.groups)) for g in (got.a_group, got.b_group))
            columns = [lists(got.a_at, got.a), lists(got.b_at, got.b)]
            columns += [lists(got.links_to, own_a[got.link_a], own_b[got.link_b], got.shared_bytes, names=["a", "b", "bytes"])]
            columns += [lists(got.groups_to, own_a[first_a], own_b[first_b], names=["a", "b"])]
            if shared:
                rows, others, _ = product(*got.sharing())
                columns += [lists(np.searchsorted(rows, got.a_at), own_a[rows], own_b[others], names=["a", "b"])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, *kinds])

    given = docs.select(*keep, docs[text].alias("__text"))
    return given.mapInArrow(run, with_fields(docs.select(*keep), **kinds))


def _chunked(docs: DataFrame, a: str, b: str, text: str, keep: list[str]) -> DataFrame:
    """Chunks of documents: ``pairs`` (distinct linked ids and in how many of the documents), ``which`` and ``times`` (the pairs of
    one member after the other, by their number) and ``members`` (kept columns, counts, digest, number of distinct pairs)."""
    files = _files(docs, a, b)

    def run(batches):
        import pyarrow as pa

        tokenizers = Tokenizers(*files.value)
        for number, batch in chunks(batches, "__text", CHUNK):
            got = Aligned(tokenizers, batch.column("__text").to_pylist())
            pairs, which = np.unique(got.a[got.link_a] << 32 | got.b[got.link_b], return_inverse=True)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(got.links_to))
            own, times = np.unique(owner * max(1, len(pairs)) + which, return_counts=True)
            owner, which = own // max(1, len(pairs)), own % max(1, len(pairs))
            docs_of = np.bincount(which, minlength=len(pairs))
            digests_ = [hashlib.sha256(shown.encode()).hexdigest() if shown else "" for shown in got.shown()]
            counts = [pa.array(c, pa.int64()) for c in got.counts().values()]
            sizes = pa.array(np.bincount(owner, minlength=batch.num_rows), pa.int32())
            kept = pa.StructArray.from_arrays([batch.column(c) for c in keep], names=keep)
            members = pa.StructArray.from_arrays([kept, *counts, pa.array(digests_, pa.string()), sizes], names=["kept", *_COUNTS, "groups_sha256", "size"])
            found = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (pairs >> 32, pairs & 0xFFFFFFFF, docs_of)], names=["a", "b", "docs"])
            lists = [one_list(pa.array(c, pa.int32())) for c in (which, times)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), one_list(found), *lists, one_list(members)], names=["chunk", "pairs", "which", "times", "members"])

    member = StructType([StructField("kept", docs.select(*keep).schema), *_parse_datatype_string(", ".join(f"{c} bigint" for c in _COUNTS) + ", groups_sha256 string, size int").fields])
    schema = _parse_datatype_string("chunk bigint, pairs array<struct<a:int,b:int,docs:int>>, which array<int>, times array<int>")
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, StructType([*schema.fields, StructField("members", ArrayType(member))]))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count`` (documents that hold the two ids linked) and ``best`` (none linked with ``a`` has more) of rows of
    ``a``, ``b``, ``docs``.  An id has at most as many partners as the other vocabulary has tokens."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def scored(docs: DataFrame, a: str, b: str, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all but the text, if none are named) and, for every text, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_shared`` (pairs that share a group), ``groups_sha256``, ``n_best`` (links whose count is the highest of their A id) and
    ``count_sum`` (counts of all links).  A link's count is the number of documents that hold its two ids linked.

    Texts without tokens (see ``alignments``) have zeros and an empty digest.  Rows alike are documents each; columns with
    the new names are replaced; no rows give none.  Only distinct pairs of chunks are shuffled by pair, so a pair that
    all documents hold has as many rows as there are chunks.
    """
    new = (*_COUNTS, "n_best", "count_sum", "groups_sha256")
    keep = list(keep) if keep is not None else [c for c in docs.columns if c not in (text, *new)]
    held = materialise(_chunked(docs, a, b, text, keep), "aligned-chunks")
    pairs = held.select("chunk", F.posexplode("pairs").alias("k", "pair")).select("chunk", "k", "pair.*")
    back = pairs.select("chunk", "k", "a", "b").join(pair_counts(pairs), ["a", "b"])
    back = back.groupBy("chunk").agg(F.collect_list(F.struct("k", "count", "best")).alias("found"))
    met = held.select("chunk", "which", "times", "members").join(back, "chunk", "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                which, times, members, found = (batch.column(c)[row].values for c in ("which", "times", "members", "found"))
                n = 0 if found is None else len(found)
                count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if n:
                    order = found.field("k").to_numpy()
                    count[order], best[order] = found.field("count").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
                which, times = which.to_numpy(), times.to_numpy().astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(members.field("size").to_numpy())))
                sums = [np.diff(np.concatenate(([0], np.cumsum(times * values[which])))[ends]) for values in (best, count)]
                own = [members.field(c) for c in (*_COUNTS, "groups_sha256")]
                yield pa.RecordBatch.from_arrays([*[members.field("kept").field(c) for c in keep], *own, *[pa.array(s, pa.int64()) for s in sums]], names=[*keep, *_COUNTS, "groups_sha256", "n_best", "count_sum"])

    kinds = dict.fromkeys(_COUNTS, "bigint") | {"groups_sha256": "string", "n_best": "bigint", "count_sum": "bigint"}
    return met.select("which", "times", "members", "found").mapInArrow(run, with_fields(docs.select(*keep), **kinds))
