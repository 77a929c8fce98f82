"""Benchmark decontamination by q-gram lemma filtering.

An occurrence of an item of ``m`` code points with at most ``k`` edits shares at least ``m - q + 1 - k q`` q-grams with the
item, on diagonals that differ by ``k`` at most.  Shared q-grams are counted in bands of ``2 (k + 1)`` diagonals that overlap
by half; bands that reach the bound are verified by an alignment confined to the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 9
#: Edits allowed for each code point of an item.
EDIT_RATE = 0.08
#: Shared q-grams asked for at least; a short item is allowed fewer edits for it.
LEAST_SHARED = 4
#: Items of fewer normalised code points are searched for without edits, at word bounds.
MIN_ITEM = 24
#: Items of half as much again are searched for by their segments too, of which each sign is in two; shorter ones, from half as
#: much again as ``MIN_ITEM``, by stretches of two thirds.
SEGMENT = 64


def segments(size: int) -> list[tuple[int, int]]:
    """Start and length of the parts of an item of ``size`` code points that are searched for."""
    if 2 * size >= 3 * SEGMENT:
        last = size - SEGMENT
        return [(at, SEGMENT) for at in [*range(0, last, SEGMENT // 2), last]]
    if 2 * size >= 3 * MIN_ITEM:
        own = max(MIN_ITEM, -(-2 * size // 3))
        return [(at, own) for at in sorted({0, (size - own) // 2, size - own})]
    return []


#: Code points by which short items are looked up.
PREFIX = 8
#: Normalised code points of benchmark text that are searched for in one pass; a larger benchmark takes several.
BLOCK = 8_000_000
#: Code points of documents worked on at a time.
PART = 1 << 17

_FAR = 1 << 40
_SPACE = 32


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Which code points are letters or digits, once made; travels with the functions that use it.
_ALPHANUMERIC: list[np.ndarray] = []


def _alphanumeric() -> np.ndarray:
    if not _ALPHANUMERIC:
        _ALPHANUMERIC.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _ALPHANUMERIC[0]


def _kept(lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with each run of others than letters and digits as one space, none at the ends, and which were kept."""
    signs = np.where(_alphanumeric()[lowered], lowered, np.uint32(_SPACE))
    keep = signs != _SPACE
    keep[:-1] |= keep[1:]  # the last of a run that a word follows
    if len(signs):
        keep[: int((signs != _SPACE).argmax())] = False
    return signs[keep], np.flatnonzero(keep)


def normal(text: str) -> np.ndarray:
    """Code points in lower case, with one space for each run of signs that are neither letter nor digit."""
    return _kept(points(text.lower()))[0]


def places(text: str) -> np.ndarray:
    """For each code point of ``normal(text)``, its index in ``text``."""
    kept = _kept(points(text.lower()))[1]
    lengths = [len(sign.lower()) for sign in text]
    return kept if sum(lengths) == len(text) else np.repeat(np.arange(len(text)), lengths)[kept]


def grams(signs: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the ``q`` code points from each place; equal q-grams have equal hashes."""
    if len(signs) < q:
        return np.zeros(0, np.uint64)
    power, size = signs.astype(np.uint64), 1  # hashes of 1, 2, 4 ... code points, joined as the bits of q say
    whole, done = None, 0
    while True:
        if q & size:
            n = len(signs) - q + 1
            part = power[done : done + n]
            whole, done = part if whole is None else whole * np.uint64(0x165667B19E3779F9) + (part ^ (part >> np.uint64(29))), done + size
        if done == q:
            return whole * np.uint64(0xD6E8FEB86659FD93) ^ (whole >> np.uint64(32))
        power = power[:-size] * np.uint64(0x9E3779B97F4A7C15) + (power[size:] ^ (power[size:] >> np.uint64(29)))
        size *= 2


class Index:
    """Q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, np.ndarray]], edit_rate: float = EDIT_RATE) -> None:
        self.ids, self.signs = [i for i, _ in items], [t for _, t in items]
        length = np.array([len(s) for s in self.signs], np.int64)
        self.length = length
        self.budget = np.clip(np.minimum((edit_rate * length).astype(np.int64), (length - Q + 1 - LEAST_SHARED) // Q), 0, None)
        self.bound = length - Q + 1 - Q * self.budget
        self.reach = int((length + self.budget).max(initial=0))
        # (shared q-grams, within code points) of items of about the same length: what a place needs around it to count
        classes: dict[int, tuple[int, int]] = {}
        for m, k, t in zip(length.tolist(), self.budget.tolist(), self.bound.tolist()):
            least, most = classes.get(m.bit_length() * 4 + (m >> max(0, m.bit_length() - 3) & 3), (_FAR, 0))
            classes[m.bit_length() * 4 + (m >> max(0, m.bit_length() - 3) & 3)] = min(least, t), max(most, m + k)
        self.classes = sorted(set(classes.values()))
        every = [grams(s) for s in self.signs]
        hashes = np.concatenate(every) if every else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(every)), [len(e) for e in every])
        offset = np.concatenate([np.arange(len(e)) for e in every]) if every else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.grams, self.first = np.unique(hashes[order], return_index=True)
        self.first = np.append(self.first, len(hashes))
        self.shift = np.uint64(64 - max(20, int(len(self.grams) * 16).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.grams >> self.shift] = True

    def hits(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``signs`` whose q-gram is one of the items', and which; only where they stand densely enough."""
        hashes = grams(signs)
        at = np.flatnonzero(self.table[hashes >> self.shift])
        found = np.searchsorted(self.grams, hashes[at])
        found[found == len(self.grams)] = 0
        same = self.grams[found] == hashes[at] if len(self.grams) else np.zeros(0, bool)
        at, found = at[same], found[same]
        keep = np.zeros(len(at), bool)
        for least, most in self.classes:
            if len(at) < least:
                continue
            seeds = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < most)
            mark = np.zeros(len(at) + 1, np.int64)
            np.add.at(mark, seeds, 1)
            np.add.at(mark, np.searchsorted(at, at[seeds] + most), -1)
            keep |= np.cumsum(mark)[:-1] > 0
        return at[keep], found[keep]

    def bands(self, at: np.ndarray, found: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(item, lowest diagonal) of the bands in which enough q-grams are shared; (item, diagonal) where all are."""
        many = self.first[found + 1] - self.first[found]
        entry = np.repeat(self.first[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item = self.item[entry]
        diagonal, half = np.repeat(at, many) - self.offset[entry], self.budget[item] + 1
        band = diagonal // half

        def often(item, place, least):
            keys, counts = np.unique(item * _FAR + place + _FAR // 2, return_counts=True)
            item = keys // _FAR
            enough = counts >= least[item]
            return list(zip(item[enough].tolist(), (keys - item * _FAR - _FAR // 2)[enough].tolist()))

        reached = often(np.concatenate((item, item)), np.concatenate((band, band - 1)), self.bound)
        if not reached:
            return [], []
        return [(i, b * int(self.budget[i] + 1)) for i, b in reached], often(item, diagonal, self.length - Q + 1)

    def align(self, item: int, signs: np.ndarray, low: int) -> tuple[int, int, int]:
        """Fewest edits, start and end of the item in ``signs``, on the diagonals of the band from ``low`` and ``k`` beside it."""
        budget, own = int(self.budget[item]), self.signs[item]
        low -= budget
        width = 2 * (budget + 1) + 2 * budget
        padded = np.zeros(len(own) + width, np.int64)
        a, b = max(0, low), min(len(signs), low + len(own) + width)
        padded[a - low : b - low] = signs[a:b]
        one, columns = 1 << 32, np.arange(width, dtype=np.int64)
        along = columns * one
        held = columns.copy()  # edits in the high bits, start in the low ones
        for i, sign in enumerate(own.tolist()):
            new = held + np.where(padded[i : i + width] == sign, 0, one)
            np.minimum(new[:-1], held[1:] + one, out=new[:-1])
            held = np.minimum.accumulate(new - along) + along
        end = int(held.argmin())
        edits, start = divmod(int(held[end]), one)
        return edits, max(0, low + start), min(len(signs), low + len(own) + end)

    def regions(self, signs: np.ndarray, at: np.ndarray, found: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best verified occurrences that do not overlap others of their item."""
        if not len(at):
            return []
        verified: dict[int, list] = {}
        bands, whole = self.bands(at, found)
        for item, low in whole:
            if low >= 0 and np.array_equal(signs[low : low + self.length[item]], self.signs[item]):
                verified.setdefault(item, []).append((0, low, low + int(self.length[item])))
        for item, low in bands:
            budget = int(self.budget[item])
            if any(not e and low <= s < low + 2 * (budget + 1) for e, s, _ in verified.get(item, ())):
                continue  # nothing in this band is better than the occurrence without edits, and all overlap it
            edits, start, end = self.align(item, signs, low)
            if edits <= budget:
                verified.setdefault(item, []).append((edits, start, end))
        out = []
        for item, all_ in sorted(verified.items()):
            chosen: list[tuple[int, int]] = []
            for edits, start, end in sorted(all_):
                if all(end <= s or e <= start for s, e in chosen):
                    chosen.append((start, end))
                    out.append((item, start, end, edits))
        return out

    def search(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """``regions`` of each normalised text; many short ones at a time, a long one in overlapping parts."""
        out: list[list] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > PART:
                over, all_ = 4 * self.reach, set()
                for k in range(0, len(text), PART):
                    all_ |= {(i_, s + k, e + k, d) for i_, s, e, d in self._alone(text[k : k + PART + over])}
                chosen: dict[int, list] = {}
                for item, s, e, d in sorted(all_, key=lambda r: (r[3], r[1])):
                    if all(e <= x or y <= s for x, y in chosen.setdefault(item, [])):
                        chosen[item].append((s, e))
                        out[i].append((item, s, e, d))
                continue
            held.append(i)
            size += len(text) + 1
            if size > PART:
                self._together(texts, held, out)
                held, size = [], 0
        self._together(texts, held, out)
        return out

    def _together(self, texts, held, out) -> None:
        if not held:
            return
        signs = np.concatenate([x for i in held for x in (texts[i], np.zeros(1, np.uint32))])
        starts = np.cumsum([0] + [len(texts[i]) + 1 for i in held])
        at, found = self.hits(signs)
        cuts = np.searchsorted(at, starts)
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            here = slice(cuts[k], cuts[k + 1])
            out[held[k]] = self.regions(signs[starts[k] : starts[k + 1] - 1], at[here] - starts[k], found[here])

    def _alone(self, signs: np.ndarray) -> list[tuple[int, int, int, int]]:
        return self.regions(signs, *self.hits(signs))


#: Scripts that write words without spaces: no bound is asked for beside their signs.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xFFDC), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))


def _spaced(signs: np.ndarray) -> np.ndarray:
    """Which signs belong to words that spaces divide."""
    out = signs != _SPACE
    for first, last in _UNSPACED:
        out &= (signs < first) | (signs > last)
    return out


class Exact:
    """Short items, found as they are."""

    def __init__(self, items: list[tuple[object, np.ndarray]]) -> None:
        self.items: dict[bytes, list] = {}
        for id_, signs in items:
            self.items.setdefault(signs.tobytes(), []).append(id_)
        self.prefixes: dict[int, tuple[np.ndarray, dict[bytes, set[int]]]] = {}
        for own in self.items:
            size = min(PREFIX, len(own) // 4)
            table, lengths = self.prefixes.setdefault(size, (np.zeros(1 << 20, bool), {}))
            table[grams(np.frombuffer(own, np.uint32)[:size], size) >> np.uint64(44)] = True
            lengths.setdefault(own[: 4 * size], set()).add(len(own) // 4)

    def search(self, signs: np.ndarray) -> list[tuple[object, int, int, int]]:
        """(item, start, end, 0) of the occurrences at word bounds that do not overlap an earlier one of their item."""
        found = []
        for size, (table, lengths) in self.prefixes.items():
            for k in range(0, len(signs), PART):
                at = k + np.flatnonzero(table[grams(signs[k : k + PART + size - 1], size) >> np.uint64(44)])
                at = at[~(_spaced(signs[np.maximum(at - 1, 0)]) & _spaced(signs[at]) & (at > 0))]
                for start in at.tolist():
                    for length in lengths.get(signs[start : start + size].tobytes(), ()):
                        end = start + length
                        ids = self.items.get(signs[start:end].tobytes(), ()) if end <= len(signs) else ()
                        if ids and not (end < len(signs) and _spaced(signs[end - 1 : end + 1]).all()):
                            found += [(start, end, n, id_) for n, id_ in enumerate(ids)]
        out, last = [], {}
        for start, end, n, id_ in sorted(found, key=lambda r: r[:3]):
            own = (signs[start:end].tobytes(), n)
            if start >= last.get(own, 0):
                last[own] = end
                out.append((id_, start, end, 0))
        return out


class Search:
    """All items of a block: short ones as they are, long ones as a whole and by their segments."""

    def __init__(self, block: list[tuple[object, np.ndarray]], edit_rate: float = EDIT_RATE) -> None:
        long = [(i, s) for i, s in block if len(s) >= MIN_ITEM]
        self.exact = Exact([(i, s) for i, s in block if len(s) < MIN_ITEM])
        self.whole, parts = len(long), []
        self.owner = list(range(len(long)))
        for k, (id_, signs) in enumerate(long):
            for at, own in segments(len(signs)):
                parts.append((id_, signs[at : at + own]))
                self.owner.append(k)
        self.index = Index(long + parts, edit_rate)

    def search(self, texts: list[np.ndarray]) -> list[list[tuple[object, int, int, int]]]:
        """(item, start, end, edits) for each text.  Segments within a whole occurrence of their item tell nothing new; others
        that overlap are one partial occurrence, whose edits are the most that one of its segments has."""
        out = []
        for text, regions in zip(texts, self.index.search(texts)):
            rows, parts, whole = [], {}, {}
            for k, start, end, edits in regions:
                if k < self.whole:
                    rows.append((self.index.ids[k], start, end, edits))
                    whole.setdefault(k, []).append((start, end))
                else:
                    parts.setdefault(self.owner[k], []).append((start, end, edits))
            for k, own in sorted(parts.items()):
                joined: list[list[int]] = []
                for start, end, edits in sorted(own):
                    if any(start < e and s < end for s, e in whole.get(k, ())):
                        continue
                    if joined and start < joined[-1][1]:
                        joined[-1][1:] = max(end, joined[-1][1]), max(edits, joined[-1][2])
                    else:
                        joined.append([start, end, edits])
                rows += [(self.index.ids[k], *j) for j in joined]
            out.append(rows + self.exact.search(text))
        return out


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Normalised items, at most about ``BLOCK`` code points in memory at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        own = normal(row["t"])
        if not len(own):
            continue
        held.append((row["i"], own))
        size += len(own) + sum(n for _, n in segments(len(own)))
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``end`` (code points of the document's text), ``edits`` and ``region`` of every
    occurrence of a benchmark item in a document, whole or in part (see ``Search``).

    Empty and NULL texts have none; repeated documents give their regions each, repeated items are items each.  A stated
    benchmark against all documents: each block of items is broadcast (``BLOCK`` bounds it) and takes one pass, without
    shuffle.
    """
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start bigint, `end` bigint, edits int, region string"
    given, found = docs.select("doc_id", "text").where("text is not null"), None
    for block in _blocks(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import pyarrow as pa

            index = Search(shared.value, edit_rate)
            for batch in batches:
                texts, rows = batch.column("text"), []
                for i, regions in enumerate(index.search([normal(t.as_py()) for t in texts])):
                    if not regions:
                        continue
                    text = texts[i].as_py()
                    where = places(text)
                    for item, start, end, edits in regions:
                        a, b = int(where[min(start, len(where) - 1)]), int(where[max(start, min(end, len(where)) - 1)]) + 1
                        rows.append((i, item, a, b, edits, text[a:b]))
                if rows:
                    who, *rest = zip(*rows)
                    ids = batch.column("doc_id").take(pa.array(who))
                    columns = [pa.array(r, t) for r, t in zip(rest, (None, pa.int64(), pa.int64(), pa.int32(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "start", "end", "edits", "region"])

        one = given.mapInArrow(run, schema)
        found = one if found is None else found.union(one)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without those in which a benchmark item occurs; NULL and empty texts stay."""
    out = docs
    for block in _blocks(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import pyarrow as pa

            index = Search(shared.value, edit_rate)
            for batch in batches:
                found = index.search([normal(t.as_py() or "") for t in batch.column("text")])
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
