"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1, made from its code point.  An n-gram binds (multiplies) the vectors of its
letters, each permuted (rolled) by its place; a text bundles (adds) its n-grams; a language's prototype bundles the texts
learnt for it.  A text gets the language whose prototype has the greatest cosine with its vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.frames import with_fields

DIMENSIONS = 1024
GRAM = 3
#: Code points worked on at a time; parts of a longer text overlap so that each of its n-grams is in one of them.
PART = 1_000_000
#: Up to so many distinct letters in a part, n-grams are counted in a table of all combinations.
DENSE_LETTERS = 128
UNKNOWN = "und"


class Letters:
    """Letter vectors and n-gram counts, kept for the length of a task."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, point: int) -> np.ndarray:
        """Vector of a letter; 0 stands for whatever lies between words."""
        found = self.vectors.get(point)
        if found is None:
            if len(self.vectors) > 50_000:
                self.vectors.clear()
            signs = np.random.Generator(np.random.PCG64(point)).integers(0, 2, self.dimensions, dtype=np.int8)
            found = self.vectors[point] = signs * np.int8(2) - np.int8(1)
        return found

    def counts(self, texts: list[str], owners: np.ndarray, n_owners: int, ends: list[tuple[bool, bool]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts (owner by n-gram) and vectors (n-gram by dimension) of the lower-cased texts' n-grams.

        ``ends`` tells for parts of texts whether the text begins and ends with them; nothing stands beside a part's other ends.
        """
        lowered = [t.lower() for t in texts] if ends is None else ["\0" * a + t.lower() + "\0" * b for t, (a, b) in zip(texts, ends)]
        lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2 * (ends is None)
        joined = "\0" + "\0\0".join(lowered) + "\0" if ends is None else "".join(lowered)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(self.is_letter[points], points, 0)
        text_of = np.repeat(np.arange(len(lowered)), lengths)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (text_of[1:] != text_of[:-1])
        points, text_of = points[keep], text_of[keep]
        letters, ids = _dense(points)
        if len(points) < GRAM:
            return np.zeros((n_owners, 0), np.float32), np.zeros((0, self.dimensions), np.float32)
        whole = text_of[GRAM - 1 :] == text_of[: -GRAM + 1]
        base = len(letters)
        code = np.zeros(len(ids) - GRAM + 1, np.int64)
        for k in range(GRAM):
            code = code * base + ids[k : len(ids) - GRAM + 1 + k]
        code, owner = code[whole], owners[text_of[GRAM - 1 :][whole]]
        if base <= DENSE_LETTERS:
            present = np.flatnonzero(np.bincount(code, minlength=1))
            place = np.zeros(base**GRAM, np.int64)
            place[present] = np.arange(len(present))
            place = place[code]
        else:
            present, place = np.unique(code, return_inverse=True)
        table = np.bincount(owner * len(present) + place, minlength=n_owners * len(present)).reshape(n_owners, -1)
        bound, rest = None, present
        own = np.stack([self.vector(int(p)) for p in letters])
        for k in range(GRAM):
            rolled = np.roll(own, k, axis=1)[rest % base]
            bound = rolled if bound is None else bound * rolled
            rest = rest // base
        return table.astype(np.float32), bound.astype(np.float32)


def _dense(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct code points in order, and each point's place among them."""
    top = int(points.max(initial=0)) + 1
    seen = np.zeros(top, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(top, np.int64)
    place[letters] = np.arange(len(letters))
    return letters, place[points]


_TWO_LETTERS = re.compile(r"[^\W\d_]{%d}" % (GRAM - 1))


def _cuts(lowered: str) -> list[int]:
    """Where a long lower-cased text is cut: behind as many letters as two neighbouring n-grams share."""
    cuts, at = [0], 0
    while (found := _TWO_LETTERS.search(lowered, at + PART - GRAM + 1)) and found.end() < len(lowered):
        at = found.end()
        if found[0].isalpha():
            cuts.append(at)
        else:
            at = found.start() + 1 - PART + GRAM - 1
    return cuts


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int], list[tuple[bool, bool]] | None]]:
    """Texts in groups of about ``PART`` code points, with the index of each; long ones are cut, each a group of its own."""
    held: list[str] = []
    whose: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) > PART:
            if held:
                yield held, whose, None
                held, whose, size = [], [], 0
            lowered = text.lower()
            cuts = _cuts(lowered)
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(lowered)])):
                yield [lowered[max(0, a - GRAM + 1) : b]], [i], [(k == 0, k == len(cuts) - 1)]
        elif text:
            held.append(text)
            whose.append(i)
            size += len(text)
            if size >= PART or len(held) >= 2000:
                yield held, whose, None
                held, whose, size = [], [], 0
    if held:
        yield held, whose, None


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language of ``docs`` (columns ``text``, ``lang``; rows with a NULL in either teach nothing).

    Each task adds up one vector of whole numbers per language, so the sums do not depend on the order; what reaches the
    driver is one vector per language.
    """

    def run(batches):
        import pyarrow as pa

        letters, sums = Letters(dimensions), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            numbers = {name: i for i, name in enumerate(names)}
            for texts, whose, ends in _parts(batch.column("text").to_pylist()):
                owners = np.array([numbers[langs[i]] for i in whose])
                table, vectors = letters.counts(texts, owners, len(names), ends)
                for name, total in zip(names, table.astype(np.float64) @ vectors):
                    sums[name] = sums.get(name, 0) + total
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()])], names=["lang", "vector"])

    parts = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(run, "lang string, vector array<double>")
    each = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("total"))
    whole = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("all"))
    return {r["lang"]: np.array(r["totals"]) for r in whole.select("lang", F.col("all.total").alias("totals")).collect()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine, negative ones as 0); columns of those names are replaced.

    ``und`` and 0 for a NULL text, one without a letter, and where nothing was learnt; equal cosines go to the first name.
    """
    names = sorted(prototypes)
    units = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]) if names else np.zeros((0, dimensions))
    kept = docs.drop("lang_pred", "score")

    def run(batches):
        import pyarrow as pa

        letters = Letters(dimensions)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            cosines, norms, lettered = np.zeros((len(texts), len(names))), np.zeros(len(texts)), np.zeros(len(texts), bool)
            cut: dict[int, np.ndarray] = {}
            for held, whose, ends in _parts(texts):
                first = whose[0]
                owners = np.array(whose) - first
                table, vectors = letters.counts(held, owners, int(owners[-1]) + 1, ends)
                sums = (table @ vectors).astype(np.float64)
                for k in range(len(sums)):
                    if len(texts[first + k]) > PART:
                        sums[k] = cut[first + k] = cut.get(first + k, 0) + sums[k]
                rows = slice(first, first + len(sums))
                cosines[rows], norms[rows] = sums @ units.T, np.linalg.norm(sums, axis=1)
                for i, t in zip(whose, held):
                    lettered[i] = lettered[i] or any(map(str.isalpha, t))
            cosines /= np.maximum(norms, 1e-12)[:, None]
            best = cosines.argmax(axis=1) if names else np.zeros(len(texts), int)
            known = lettered if names else np.zeros(len(texts), bool)
            pred = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = [min(1.0, max(0.0, float(c[b]))) if k else 0.0 for c, b, k in zip(cosines, best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = with_fields(kept, lang_pred="string", score="double")
    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that teach nothing: crc32 of the id as text leaves 2 by 4 (a NULL id counts as empty)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2
