"""Enhanced suffix array of a block of byte strings and its common-prefix interval tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Signs of 9 bits (0 ends a string) in the first key of a suffix.
FIRST = 7


class Suffixes:
    """Suffixes of at least ``least`` bytes of ``strings``, sorted, with the common prefixes of neighbours.

    ``order`` holds their starts in the joined strings, ``common[i]`` what suffix ``i`` shares with the one before it, capped
    at the ends of strings, so that nothing matches across them.  Places are 32-bit numbers: some 60 bytes of memory for
    each byte of strings of under 1,000 bytes.
    """

    def __init__(self, strings: list[bytes], least: int) -> None:
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        signs = np.zeros(int((lengths + 1).sum()) + FIRST, np.int16)
        for start, string in zip(self.starts.tolist(), strings):
            signs[start : start + len(string)] = np.frombuffer(string, np.uint8)
            signs[start : start + len(string)] += 1
        n = len(signs) - FIRST
        self.signs = signs
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), lengths + 1)
        rest = (self.starts + lengths).astype(np.int32)[self.owner]
        rest -= np.arange(n, dtype=np.int32)
        key = np.zeros(n, np.int64)
        for k in range(FIRST):
            key <<= 9
            key |= signs[k : k + n]
        levels, width, longest = [_classes(key)], FIRST, int(lengths.max(initial=0))
        del key
        while width < longest:
            before = levels[-1]
            # Only suffixes that still equal another one need a new key; the others keep their class.
            places = np.flatnonzero((np.bincount(before, minlength=n) > 1)[before]).astype(np.int32)
            if not len(places):
                break
            now = before.copy()
            now[places] = _refined(before, places, width)
            levels.append(now)
            width *= 2
        starts = np.flatnonzero(rest >= least).astype(np.int32)
        order = starts[np.argsort(levels[-1][starts], kind="stable")]
        common, a, b = np.zeros(max(0, len(order) - 1), np.int32), order[1:], order[:-1]
        for k in reversed(range(len(levels))):
            for _ in range(1 if k < len(levels) - 1 else 1 + longest // (FIRST << k)):
                x, y = a + common, b + common
                same = (x < n) & (y < n)
                same &= levels[k][np.minimum(x, n - 1, out=x)] == levels[k][np.minimum(y, n - 1, out=y)]
                common[same] += FIRST << k
        # the last few signs, one by one
        for _ in range(FIRST):
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            common[signs[x] == signs[y]] += 1
        self.order = order
        self.common = np.concatenate(([0], np.minimum(np.minimum(common, rest[a]), rest[b]))) if len(order) else common
        self.least = least

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of the intervals of suffixes that share ``least`` bytes or more, inner ones first."""
        stack: list[tuple[int, int]] = []
        common = self.common
        reached = np.flatnonzero(common >= self.least)
        previous = -2
        for i in reached.tolist():
            if i != previous + 1:
                yield from _close(stack, 0, previous)
                stack.clear()
            yield from self._step(stack, int(common[i]), i)
            previous = i
        yield from _close(stack, 0, previous)

    @staticmethod
    def _step(stack: list[tuple[int, int]], length: int, i: int) -> Iterator[tuple[int, int, int]]:
        first = i - 1
        while stack and stack[-1][0] > length:
            inner, first = stack.pop()
            yield inner, first, i - 1
        if not stack or stack[-1][0] < length:
            stack.append((length, first))

    def left(self) -> np.ndarray:
        """The sign before each suffix, in order; one of its own (negative) at the head of a string."""
        before = self.signs[self.order - 1]
        head = self.order == self.starts[self.owner[self.order]]
        return np.where(head, -1 - np.arange(len(self.order), dtype=np.int32), before)

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """Intervals whose suffixes do not all have the same sign before them: repeats that no sign on either side prolongs."""
        left = self.left()
        change = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
        for length, first, last in self.intervals():
            if change[last] > change[first]:
                yield length, first, last

    def groups(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """Length and all occurrences (string, offset) of every maximal repeat."""
        owner = self.owner[self.order]
        offset = self.order - self.starts[owner]
        return [(length, sorted(zip(owner[a : b + 1].tolist(), offset[a : b + 1].tolist()))) for length, a, b in self.maximal_repeats()]

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, offset and length of the longest maximal repeat at each place where one of them occurs."""
        longest = np.zeros(len(self.order), np.int32)
        free = np.arange(len(self.order) + 1)  # next suffix from here on that no inner interval has

        def find(i: int) -> int:
            root = i
            while free[root] != root:
                root = free[root]
            while free[i] != root:
                free[i], i = root, free[i]
            return root

        for length, first, last in self.maximal_repeats():
            i = find(first)
            while i <= last:
                longest[i], free[i] = length, i + 1
                i = find(i + 1)
        at = np.flatnonzero(longest)
        owner = self.owner[self.order[at]]
        return owner, self.order[at] - self.starts[owner], longest[at]


def _close(stack: list[tuple[int, int]], length: int, last: int) -> Iterator[tuple[int, int, int]]:
    while stack and stack[-1][0] > length:
        inner, first = stack.pop()
        yield inner, first, last


def _classes(key: np.ndarray) -> np.ndarray:
    """Rank of each key's first place in sorted order; equal keys have equal ranks."""
    order = np.argsort(key, kind="stable").astype(np.int32)
    out = np.empty(len(key), np.int32)
    out[order] = _heads(key[order])
    return out


def _heads(ordered: np.ndarray) -> np.ndarray:
    """For each of ``ordered`` values, the first place of those that equal it."""
    at = np.arange(len(ordered), dtype=np.int32)
    at[1:][ordered[1:] == ordered[:-1]] = 0
    return np.maximum.accumulate(at, out=at)


def _refined(classes: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Classes by twice the ``width`` of the suffixes at ``places``, where all those are that share their class."""
    n = len(classes)
    own, follows = classes[places], places + np.int32(width)
    pair = own.astype(np.int64)
    pair *= n + 1
    pair += np.where(follows < n, classes[np.minimum(follows, n - 1)] + np.int32(1), np.int32(0))
    order = np.argsort(pair, kind="stable").astype(np.int32)
    group = _heads(pair[order])
    del pair
    sorted_own = own[order]
    out = np.empty(len(places), np.int32)
    out[order] = sorted_own + group - _heads(sorted_own)
    return out
