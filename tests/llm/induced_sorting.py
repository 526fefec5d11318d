"""External induced sorting of one shard of documents: the method that op6_repeated_bytes replaces, kept as its oracle.

A priority queue with runs on disk carries (symbol and type, rank of the suffix behind, position) through the two
inductions; substrings between local minima are named and sorted by recursion. Neighbouring suffixes are compared after
the sort, so their common prefixes are not carried along.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np


class RunQueue:
    """A priority queue of integer triples that keeps at most `most` of them in memory and the rest in sorted runs."""

    def __init__(self, items: Iterable[tuple[int, int, int]], most: int = 1 << 16):
        self.heap: list[tuple[int, int, int]] = []
        self.heads: list[tuple[tuple[int, int, int], int]] = []
        self.runs: list[Iterator[tuple[int, int, int]]] = []
        self.most = most
        for x in items:
            self.push(x)

    def push(self, x: tuple[int, int, int]) -> None:
        if len(self.heap) >= self.most:
            self._spill()
        heapq.heappush(self.heap, x)

    def _spill(self) -> None:
        self.heap.sort()
        keep = len(self.heap) // 16  # the smallest are wanted soon
        file = tempfile.TemporaryFile()
        np.array(self.heap[keep:], dtype=np.int64).tofile(file)
        file.seek(0)
        del self.heap[keep:]
        self.runs.append(self._read(file))
        heapq.heappush(self.heads, (next(self.runs[-1]), len(self.runs) - 1))

    @staticmethod
    def _read(file) -> Iterator[tuple[int, int, int]]:
        with file:
            while data := file.read(24 << 12):
                yield from map(tuple, np.frombuffer(data, dtype=np.int64).reshape(-1, 3).tolist())

    def pop(self) -> tuple[int, int, int] | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            x, i = self.heads[0]
            after = next(self.runs[i], None)
            if after is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, i))
            return x
        return heapq.heappop(self.heap) if self.heap else None


def _induced(t: list[int], minima: list[int], most: int) -> list[int]:
    """All positions in suffix order, from local minima that are sorted (or, for names, grouped by symbol)."""
    queue = RunQueue(((2 * t[p] + 1, i, p) for i, p in enumerate(minima)), most)
    falling, k = [], 0
    while x := queue.pop():
        key, _, p = x
        if not key & 1:
            falling.append(p)
        if p and (t[p - 1] > t[p] or t[p - 1] == t[p] and not key & 1):
            queue.push((2 * t[p - 1], k, p - 1))
        k += 1
    queue = RunQueue(((-2 * t[p] + 1, i, p) for i, p in enumerate(reversed(falling))), most)
    order, k = [], 0
    while x := queue.pop():
        key, _, p = x
        order.append(p)
        if p and (t[p - 1] < t[p] or t[p - 1] == t[p] and not key & 1):
            queue.push((-2 * t[p - 1], k, p - 1))
        k += 1
    order.append(len(t) - 1)
    return order[::-1]


def suffix_order(t: list[int], most: int = 1 << 16) -> list[int]:
    """Positions of t in suffix order; the last symbol is the smallest and occurs once."""
    n = len(t)
    if n < 2:
        return list(range(n))
    rises = [True] * n
    for p in range(n - 2, -1, -1):
        rises[p] = t[p] < t[p + 1] or t[p] == t[p + 1] and rises[p + 1]
    minima = [p for p in range(1, n) if rises[p] and not rises[p - 1]]
    if len(minima) > 1:
        end = dict(zip(minima, [*minima[1:], n - 1]))
        is_minimum = set(minima)
        names, name, last = {}, -1, None
        for p in _induced(t, minima, most):
            if p in is_minimum:
                part = t[p : end[p] + 1]
                name += part != last
                names[p], last = name, part
        reduced = [names[p] for p in minima]
        if name + 1 < len(minima):
            minima = [minima[i] for i in suffix_order(reduced, most)]
        else:
            minima = sorted(minima, key=names.__getitem__)
    return _induced(t, minima, most)


def removed(texts: list[bytes], length: int, most: int = 1 << 16) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of every text of a shard."""
    m, t, base = len(texts), [], []
    for i, x in enumerate(texts):
        base.append(len(t))
        t += [b + m for b in x]
        t.append(m - 1 - i)  # its own end, so that no match crosses it
    order = suffix_order(t, most)
    rank = np.empty(len(t), dtype=np.int64)
    rank[order] = np.arange(len(t))
    repeats, same = np.zeros(len(t) + 1, dtype=np.int64), 0
    for p in range(len(t)):  # a suffix shares at most one symbol less with its neighbour than the suffix before it
        if not rank[p]:
            same = 0
            continue
        q = order[rank[p] - 1]
        while t[p + same] == t[q + same]:
            same += 1
        if same >= length:
            for s in (p, q):
                repeats[s] = 1
        same = max(0, same - 1)
    out = []
    for x, at in zip(texts, base):
        cover = np.zeros(len(x) + 1, dtype=np.int64)
        for s in np.flatnonzero(repeats[at : at + len(x)]):
            cover[s] += 1
            cover[s + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(x, dtype=np.uint8)[~gone].tobytes()
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
