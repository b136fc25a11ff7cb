"""A run-length compressed Burrows-Wheeler index with sampled run ends."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling from eight symbols up. text: uint8."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : n + i]
    depth = 8
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
    while rank[order[-1]] < n - 1 or depth == 8:
        second = np.zeros(n, np.int64)
        if depth == 8:  # a suffix that ends inside the packed symbols is less than one that goes on with zeros
            second[-8:] = np.arange(min(n, 8), 0, -1)
        if depth < n:
            second[: n - depth] = rank[depth:] + 9
        both = rank.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        order = np.argsort(both)
        ordered = both[order]
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        depth *= 2
    return order


#: Pairs of suffixes that are compared at once.
PAIRS = 1 << 14


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and at b share, compared byte by byte."""
    if len(a) > PAIRS:
        return np.concatenate([common_prefixes(text, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)])
    out = np.zeros(len(a), np.int64)
    live, step = np.flatnonzero(np.maximum(a, b) < len(text)), 32
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        room = np.minimum(step, len(text) - np.maximum(x, y))
        span = np.minimum(np.arange(step), room[:, None] - 1)
        differ = (text[x[:, None] + span] != text[y[:, None] + span]) | (np.arange(step) >= room[:, None])
        n = np.where(differ.any(1), differ.argmax(1), step)
        out[live] += n
        live = live[(n == step) & (np.maximum(x, y) + step < len(text))]
        step = min(256, 2 * step)
    return out


class RunIndex:
    """Texts joined by zero bytes, as runs of their Burrows-Wheeler transform with sampled run ends.

    Kept are, for each run, its symbol and first row, the text positions at its first and last
    row, and one length. That is all that matching statistics need. If the rows of two
    neighbouring suffixes lie in one run, the suffixes that are one symbol longer are
    neighbours too and share one symbol more. So the neighbour above a position, and what it
    shares with it, follow from those of the next position to the right that stands before the
    first row of a run; and the neighbour above that one stands before the last row of the run
    before it, in the order of runs by symbol.
    """

    def __init__(self, texts: list[bytes], least: int, usable: list[int]):
        """usable: how many first positions of each text may start a match."""
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(lengths + 1) - 1 - lengths
        self.size, self.least, self.usable = len(joined), least, np.array(usable, np.int64)
        rows = suffix_array(joined)
        before = np.where(rows == 0, 256, joined[rows - 1].astype(np.int64))  # nothing stands before the first position
        self.first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.symbol = before[self.first]
        last = np.r_[self.first[1:], len(before)] - 1
        self.sample_first, self.sample_last = rows[self.first], rows[last]
        at, above = self._ends()
        self.shared = common_prefixes(joined, at, above)

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For each run by symbol the position before its first row, and the neighbour above that.

        Above all stands the last zero byte alone.
        """
        order = np.argsort(self.symbol, kind="stable")
        order = order[self.symbol[order] < 256]
        return self.sample_first[order] - 1, np.r_[self.size - 1, self.sample_last[order[:-1]] - 1][: len(order)]

    def matching_statistics(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For positions of the joined texts their neighbours above, and how many symbols each shares with its own.

        A position is streamed from the sampled one at or after it; from right to left a match grows by a symbol.
        """
        ends, above = self._ends()
        order = np.argsort(ends)
        ends, above, shared = (np.r_[x[order], tail] for x, tail in ((ends, self.size), (above, self.size), (self.shared, 0)))
        k = np.searchsorted(ends, at)  # the last zero byte alone has none
        back, found = ends[k] - at, ends[k] < self.size
        return np.where(found, above[k] - back, -1), np.where(found, shared[k] + back, 0)

    def repeated(self) -> list[np.ndarray]:
        """For each text its positions whose next `least` symbols also start earlier.

        Positions whose matches are that long hang together, neighbour by neighbour; of each such
        interval the earliest usable position is the witness.
        """
        every = np.arange(self.size)
        above, shared = self.matching_statistics(every)
        top = np.where(shared >= self.least, above, every)
        for _ in range(self.size.bit_length()):  # each round doubles how far up a position looks
            top = top[top]
        at = np.concatenate([np.empty(0, np.int64), *(s + np.arange(k) for s, k in zip(self.starts, self.usable, strict=True))])
        earliest = np.full(self.size, self.size)
        np.minimum.at(earliest, top[at], at)
        again = at[earliest[top[at]] < at]
        cuts = np.searchsorted(again, np.r_[self.starts, self.size])
        return [again[a:b] - s for a, b, s in zip(cuts, cuts[1:], self.starts, strict=False)]
