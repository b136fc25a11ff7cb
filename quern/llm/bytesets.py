"""Vectorised word and shingle hashing over batches of UTF-8 texts.

Everything here works on one Arrow batch at a time: the texts of a batch are one
contiguous byte buffer, words are found by a byte table, and a word's hash is a
difference of prefix sums of a polynomial, so no Python loop touches a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Bytes of at most this many are hashed at once, which bounds a worker's memory.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, which: str = "up") -> np.ndarray:
    """Powers of BASE (or of its inverse) modulo 2**64, kept between calls."""
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = max(n, BLOCK + (1 << 16))
        step = np.full(size, BASE if which == "up" else INVERSE, np.uint64)
        step[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(step)
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """C with C[i] = sum of (data[j] + 1) * BASE**j over j < i."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), "down")[start] ^ (end - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK):
    """Ranges of rows whose texts together have about limit bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def slices(column: pa.Array, limit: int):
    """A text column as bytes and offsets of parts of about limit bytes each."""
    data, offsets = text_bytes(column)
    for i, j in blocks(offsets, limit):
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words stand before each text (one more than texts)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5):
    """For each text its shingle hashes, sorted and distinct.

    Words are runs of bytes other than blanks, with A-Z lower-cased. A text of fewer
    words than size has one shingle of all of them; one without words has none.
    """
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    hashes = span_hash(prefix_sums(low), starts, ends)
    joined = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        joined = mix(joined * BASE + hashes[i : len(hashes) - size + 1 + i]) if len(joined) else joined
    for k in range(len(offsets) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= size:
            yield np.unique(joined[a : b - size + 1])
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = mix(np.array([short * BASE + h], np.uint64))[0]
            yield np.array([short], np.uint64)
        else:
            yield np.empty(0, np.uint64)
