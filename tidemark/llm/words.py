"""Words and word shingles of whole texts as 64-bit hashes, vectorised over the bytes of an Arrow column.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Equal words have equal hashes: a word's
eight-byte parts are mixed each with a key of its place, and the sum is mixed again. Different words of up to eight bytes and
the same length never collide, others with probability 2**-64, whatever their pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first n of eight bytes, as a little-endian number.
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes worked on at once, unless one text is longer.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Multipliers of the words of a shingle.
POWERS = np.cumprod(np.full(256, BASE))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` bytes at most, or one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in ``data[at[0]:at[-1]]``, the first word of each row (n + 1 numbers), and where words begin and end, in bytes from at[0]."""
    own, at = data[at[0] : at[-1]], at - at[0]
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[own]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), starts, ends
    lengths = ends - starts
    eight = np.ndarray(len(own), "<u8", np.concatenate([LOWER[own], np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from every place on
    value = mix((eight[starts] & MASK[np.minimum(lengths, 8)]) ^ BASE) + lengths.astype(np.uint64) * BASE
    if len(more := np.flatnonzero(lengths > 8)):
        n = (lengths[more] - 1) // 8
        first = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(first, n) + 1
        part = eight[np.repeat(starts[more], n) + 8 * k] & MASK[np.minimum(np.repeat(lengths[more], n) - 8 * k, 8)]
        value[more] += np.add.reduceat(mix(part ^ mix(k.astype(np.uint64) * BASE)), first)
    return mix(value), np.searchsorted(starts, at), starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; fewer words are one shingle, none give none."""
    if not len(words):
        return words
    if len(words) < k:
        return mix(np.bitwise_xor.reduce(words * POWERS[: len(words)], keepdims=True) + np.uint64(len(words)))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * POWERS[i]
    return mix(out + np.uint64(k))
