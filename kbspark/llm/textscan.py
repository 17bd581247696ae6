"""Vectorised byte scanning of Arrow string columns.

The kernels work on the UTF-8 buffer of a whole Arrow batch, a bounded slice of
documents at a time, so that a task's memory does not depend on the number of
rows in a batch.  Words are 64-bit numbers: a multilinear hash of their bytes,
mixed with the length, computed with prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds; a longer single document is a slice of its own.
SLICE_BYTES = 1 << 21
#: Bytes over which one prefix sum runs.
_SEGMENT = 1 << 17

_factors: list[np.ndarray] = []


def _multipliers(first: int, n: int) -> np.ndarray:
    """Random odd numbers for the positions ``first`` to ``first + n - 1`` of a word."""
    if first == 0 and n <= _SEGMENT:
        if not _factors:
            _factors.append(seeded(np.arange(_SEGMENT, dtype=np.uint64), 11) | np.uint64(1))
        return _factors[0][:n]
    return seeded(np.arange(first, first + n, dtype=np.uint64), 11) | np.uint64(1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry boolean table that is true within the given byte ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Everything but ASCII white space.
NOT_SPACE = ~byte_class((0x09, 0x0D), (0x20, 0x20))
#: Digits, lower-case letters and all bytes of non-ASCII characters.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche permutation of 64-bit numbers."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, size: int = SLICE_BYTES):
    """Row ranges [a, b) of consecutive documents of at most ``size`` bytes together, one document at least."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(int(np.searchsorted(at, at[a] + size, "right")) - 1, a + 1)
        b = min(b, n)
        yield a, b
        a = b


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``; starts ascend and spans do not overlap.

    Every position of a span has a random multiplier of its own (multilinear
    hashing), so no regular pattern of bytes makes two spans equal.
    """
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            j = max(int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")), i + 1)
            low, high = int(starts[i]), int(ends[j - 1])
            if high - low > _SEGMENT:
                total = np.uint64(0)
                for a in range(low, high, _SEGMENT):
                    part = data[a : min(a + _SEGMENT, high)]
                    total = total + (_multipliers(a - low, len(part)) * (part.astype(np.uint64) + np.uint64(1))).sum(dtype=np.uint64)
                out[i] = total + np.uint64(high - low) * np.uint64(0xD6E8FEB86659FD93)
            else:
                s, e = starts[i:j] - low, ends[i:j] - low
                place = np.arange(high - low) - np.repeat(s, np.diff(np.append(s, high - low)))
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(_multipliers(0, _SEGMENT)[place] * (data[low:high].astype(np.uint64) + np.uint64(1)), out=sums[1:])
                out[i:j] = sums[e] - sums[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            i = j
    return mix(out)


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes within each document of a slice.

    ``data`` holds the bytes from ``at[0]`` on, already folded.  Returns starts
    and ends relative to ``data`` and the number of words of each document.
    """
    at = at - at[0]
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = inside[data]
    # A document's first byte starts a word although the byte before may be a word byte of its predecessor.
    first = at[:-1][np.diff(at) > 0]
    starts = mask[1:-1] & ~mask[:-2]
    starts[first] = mask[first + 1]
    ends = mask[1:-1] & ~mask[2:]
    last = first[1:] - 1
    ends[last] = mask[last + 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def word_hashes(column: pa.Array, inside: np.ndarray, size: int = SLICE_BYTES):
    """For each slice of the column: (a, b, hashes of all words in order, number of words of each document)."""
    raw, at = string_buffers(column)
    for a, b in slices(at, size):
        data = LOWER[raw[at[a] : at[b]]]
        starts, ends, counts = words(data, at[a : b + 1], inside)
        yield a, b, hash_spans(data, starts, ends), counts


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """``mix`` under a seed, vectorised over ``x``."""
    with np.errstate(over="ignore"):
        return mix(np.asarray(x, np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64((seed * 0xA24BAED4963EE407 + 0x1B873593CC9E2D51) & (2**64 - 1)))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (order matters); none if there are fewer than ``k``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out *= np.uint64(0x5851F42D4C957F2D)
            out += hashes[i : i + n]
    return mix(out)


def unit(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from the upper 52 bits."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
