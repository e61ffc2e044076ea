"""Vectorised views of Arrow text columns: byte buffers, words, chunks and 64-bit hashes.

All helpers work on whole texts. A batch is cut into slices of whole documents so that the eight-byte temporaries stay
small; a slice holds one document at least, however long. Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: The white space of the contracts: [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(20240611))
#: One random odd 64-bit value a byte; hashes are sums of these values times powers of BASE, modulo 2**64.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES_FOLDED = BYTE_VALUES.copy()
BYTE_VALUES_FOLDED[65:91] = BYTE_VALUES[97:123]
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; the longest table so far is kept."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one more for the end)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; folded: A-Z count as a-z."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_VALUES_FOLDED if folded else BYTE_VALUES)[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and how many words come before each document."""
    n = len(data)
    word = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~word[:-1]
    after[:-1] |= ~word[1:]
    starts = np.flatnonzero(word & before)
    return starts, np.flatnonzero(word & after) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes, by where it begins."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD1342543DE82EF95)
        out += words[k : k + len(out)]
    return mix(out)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of n words, A-Z lower-cased; with fewer words one hash of all of
    them, without any an empty array."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, at)
        words = span_hashes(part, starts, ends, folded=True)
        shingles = shingle_hashes(words, n)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                own = np.sort(shingles[a : b - n + 1])
                yield own if len(own) < 2 else own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                yield mix(shingle_hashes(words[a:b], int(b - a)) ^ np.uint64(0xA5A5A5A5 + int(b - a)))
            else:
                yield np.zeros(0, np.uint64)
