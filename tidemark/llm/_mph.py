"""A minimal perfect hash over distinct 64-bit keys, as cascaded bit arrays with ranks, in numpy.

At each level a key sets the bit at its seeded hash; bits that two keys want stay empty and those keys go on to the next
level. The place of a key is the number of bits set before its own. Look-ups of keys that aren't in the set give an
arbitrary place or -1; callers compare a fingerprint stored there.
"""

from __future__ import annotations

import struct

import numpy as np

from tidemark.llm._text import mix

SPREAD, MAX_LEVELS = 2.0, 64
HEADER = b"MPH1"


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)


def build(keys: np.ndarray) -> list[np.ndarray]:
    """The bit array of each level, for distinct uint64 keys."""
    levels: list[np.ndarray] = []
    rest = keys
    while len(rest):
        if len(levels) == MAX_LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, -(-int(SPREAD * len(rest)) // 64) * 64)
        at = _slot(rest, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
    return levels


class Places:
    """Look-ups in the levels of build()."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, before = levels, [], 0
        for bits in levels:
            ranks = np.cumsum(bits) - bits + before
            before += int(bits.sum())
            self.ranks.append(ranks)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = _slot(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out


def pack(levels: list[np.ndarray], arrays: list[np.ndarray]) -> bytes:
    """Levels and the value arrays (in order of place) as one block of bytes."""
    parts = [HEADER, struct.pack("<II", len(levels), len(arrays))]
    parts += [struct.pack("<Q", len(x)) + np.packbits(x, bitorder="little").tobytes() for x in levels]
    parts += [struct.pack("<4sQ", x.dtype.str.encode().ljust(4), len(x)) + x.tobytes() for x in arrays]
    return b"".join(parts)


def unpack(block: bytes) -> tuple[Places, list[np.ndarray]]:
    if block[:4] != HEADER:
        raise ValueError("not a block of a minimal perfect hash")
    n_levels, n_arrays = struct.unpack_from("<II", block, 4)
    at, levels, arrays = 12, [], []
    for _ in range(n_levels):
        (size,) = struct.unpack_from("<Q", block, at)
        levels.append(np.unpackbits(np.frombuffer(block, np.uint8, size // 8, at + 8), bitorder="little").astype(bool))
        at += 8 + size // 8
    for _ in range(n_arrays):
        kind, size = struct.unpack_from("<4sQ", block, at)
        dtype = np.dtype(kind.decode().strip())
        arrays.append(np.frombuffer(block, dtype, size, at + 12))
        at += 12 + size * dtype.itemsize
    return Places(levels), arrays
