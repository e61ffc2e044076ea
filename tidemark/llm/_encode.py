"""Tokens of many texts by way of their distinct chunks.

A text is cut where no token can reach across; each distinct chunk is encoded once by the tokenizers library and the ids are
put together with numpy. The cache lives as long as the Python worker and is emptied when it is full. Chunks are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidemark.llm import _text

CACHE_CHUNKS = 1_500_000
LATE_CHUNKS = 100_000
#: Chunks that the library encodes at once: its objects are large.
BATCH_CHUNKS = 4096
JOINED_CHUNKS = 256
FIRST = np.uint64(0x5851F42D4C957F2D)


def gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """pool[start:start+count] of each pair, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


def cuts_before_white(data: np.ndarray) -> np.ndarray:
    """Where white space begins after a character that is surely none: ASCII 33 to 126 or a character whose lead byte has no
    white space among its characters (all but C2, E1, E2, E3)."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    at = np.flatnonzero(_text.WHITE[data[1:]]) + 1
    last = data[at - 1]
    safe = (last > 32) & (last < 127)
    two, three, four = (data[np.maximum(at - k, 0)] for k in (2, 3, 4))
    safe |= (last >= 128) & ((two >= 0xC3) & (two <= 0xDF) | (two & 0xC0 == 0x80) & ((three == 0xE0) | (three >= 0xE4) & (three <= 0xEF) | (three & 0xC0 == 0x80) & (four >= 0xF0)))
    out[at[safe]] = True
    return out


def cuts_before_space(data: np.ndarray) -> np.ndarray:
    """Where a run of spaces begins."""
    out = np.zeros(len(data), bool)
    out[1:] = (data[1:] == 32) & (data[:-1] != 32)
    return out


class ChunkEncoder:
    """encode: ids of a list of texts. prefix: what comes before the first chunk of each text that isn't empty. lengths: the
    bytes of each id, if ids cover the bytes of a text in order; then chunks that can't touch are encoded many at a time and
    told apart by their lengths."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], cuts: Callable[[np.ndarray], np.ndarray], prefix: str = "", lengths: np.ndarray | None = None):
        self.encode, self.cuts, self.prefix, self.lengths = encode, cuts, prefix, lengths
        self._empty()

    def _empty(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        # What was learned lately is kept apart, so that the large arrays are rebuilt rarely.
        self.known, self.late = none, none
        self.pool, self.pooled = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _with(table: tuple, new: tuple) -> tuple:
        at = np.searchsorted(table[0], new[0])
        return tuple(np.insert(x, at, y) for x, y in zip(table, new, strict=True))

    def _one_by_one(self, chunks: list[str]) -> tuple[list[int], list[np.ndarray]]:
        counts, flats = [], []
        for a in range(0, len(chunks), BATCH_CHUNKS):
            ids = self.encode(chunks[a : a + BATCH_CHUNKS])
            counts += [len(x) for x in ids]
            flats.append(np.fromiter((x for own in ids for x in own), np.uint32))
        return counts, flats

    def _together(self, chunks: list[str]) -> tuple[list[int], list[np.ndarray]]:
        groups = [chunks[a : a + JOINED_CHUNKS] for a in range(0, len(chunks), JOINED_CHUNKS)]
        counts, flats = [], []
        for a in range(0, len(groups), 16):
            for group, ids in zip(groups[a : a + 16], self.encode(["".join(x) for x in groups[a : a + 16]]), strict=True):
                ids = np.array(ids, np.uint32)
                ends = np.cumsum(self.lengths[ids])
                wanted = np.cumsum([len(x.encode()) for x in group])
                at = np.searchsorted(ends, wanted)
                if len(at) and at[-1] == len(ends) - 1 and (ends[at] == wanted).all():
                    counts += np.diff(at, prepend=-1).tolist()
                    flats.append(ids)
                else:
                    one = self._one_by_one(group)
                    counts += one[0]
                    flats += one[1]
        return counts, flats

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        if self.lengths is None:
            order = np.arange(len(chunks))
            counts, flats = self._one_by_one(chunks)
        else:
            apart = np.array([x[0] in " \t\n\v\f\r" and ("!" <= x[-1] <= "~" or "\xc0" <= x[-1] <= "\u07ff") for x in chunks], bool)
            order = np.concatenate((np.flatnonzero(apart), np.flatnonzero(~apart)))
            some = int(apart.sum())
            counts, flats = self._together([chunks[i] for i in order[:some]])
            rest = self._one_by_one([chunks[i] for i in order[some:]])
            counts, flats = counts + rest[0], flats + rest[1]
        flat, counts = np.concatenate([*flats, np.zeros(0, np.uint32)]), np.array(counts, np.int32)
        starts = np.zeros(len(chunks), np.int64)
        sizes = np.zeros(len(chunks), np.int32)
        starts[order], sizes[order] = self.pooled + np.cumsum(counts) - counts, counts
        if self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.pooled], np.zeros(max(len(flat), self.pooled), np.uint32)))
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        self.pooled += len(flat)
        self.late = self._with(self.late, (keys, starts, sizes))
        if len(self.late[0]) > LATE_CHUNKS:
            self.known, self.late = self._with(self.known, self.late), tuple(x[:0] for x in self.late)

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, starts, counts) of sorted keys."""
        found, starts, counts = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for table in (self.known, self.late):
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
                hit = table[0][at] == keys
                found |= hit
                starts[hit], counts[hit] = table[1][at[hit]], table[2][at[hit]]
        return found, starts, counts

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = self.cuts(data)
        first = np.zeros(len(data), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut | first)
        ends = np.append(starts[1:], len(data))
        hashes = _text.span_hashes(data, starts, ends)
        if self.prefix:
            hashes[first[starts]] ^= FIRST
        keys, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known[0]) > CACHE_CHUNKS:
            self._empty()
        found, _, _ = self._look_up(keys)
        if not found.all():
            some = sample[~found]
            view = memoryview(np.ascontiguousarray(data))
            lead = first[starts[some]]
            self._learn(keys[~found], [(self.prefix if f else "") + str(view[a:b], "utf-8") for a, b, f in zip(starts[some].tolist(), ends[some].tolist(), lead.tolist(), strict=True)])
        _, begins, sizes = self._look_up(keys)
        counts = sizes[place]
        ids = gather(self.pool, begins[place], counts)
        sums = np.concatenate(([0], np.cumsum(counts)))
        edges = sums[np.searchsorted(starts, offsets)]
        return ids, np.diff(edges)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        parts = [self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _text.slices(offsets)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
