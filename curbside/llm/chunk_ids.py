"""Ids of many texts at once, by chunks that are remembered.

The texts of a batch lie one after the other in a byte array. Chunk starts are
found by array operations, each chunk gets a 64-bit hash from prefix sums, and
chunks that the worker has never met are encoded; the ids of a batch are then
gathered from the pool of remembered ids. The hash only proposes a remembered
chunk: its bytes are compared, and a chunk that merely shares a hash is encoded
for itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Chunks and bytes of them that a worker process remembers; it begins anew beyond either.
REMEMBERED, REMEMBERED_BYTES = 1_500_000, 64 << 20

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any piece follows; one more than there are bytes.

    Different pieces may share a hash, some of them by construction: it deals
    pieces to places and never says that two are equal.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def piece_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


class ChunkIds:
    """``starts`` marks chunk starts in a byte array.

    ``encode_many`` gives all ids of some chunks, the number of ids of each, and
    a mark of each, which is counted by text.
    """

    def __init__(self, starts: Callable[[np.ndarray], np.ndarray], encode_many: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self._starts, self._encode_many = starts, encode_many
        self._forget()

    def _forget(self) -> None:
        self._hash, self._place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by hash
        self._ids, self._used, self._known = np.zeros(1 << 16, np.int32), 0, 0
        self._bytes, self._filled = np.zeros(1 << 16, np.uint8), 0
        self._offset, self._count, self._mark, self._from, self._size = (np.zeros(1 << 14, kind) for kind in (np.int32, np.int32, np.int64, np.int64, np.int64))

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of chunks that are encoded now."""
        raw = data.tobytes()
        chunks = [raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        ids, counts, marks = self._encode_many(chunks)
        own = np.frombuffer(b"".join(chunks), np.uint8)
        while len(self._ids) < self._used + len(ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while len(self._bytes) < self._filled + len(own):
            self._bytes = np.concatenate([self._bytes, np.zeros_like(self._bytes)])
        at, to = self._known, self._known + len(chunks)
        while len(self._count) < to:
            self._offset, self._count, self._mark, self._from, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._offset, self._count, self._mark, self._from, self._size))
        self._ids[self._used : self._used + len(ids)] = ids
        self._bytes[self._filled : self._filled + len(own)] = own
        self._offset[at:to] = self._used + np.cumsum(counts) - counts
        self._count[at:to], self._mark[at:to], self._size[at:to] = counts, marks, end - start
        self._from[at:to] = self._filled + np.cumsum(end - start) - (end - start)
        self._used, self._filled, self._known = self._used + len(ids), self._filled + len(own), to
        return np.arange(at, to, dtype=np.int32)

    def _differing(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Chunks whose bytes aren't those of their place; chunks follow one another."""
        other = self._size[place] != size
        source = np.where(other, 0, self._from[place]) - start
        unlike = self._bytes[np.minimum(np.repeat(source, size) + np.arange(len(data)), len(self._bytes) - 1)] != data
        return np.flatnonzero(other | np.logical_or.reduceat(unlike, start))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each, marks of each); text i is data[bounds[i]:bounds[i + 1]]."""
        if not len(data):
            return np.zeros(0, np.int32), *(np.zeros(len(bounds) - 1, np.int64) for _ in range(2))
        start = self._starts(data)
        start[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(data))
        unique, first, inverse = np.unique(piece_hashes(prefix_hashes(data), at, end), return_index=True, return_inverse=True)
        if self._known > REMEMBERED or self._filled > REMEMBERED_BYTES:
            self._forget()
        near = np.minimum(np.searchsorted(self._hash, unique), max(0, len(self._hash) - 1))
        new = np.flatnonzero(self._hash[near] != unique) if len(self._hash) else np.arange(len(unique))
        if len(new):
            places, into = self._learn(data, at[first[new]], end[first[new]]), np.searchsorted(self._hash, unique[new])
            self._hash, self._place = np.insert(self._hash, into, unique[new]), np.insert(self._place, into, places)
        place = self._place[np.searchsorted(self._hash, unique)][inverse]
        odd = self._differing(data, at, end - at, place)
        if len(odd):
            place[odd] = self._learn(data, at[odd], end[odd])
        count = self._count[place].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        marks = np.concatenate([[0], np.cumsum(self._mark[place])])
        ids = self._ids[np.repeat(self._offset[place] - total[:-1], count) + np.arange(total[-1])]
        edges = np.searchsorted(at, bounds)
        return ids, np.diff(total[edges]), np.diff(marks[edges])
