"""A cuckoo filter over 64-bit hashes, kept in a numpy array so that it travels as bytes.

Buckets hold four 16-bit fingerprints; 0 means free. An entry can be taken out again,
which a Bloom filter cannot do.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 500
_MULT = np.uint64(0x9E3779B97F4A7C15)


def buckets_for(n: int) -> int:
    """Bucket count (a power of two) that keeps n entries under 80 % load."""
    need = max(4, int(n / (SLOTS * 0.8)) + 1)
    return 1 << (need - 1).bit_length()


class CuckooFilter:
    def __init__(self, n_buckets: int, data: bytes | None = None):
        self.n = n_buckets
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if data is None else np.frombuffer(data, np.uint16).reshape(n_buckets, SLOTS).copy()

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, hashes: np.ndarray):
        h = hashes.astype(np.int64).view(np.uint64)
        mark = ((h >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        first = (h * _MULT >> np.uint64(32)) & np.uint64(self.n - 1)
        return mark, first.astype(np.int64), self._other(first.astype(np.int64), mark)

    def _other(self, bucket, mark):
        return (bucket ^ (np.asarray(mark).astype(np.int64) * 0x5BD1E995)) & (self.n - 1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """Adds one entry per hash. False: too full, the caller builds a larger one from the exact table."""
        mark, a, b = self._places(hashes)
        todo = np.arange(len(mark))
        for where in (a, b) * 2:  # free slots first, many at once; one winner for each bucket and pass
            for slot in range(SLOTS):
                if not len(todo):
                    return True
                free = todo[self.slots[where[todo], slot] == 0]
                won = free[np.unique(where[free], return_index=True)[1]]
                self.slots[where[won], slot] = mark[won]
                todo = np.setdiff1d(todo, won, assume_unique=True)
        rng = np.random.default_rng(len(mark))
        for i in todo:  # the rest moves others out of the way
            bucket, m = int(a[i]), mark[i]
            for _ in range(MAX_KICKS):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = m
                    break
                slot = int(rng.integers(SLOTS))
                m, self.slots[bucket, slot] = self.slots[bucket, slot], m
                bucket = int(self._other(bucket, m))
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Takes one entry out per hash; only hashes that were inserted may be given."""
        mark, a, b = self._places(hashes)
        for m, x, y in zip(mark, a, b, strict=True):
            for bucket in (x, y):
                at = np.flatnonzero(self.slots[bucket] == m)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break
