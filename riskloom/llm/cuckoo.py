"""Cuckoo filters in numpy: sets of 64-bit keys that allow insertion and deletion.

A key leaves a 16-bit mark in one of two buckets of four; either bucket leads to the other by the mark
alone. Buckets are filled from the left. Whole arrays of keys are placed round by round; where both
buckets are full, one mark a bucket is moved on.
"""

from __future__ import annotations

import numpy as np

SLOTS, MAX_ROUNDS, FILL = 4, 500, 0.85


class Full(Exception):
    """No room; build a larger filter from the exact keys."""


class CuckooFilter:
    def __init__(self, buckets: int, table: bytes = b"") -> None:
        self.buckets = buckets
        stored = np.frombuffer(table, np.uint16) if table else np.zeros(buckets * SLOTS, np.uint16)
        self.table = stored.reshape(buckets, SLOTS).copy()

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds the distinct ``keys``, with room for some more."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * FILL)))))
        while True:
            made = cls(buckets)
            try:
                made.insert(keys)
                return made
            except Full:
                buckets *= 2

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    def _hash(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mark = (x >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (x & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        step = (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)
        return bucket ^ (step & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, bucket = self._hash(keys)
        here = (self.table[bucket] == mark[:, None]).any(1)
        return here | (self.table[self._other(bucket, mark)] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Keys that are not held yet, each once. After ``Full`` the filter must be rebuilt."""
        mark, bucket = self._hash(keys)
        self._place(mark, bucket, np.zeros(len(mark), bool))

    def _place(self, mark: np.ndarray, bucket: np.ndarray, tried: np.ndarray) -> None:
        rng = np.random.default_rng(len(mark))
        for _ in range(MAX_ROUNDS):
            if not len(mark):
                return
            order = np.argsort(bucket, kind="stable")
            mark, bucket, tried = mark[order], bucket[order], tried[order]
            first = np.r_[True, bucket[1:] != bucket[:-1]]
            start = np.flatnonzero(first)
            rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
            slot = np.count_nonzero(self.table[bucket], axis=1) + rank
            fits = slot < SLOTS
            self.table[bucket[fits], slot[fits]] = mark[fits]
            mark, bucket, tried = mark[~fits], bucket[~fits], tried[~fits]
            # First to the other bucket; from there one a bucket puts out a mark already in place.
            moving = ~tried
            bucket[moving] = self._other(bucket[moving], mark[moving])
            tried[moving] = True
            stuck = np.flatnonzero(~moving)
            if len(stuck):
                stuck = stuck[np.unique(bucket[stuck], return_index=True)[1]]
                full = np.count_nonzero(self.table[bucket[stuck]], axis=1) == SLOTS
                stuck = stuck[full]
                at = rng.integers(0, SLOTS, len(stuck))
                out = self.table[bucket[stuck], at]
                self.table[bucket[stuck], at] = mark[stuck]
                mark[stuck] = out
                bucket[stuck] = self._other(bucket[stuck], out)
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Keys that are held, each once."""
        mark, bucket = self._hash(keys)
        while len(mark):
            here = self.table[bucket] == mark[:, None]
            where = np.where(here.any(1), bucket, self._other(bucket, mark))
            # One key a bucket at a time, so that equal marks each take a slot of their own.
            _, at = np.unique(where, return_index=True)
            b = where[at]
            match = self.table[b] == mark[at][:, None]
            if not match.any(1).all():
                raise KeyError("a key to delete is not held")
            last = np.count_nonzero(self.table[b], axis=1) - 1
            self.table[b, match.argmax(1)] = self.table[b, last]
            self.table[b, last] = 0
            left = np.ones(len(mark), bool)
            left[at] = False
            mark, bucket = mark[left], bucket[left]
