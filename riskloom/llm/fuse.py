"""Static binary-fuse filters in numpy: built once per set of 64-bit keys, never changed.

A key is found at three slots of consecutive segments; the xor of their 16-bit values is the
key's fingerprint. Building peels, round by round, all keys that are alone in some slot.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

FINGERPRINT = np.uint16


class FuseFilter(NamedTuple):
    seed: int
    segment: int  # slots of a segment, a power of two
    segments: int  # where the first of the three slots may lie
    slots: bytes

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not self.slots:
            return np.zeros(len(keys), bool)
        values = np.frombuffer(self.slots, FINGERPRINT)
        hashed = _mix(keys, self.seed)
        a, b, c = _places(hashed, self.segment, self.segments)
        return (values[a] ^ values[b] ^ values[c]) == _fingerprint(hashed)


def build(keys: np.ndarray, max_seeds: int = 100) -> FuseFilter:
    """Filter over the distinct ``keys``; an empty set gives a filter that holds nothing."""
    keys = np.unique(np.asarray(keys, np.int64))
    n = len(keys)
    if n == 0:
        return FuseFilter(0, 1, 1, b"")
    segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(1, max_seeds + 1):
        hashed = _mix(keys, seed)
        places = np.stack(_places(hashed, segment, segments))
        order = _peel(places, segment * (segments + 2))
        if order is not None:
            values = np.zeros(segment * (segments + 2), FINGERPRINT)
            mark = _fingerprint(hashed)
            for slots, who in reversed(order):
                a, b, c = places[:, who]
                # The own slot is still zero here, so the xor of all three is that of the others.
                values[slots] = mark[who] ^ values[a] ^ values[b] ^ values[c]
            return FuseFilter(seed, segment, segments, values.tobytes())
        if seed % 10 == 0:
            segments += max(1, segments // 4)
    raise RuntimeError(f"no filter found for {n} keys")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _fingerprint(hashed: np.ndarray) -> np.ndarray:
    return (hashed ^ (hashed >> np.uint64(32))).astype(FINGERPRINT)


def _places(hashed: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, ...]:
    mask = np.uint64(segment - 1)
    first = ((hashed >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((hashed >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (hashed & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    n = places.shape[1]
    count = np.bincount(places.ravel(), minlength=size)
    holder = np.zeros(size, np.int64)
    np.add.at(holder, places.ravel(), np.tile(np.arange(n), 3))  # alone in a slot: the sum is the key
    done, order = 0, []
    while done < n:
        lone = np.flatnonzero(count == 1)
        if not len(lone):
            return None
        who, at = np.unique(holder[lone], return_index=True)
        order.append((lone[at], who))
        gone = places[:, who].ravel()
        np.subtract.at(count, gone, 1)
        np.subtract.at(holder, gone, np.tile(who, 3))
        done += len(who)
    return order
